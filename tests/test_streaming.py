from tallyfeed.operators.fold import fold, positions
from tallyfeed.streaming.book import start_folded
from tallyfeed.streaming.positions import current_positions, latest_positions, start, tumbling_volume

EVENTS = "viewpoint bigint, instrument string, effective string, seq bigint, kind string, qty bigint, price bigint, term bigint"


def test_late_events_restate(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "kept")
    batches = [[(9, "A", "2", 1, "buy", 5, 10, None), (9, "B", "1", 2, "buy", 1, 1, None)], [(9, "A", "1", 3, "buy", 2, 3, None), (9, "A", "3", 4, "sell", 3, 20, None), (9, "B", "2", 5, "sell", 1, 1, None)]]
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        q = start(spark.readStream.schema(EVENTS).parquet(source), kept, str(tmp_path / "check"), str(tmp_path / "book"))
        q.awaitTermination()
    stored = spark.read.parquet(kept)
    want = {tuple(r) for r in positions(fold(spark.createDataFrame(sum(batches, []), EVENTS))).collect()}
    assert {tuple(r) for r in current_positions(stored).collect()} == want
    assert {tuple(r) for r in latest_positions(spark.read.parquet(str(tmp_path / "book"))).collect()} == want
    assert {r["instrument"] for r in current_positions(stored, spark.createDataFrame([(9, "A")], "viewpoint bigint, instrument string")).collect()} == {"A"}


def test_tumbling_volume(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2026-01-01 10:00:00' AS ts, 'A' AS instrument, 2L AS qty UNION ALL SELECT timestamp'2026-01-01 12:00:00', 'A', 3L UNION ALL SELECT timestamp'2026-01-09 12:00:00', 'A', 1L")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    q = tumbling_volume(stream).writeStream.format("memory").queryName("volume").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["qty"] for r in spark.table("volume").collect()) == [1, 5]


def test_large_integers_beside_nulls(spark, tmp_path):
    price = (1 << 60) + 1
    rows = [(9, "A", "1", 1, "buy", 1, price, None), (9, "A", "2", 2, "dividend", None, None, price + 2)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    start_folded(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "check"), str(tmp_path / "book")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "book")).first()
    assert (row["total_cost"], row["cash"], row["dividends"]) == (price, "2", str(price + 2))
