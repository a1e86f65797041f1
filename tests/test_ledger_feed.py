import glob
import os
import threading

import pytest

from tallyfeed.functions.canon import Number, encode, sha256_hex
from tallyfeed.plans.verify import verify
from tallyfeed.sources.feed import GENESIS, ChainError, FeedNotFound, classify
from tallyfeed.sources.ledger_feed import ROWS, Block, FeedReader, FeedStream, LedgerFeed, LostRace, ZonedReader, append_batch, blocks_of, committed, packed, read_feed, read_lines_of, read_zones, records_of, segments, seq_of, write_zones


def chain(n, start=1, prev=GENESIS, pad=0):
    out = []
    for i in range(start, start + n):
        out.append(encode({"effective": "2026-01-01", "id": f"e{i}", "payload": {"n": i, "pad": "x" * (i * pad % 97)}, "prev": prev, "seq": i, "type": "note"}))
        prev = sha256_hex(out[-1])
    return out, prev


def write(folder, segments):
    os.makedirs(folder, exist_ok=True)
    for i, data in enumerate(segments):
        with open(f"{folder}/{i:03}.jsonl", "wb") as f:
            f.write(data)
    return str(folder)


def test_lines_of_blocks(tmp_path):
    """Every line is in one block, whatever the blocks, also empty and unfinished ones."""
    for data in (b"", b"\n", b"a", b"a\n", b"\n\nab\nc\r\n\nlast", b"x" * 50 + b"\ny\n"):
        (tmp_path / "f").write_bytes(data)
        parts = data.split(b"\n")
        at, want = 0, []
        for i, p in enumerate(parts):
            if i < len(parts) - 1 or p:
                want.append((at, p, i < len(parts) - 1))
            at += len(p) + 1
        for size in (1, 2, 3, 7, 100):
            got = []
            for lo in range(0, len(data), size):
                with open(tmp_path / "f", "rb") as raw:
                    got += read_lines_of(raw, lo, min(lo + size, len(data)))
            assert got == want, (data, size)


def test_zones_skip_blocks(spark, tmp_path):
    lines, _ = chain(300, pad=31)
    path = write(tmp_path / "feed", [b"\n".join(lines[i : i + 100]) + b"\n" for i in (0, 100, 200)] + [b"no record\n"])
    whole = read_feed(spark, path, block_bytes=4096)
    assert whole.schema == ROWS and whole.count() == 301
    zones = write_zones(spark, path, 4096)
    for condition, low, high in (("seq <= 40", 1, 40), ("seq = 250", 250, 250), ("seq > 290", 291, 300), ("seq >= 100 AND seq < 103", 100, 102), ("seq IN (5, 9)", 5, 9), ("seq > 1000", 1, 0)):
        df = read_feed(spark, path, zones, 4096).where(condition)
        got = sorted(r["seq"] for r in df.collect())
        assert got == [i for i in range(low, high + 1) if condition != "seq IN (5, 9)" or i in (5, 9)]
        touched = {r.name + str(r.start) for r in blocks_of(path, 4096)}
        assert df.rdd.getNumPartitions() < 0.6 * len(touched), condition
    # a block that has grown since is read
    more, _ = chain(5, 301, sha256_hex(lines[-1]))
    with open(f"{path}/003.jsonl", "ab") as f:
        f.write(b"\n".join(more) + b"\n")
    assert read_feed(spark, path, zones, 4096).where("seq > 300").count() == 5
    reader = ZonedReader(path, 4096, zones)
    assert reader.partitions() == blocks_of(path, 4096) and list(reader.read(Block(path, "", 0, 0))) == []
    with pytest.raises(FeedNotFound):
        blocks_of(str(tmp_path / "none"), 10)


def test_small_blocks_share_tasks(spark, tmp_path):
    lines, _ = chain(900, pad=31)
    path = write(tmp_path / "feed", [b"\n".join(lines[:600]) + b"\n", b"\n".join(lines[600:]) + b"\n"])
    zones = write_zones(spark, path, 512)
    assert len(read_zones(zones)) == len(blocks_of(path, 512)) > 350
    tasks = FeedReader(path, 512).partitions()
    assert len(tasks) <= 66 and sum(t.end - t.start for t in tasks) == sum(size for _, size in segments(path))
    assert sorted(r["seq"] for r in read_feed(spark, path, block_bytes=512).collect()) == list(range(1, 901))
    some = read_feed(spark, path, zones, 512).where("seq > 200 AND seq <= 700")
    assert some.rdd.getNumPartitions() <= 70 and sorted(r["seq"] for r in some.collect()) == list(range(201, 701))
    blocks = [Block(path, "f", i * 10, i * 10 + 10) for i in (0, 1, 2, 5, 6)] + [Block(path, "g", 70, 80)]
    assert packed(blocks, 1) == [Block(path, "f", 0, 30), Block(path, "f", 50, 70), Block(path, "g", 70, 80)] and packed(blocks, 6) == blocks


def test_lines_are_made_before_the_task_that_links_them(spark, tmp_path):
    """Also of an order by several columns, of which one has the name of an event's."""
    rows = [("note", f"e{i}", None if i % 2 else "2026", None if i % 3 == 0 else f'{{"b":"\\"{i}","a":1.50}}', i % 5, -i) for i in range(40)]
    events = spark.createDataFrame(rows, "type string, id string, effective string, payload string, k int, id2 int").repartition(4)
    path = str(tmp_path / "feed")
    assert append_batch(events, path, "a", ["k", "id2"]) and append_batch(events.limit(0), path, "b", ["id"])
    want, head = [], GENESIS
    for seq, (kind, name, effective, _, k, i) in enumerate(sorted(rows, key=lambda r: r[4:]), 1):
        payload = {} if i % 3 == 0 else {"a": Number("1.50"), "b": f'"{-i}'}
        want.append(encode({"effective": effective or "", "id": name, "payload": payload, "prev": head, "seq": seq, "type": kind}))
        head = sha256_hex(want[-1])
    (segment,) = glob.glob(f"{path}/*.jsonl")
    assert open(segment, "rb").read() == b"\n".join(want) + b"\n" and verify(spark, path).head == head


def test_records_equal_the_verified_feed(spark, tmp_path):
    lines, _ = chain(50, pad=7)
    path = write(tmp_path / "feed", [b"\n".join(lines[:20]) + b"\n", b"torn", b"\n\n" + b"\r\n".join(lines[20:]) + b"\r\n"])
    want = {r["seq"]: r for r in verify(spark, path).records.collect()}
    got = records_of(read_feed(spark, path, block_bytes=1000)).where("class = 'record'").collect()
    assert {r["seq"]: (r["payload"], r["line_hash"], r["id"]) for r in got} == {k: (r["payload"], r["line_hash"], r["id"]) for k, r in want.items()}
    one = write(tmp_path / "single", [b"\n".join(lines)])  # a file, unfinished
    rows = read_feed(spark, f"{one}/000.jsonl", write_zones(spark, f"{one}/000.jsonl", 700), 700).where("seq > 48").collect()
    assert [(r["seq"], r["terminated"]) for r in rows] == [(49, True), (50, False)]


def stream(spark, path, tmp_path, block=500):
    spark.dataSource.register(LedgerFeed)
    rows = spark.readStream.format("ledger_feed").option("blockBytes", block).load(path)
    query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [r["seq"] for r in spark.read.schema(ROWS).parquet(str(tmp_path / "out")).orderBy("seq").collect() if r["seq"]]


def test_stream_goes_on_where_it_was(spark, tmp_path):
    lines, head = chain(30, pad=13)
    path = write(tmp_path / "feed", [b"\n".join(lines[:12]) + b"\n", b"\n".join(lines[12:]) + b"\n"])
    assert stream(spark, path, tmp_path) == list(range(1, 31))
    more, _ = chain(7, 31, head)
    with open(f"{path}/001.jsonl", "ab") as f:
        f.write(b"\n".join(more[:3]) + b"\n" + more[3][:40])  # unfinished: waits
    assert stream(spark, path, tmp_path) == list(range(1, 34))
    with open(f"{path}/001.jsonl", "ab") as f:
        f.write(more[3][40:] + b"\n")
    write(tmp_path / "feed2", [])
    with open(f"{path}/002.jsonl", "wb") as f:
        f.write(b"\n".join(more[4:]) + b"\n")
    assert stream(spark, path, tmp_path) == list(range(1, 38))
    assert len(os.listdir(tmp_path / "check" / "commits")) >= 3


def test_stream_refuses_a_broken_chain(spark, tmp_path):
    """Inside a block, between blocks of a batch, and between batches."""
    lines, head = chain(12)
    other, _ = chain(12, 1, "1" * 64)
    for i, broken in enumerate(([*lines[:6], *other[6:]], [*lines[:5], *lines[6:]])):
        path = write(tmp_path / f"feed{i}", [b"\n".join(broken) + b"\n"])
        for block in (100_000, 200):
            reader = FeedStream(path, block)
            with pytest.raises(ChainError) as e:
                for part in reader.partitions(reader.initialOffset(), reader.latestOffset()):
                    list(reader.read(part))
            assert e.value.seq == (7 if i == 0 else 7)
    path = write(tmp_path / "later", [b"\n".join(lines[:6]) + b"\n"])
    reader = FeedStream(path, 200)
    start = reader.latestOffset()
    assert start["seq"] == 6 and start["head"] == sha256_hex(lines[5]) and reader.partitions(start, start) == []
    write(tmp_path / "later", [b"\n".join(lines[:6] + other[6:]) + b"\n"])
    with pytest.raises(ChainError):
        for part in reader.partitions(start, reader.latestOffset()):
            list(reader.read(part))


def batch(spark, ids, bad=None):
    rows = [("note", f"e{i}", "2026-01-01", f'{{"n":{i}}}' if i != bad else "[1]") for i in ids]
    return spark.createDataFrame(rows, "type string, id string, effective string, payload string").repartition(3)


def test_append_is_a_transaction(spark, tmp_path):
    path = str(tmp_path / "feed")
    assert append_batch(batch(spark, range(5)), path, "a", ["id"])
    assert append_batch(batch(spark, range(5, 9)), path, "b", ["id"])
    assert not append_batch(batch(spark, range(5, 9)), path, "b", ["id"])  # a replay
    assert verify(spark, path).count == 9 and committed(path, "b")["first"] == 6
    before = {f: open(f, "rb").read() for f in glob.glob(f"{path}/*.jsonl")}
    with pytest.raises(Exception, match="no object"):  # a task fails: nothing is seen of its batch
        append_batch(batch(spark, range(20, 25), bad=22), path, "c", ["id"])
    assert {f: open(f, "rb").read() for f in glob.glob(f"{path}/*.jsonl")} == before and committed(path, "c") is None
    with pytest.raises(Exception, match="type and an id"):
        append_batch(spark.createDataFrame([("", "x", "", "{}")], "type string, id string, effective string, payload string"), path, "d")
    assert append_batch(batch(spark, []), path, "none") and verify(spark, path).count == 9
    assert append_batch(batch(spark, range(20, 25)), path, "c", ["id"]) and verify(spark, path).count == 14
    assert [f for f in os.listdir(path) if f.startswith("_")] == ["_batches"]
    rows = records_of(read_feed(spark, path)).where("class = 'record'").orderBy("seq").collect()
    assert [r["id"] for r in rows] == [f"e{i}" for i in [*range(9), *range(20, 25)]]


def test_two_writers(spark, tmp_path):
    """Of writers that begin at one head, one is seen and the other refused."""
    path, done, gate = str(tmp_path / "feed"), {}, threading.Barrier(2)
    append_batch(batch(spark, range(2)), path, "first", ["id"])

    def run(name, ids):
        events = batch(spark, ids).mapInArrow(slow, "type string, id string, effective string, payload string")
        gate.wait()
        try:
            done[name] = append_batch(events, path, name, ["id"])
        except Exception as e:  # noqa: BLE001
            done[name] = str(e)

    def slow(batches):
        import time

        time.sleep(3)
        yield from batches

    threads = [threading.Thread(target=run, args=(n, ids)) for n, ids in (("x", range(10, 13)), ("y", range(20, 24)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [n for n, r in done.items() if r is True]
    assert len(won) == 1 and any(LostRace.__name__ in str(r) for r in done.values()), done
    feed = verify(spark, path)
    assert feed.count == 2 + (3 if won == ["x"] else 4)
    loser = "y" if won == ["x"] else "x"
    assert append_batch(batch(spark, range(10, 13) if loser == "x" else range(20, 24)), path, loser, ["id"])
    assert verify(spark, path).count == 9


def test_seq_of_a_tail(spark):
    lines, _ = chain(3)
    assert [seq_of(x) for x in lines] == [1, 2, 3]
    assert seq_of(b'{"seq":x,') is None and seq_of(b"") is None and seq_of(b'"seq":99999999999999999999,') is None
    assert classify(lines[0] + b"\n")["seq"] == 1
