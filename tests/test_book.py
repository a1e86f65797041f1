import random

import pytest
from pyspark.sql import functions as F

from tallyfeed.operators import book as B
from tallyfeed.operators import events as E
from tallyfeed.operators.fold import fold, positions, totals
from tallyfeed.plans.snapshot import applicable
from tallyfeed.streaming.book import start_folded
from tallyfeed.streaming.positions import latest_positions

EVENTS = "viewpoint bigint, instrument string, effective string, seq bigint, kind string, qty bigint, price bigint, term bigint"


def some(rng, n, dates=30):
    out = []
    for seq in range(1, n + 1):
        kind = rng.choice(["buy"] * 5 + ["sell"] * 3 + ["split", "dividend"])
        trade = kind in ("buy", "sell")
        out.append((f"{rng.randrange(dates):03}", seq, kind, rng.randint(1, 9) if trade else None, rng.randint(1, 99) if trade else None, None if trade else rng.choice([1, 1, 2])))
    return out


@pytest.mark.parametrize("run", [1, 2, 5, 64])
def test_late_and_replaced_events(monkeypatch, run):
    """In any order of arrival, with replaced terms: the fold of all, and every saved state that of what comes before it."""
    monkeypatch.setattr(B, "RUN", run)
    rng = random.Random(run)
    for trial in range(60):
        order = some(rng, rng.randint(1, 120))
        order.sort() if trial % 3 == 0 else rng.shuffle(order)
        runs, seen = B.ListRuns(), {}
        while order:
            k = rng.randint(1, 20)
            part, order = order[:k], order[k:]
            actions = [e for e in seen.values() if e[2] in ("split", "dividend")]
            if actions and rng.random() < 0.4:
                part.append((*rng.choice(actions)[:5], rng.choice([1, 3])))
            B.take(runs, sorted(part))
            seen |= {e[:2]: e for e in part}
            assert runs.end == B.advance(B.EMPTY, [seen[k] for k in sorted(seen)])
            position = B.EMPTY
            for before, events, sums in runs.rows:
                assert before == position and len(events) <= 2 * run
                position, told = B.advance(position, events)
                assert told == sums
        assert [e for _, events, _ in runs.rows for e in events] == [seen[k] for k in sorted(seen)]


def test_work_of_events_in_order_is_that_of_a_run():
    rng = random.Random(1)
    runs, events = B.ListRuns(), sorted(some(rng, 20_000, 20_000))
    work = [B.take(runs, events[i : i + 10]) for i in range(0, len(events), 10)]
    assert max(work) <= 2 * B.RUN + 10
    # late events that move no position (refused, or a dividend) stop at the next saved one
    cash = runs.end[1][0]
    assert B.take(runs, [("", 99_999, "sell", 5, 1, None)]) <= 2 * B.RUN + 1
    assert B.take(runs, [(events[10_000][0], 99_998, "dividend", None, None, 7)]) <= 2 * B.RUN + 1 and runs.end[1][0] >= cash
    assert runs.end == B.advance(B.EMPTY, [e for _, run, _ in runs.rows for e in run])


def tables(spark, rng, n=400):
    """Classified fills and actions, and amendments that come after, before or without their action."""
    fills = [(s, f"f{s}", f"{rng.randrange(50):03}", f"k{s}", "h", None, rng.choice("ABC"), rng.choice(["buy", "buy", "sell"]), rng.randint(1, 9), rng.randint(1, 99)) for s in range(1, n) if s % 7 > 1]
    actions = [(s, f"a{s}", f"{rng.randrange(50):03}", f"x{s}", rng.choice("ABC"), rng.choice(["split", "dividend"]), 2, 3) for s in range(1, n) if s % 7 == 0]
    actions = [(*a[:6], a[6] if a[5] == "split" else None, a[7] if a[5] == "dividend" else None) for a in actions]
    notes = [(s, f"m{s}", "", f"x{rng.choice(range(0, n, 7))}", rng.choice([0, 1, 3]), rng.choice([-1, 0, 5])) for s in range(1, n) if s % 7 == 1]
    return (
        E.classify_fills(spark.createDataFrame(fills, "seq bigint, event_id string, effective string, key string, payload_hash string, hash_error string, instrument string, side string, qty bigint, price bigint")),
        E.classify_actions(spark.createDataFrame(actions, "seq bigint, event_id string, effective string, action_id string, instrument string, kind string, ratio bigint, rate bigint")),
        spark.createDataFrame(notes, "seq bigint, event_id string, effective string, action_id string, ratio bigint, rate bigint"),
    )


def test_many_viewpoints_equal_single_ones(spark):
    fills, actions, notes = tables(spark, random.Random(4))
    points = E.viewpoints(spark, [0, 1, 5, 50, 51, 130, 131, 137, 200, 399, 400, 10_000])
    want = fold(applicable(fills, E.resolve_amendments(actions, notes, points)[0], points))
    got = B.fold_at_viewpoints(B.known_events(fills, actions, notes), points)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(positions(got)) == rows(positions(want)) and rows(totals(got)) == rows(totals(want))
    refused = {(r["viewpoint"], r["n"]) for r in want.where("what = 'refusal'").groupBy("viewpoint").agg(F.count("*").alias("n")).collect()}
    assert {(r["viewpoint"], r["n"]) for r in got.where("what = 'sums'").groupBy("viewpoint").agg(F.sum(F.col("detail").cast("bigint")).alias("n")).where("n > 0").collect()} == refused
    assert B.fold_at_viewpoints(B.known_events(fills, actions, notes).where("false"), points).count() == 0


def test_viewpoints_beyond_int64_are_global(spark):
    big = (1 << 62) - 1
    rows = [(i, i, "A" if i % 2 else "B", f"{i}", "buy", 1, big, None) for i in range(1, 4)]
    known = spark.createDataFrame(rows, "known bigint, seq bigint, instrument string, effective string, kind string, qty bigint, price bigint, term bigint").select("known", "instrument", "effective", "seq", "kind", "qty", "price", "term")
    got = B.fold_at_viewpoints(known, E.viewpoints(spark, [1, 2, 3]))
    assert sorted((r["viewpoint"], r["instrument"]) for r in positions(got).collect()) == [(1, "A"), (2, "A"), (2, "B"), (3, "A"), (3, "B")]
    want = fold(spark.createDataFrame([(3, *r[2:4], r[1], *r[4:]) for r in rows], EVENTS), force_global=True)
    assert [tuple(r) for r in positions(got).where("viewpoint = 3").orderBy("instrument").collect()] == [tuple(r) for r in positions(want).orderBy("instrument").collect()]


def test_streamed_fold(spark, tmp_path):
    """Equal to the batch fold under random arrival; late batches refold from a saved position, not from the start."""
    rng = random.Random(9)
    events = [(1, rng.choice(["A", "A", "A", "B"]), *e) for e in some(rng, 900, 400)]
    events.sort(key=lambda e: (e[2], e[3]))
    early, late = events[::2], events[1::2][-60:]
    rng.shuffle(late)
    batches = [early, late[:30], late[30:], [(1, "A", "999", 5000, "buy", 1, 1, None)]]
    source, book = str(tmp_path / "in"), str(tmp_path / "book")
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        start_folded(spark.readStream.schema(EVENTS).parquet(source), str(tmp_path / "check"), book).awaitTermination()
    written = spark.read.parquet(book)
    want = {tuple(r) for r in positions(fold(spark.createDataFrame(sum(batches, []), EVENTS))).collect()}
    assert {tuple(r) for r in latest_positions(written).collect()} == want
    rows = {(r["batch"], r["instrument"]): r for r in written.collect()}
    assert rows[3, "A"]["refolded"] <= 2 * B.RUN + 1 and rows[3, "A"]["n_events"] > 300
    assert rows[1, "A"]["refolded"] < rows[1, "A"]["n_events"]
