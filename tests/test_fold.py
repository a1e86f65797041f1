import glob
import random
from functools import reduce

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfeed.functions.money import relieve
from tallyfeed.operators import events as E
from tallyfeed.operators.compare import multiset_difference, set_difference
from tallyfeed.operators.fold import Ledger, fold, fold_views, positions, refusals, totals
from tallyfeed.operators.valuation import value
from tallyfeed.plans.properties import at_most_once
from tallyfeed.store import shared_dir

BIG = (1 << 63) - 1
FILLS = "seq bigint, event_id string, effective string, key string, payload_hash string, hash_error string, instrument string, side string, qty bigint, price bigint"
EVENTS = "viewpoint bigint, instrument string, effective string, seq bigint, kind string, qty bigint, price bigint, term bigint"


def sequential(rows):
    """Statuses of fills by the rule as it is told: in order of seq."""
    seen, out = {}, {}
    for seq, _, _, key, h, _, instrument, side, qty, price in sorted(rows):
        if key is None or h is None:
            out[seq] = "malformed"
        elif key in seen:
            out[seq] = "absorbed" if seen[key] == h else "collision"
        elif instrument and side in ("buy", "sell") and qty and qty > 0 and price and price > 0:
            seen[key] = h
            out[seq] = "applied"
        else:
            out[seq] = "malformed"
    return out


def test_fill_rules(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    rows = [(i, f"e{i}", "", pick("k1", "k2", "k3", f"u{i}", None), pick("h1", "h2", None), None, pick("A", "A", None), pick("buy", "sell", "short", None), pick(1, 5, 0, None), pick(3, 9, -1)) for i in range(1, 400)]
    got = {r["seq"]: r["status"] for r in E.classify_fills(spark.createDataFrame(rows, FILLS)).collect()}
    assert got == sequential(rows)
    assert E.classify_fills(spark.createDataFrame([], FILLS)).count() == 0


def test_fills_told_apart_by_fields_as_by_digests(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    rows = [(i, "", pick("t", "u", "t", "é", "", f"n{i}", None), pick("v", "w", None), pick("A", "A", "B", "", None), pick("buy", "sell", "short", None), pick(1, 5, 0, None), pick(3, -1)) for i in range(1, 600)]
    fields = spark.createDataFrame(rows, "seq bigint, effective string, trade_id string, venue string, instrument string, side string, qty bigint, price bigint")
    said = ("instrument", "side", "qty", "price")
    whole = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in said]), F.sha2(F.concat_ws("|", *said), 256))
    digests = E.keyed(fields).withColumns({"payload_hash": whole, "hash_error": F.lit(None).cast("string")}).drop("trade_id", "venue")
    got, want = ({(r["seq"], r["status"], r["detail"]) for r in E.classify_fills(df).collect()} for df in (fields, digests))
    assert got == want and {s for _, s, _ in got} == {"applied", "absorbed", "collision", "malformed"}
    checks = [sorted(map(tuple, at_most_once(E.classify_fills(df)).collect())) for df in (fields, digests)]
    assert checks[0] == checks[1] and all(bad == 0 and n > 0 for _, bad, n in checks[0])


def test_at_most_once_sees_what_is_planted(spark):
    rows = [("a", "h", "applied"), ("a", "h", "absorbed"), ("a", "x", "absorbed"), ("a", "x", "collision"), ("a", "h", "collision"), ("b", "h", "applied"), ("b", "i", "applied"), ("c", "h", "collision"), (None, "h", "malformed")]
    got = sorted(map(tuple, at_most_once(spark.createDataFrame(rows, "key string, payload_hash string, status string")).collect()))
    assert got == [("absorbed_equal", 1, 2), ("applied_once", 1, 3), ("collision_differs", 1, 3)]


def test_actions_and_amendments(spark):
    schema = "seq bigint, event_id string, effective string, action_id string, instrument string, kind string, ratio bigint, rate bigint"
    rows = [(1, "", "", "a", "I", "split", 0, None), (2, "", "", "a", "I", "split", 2, None), (3, "", "", "a", "I", "split", 4, None), (4, "", "", "b", "I", "dividend", None, 0), (5, "", "", None, "I", "split", 2, None), (6, "", "", "c", "I", "merger", 2, None)]
    actions = E.classify_actions(spark.createDataFrame(rows, schema))
    assert {r["seq"]: r["detail"] for r in actions.collect()} == {1: "split ratio must be a whole number >= 1", 2: None, 3: "duplicate action_id a", 4: None, 5: "action missing action_id/instrument/kind", 6: "unknown action kind merger"}
    notes = spark.createDataFrame([(0, "", "", "a", 7, None), (7, "", "", "a", 0, None), (8, "", "", "zz", 1, None), (9, "", "", None, 1, None), (10, "", "", "b", None, 5)], "seq bigint, event_id string, effective string, action_id string, ratio bigint, rate bigint")
    terms, judged = E.resolve_amendments(actions, notes, E.viewpoints(spark, [1, 20]))
    assert {(r["viewpoint"], r["action_id"], r["ratio"], r["rate"]) for r in terms.collect()} == {(20, "a", 7, None), (20, "b", None, 5)}
    assert {(r["viewpoint"], r["seq"], r["status"]) for r in judged.collect()} == {(1, 0, "unknown_action"), (20, 0, "applied"), (20, 7, "malformed"), (20, 8, "unknown_action"), (20, 9, "malformed"), (20, 10, "applied")}


def brute(rows):
    ledger, refused = Ledger(True), []
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if x := ledger.apply(r[1], *r[4:]):
            refused.append((r[3], *x))
    return ledger, refused


def test_parallel_fold_equals_the_global_one(spark):
    rng = random.Random(5)
    rows = [(9, f"I{rng.randint(0, 4)}", f"d{rng.randint(0, 50)}", i, *rng.choice([("buy", rng.randint(1, 90), rng.randint(1, 999), None), ("sell", rng.randint(1, 60), rng.randint(1, 999), None), ("dividend", None, None, 3)])) for i in range(500)]
    rows.append((9, "I0", "d25", 1000, "split", None, None, 2))
    ledger, refused = brute(rows)
    for force in (False, True):
        done = fold(spark.createDataFrame(rows, EVENTS), force).cache()
        assert {(r["instrument"], r["qty"], r["total_cost"]) for r in positions(done).collect()} == {(k, *v) for k, v in ledger.held.items()}
        assert sorted((r["seq"], r["kind"], r["detail"]) for r in refusals(done).collect()) == sorted(refused)
        assert tuple(totals(done).first()) == (9, ledger.cash, ledger.realized, ledger.dividends)


def test_global_overflow_takes_the_sequence(spark):
    rows = [(1, "A", "1", 1, "buy", 1, BIG, None), (1, "B", "2", 2, "buy", 1, BIG, None), (1, "C", "3", 3, "buy", 2, BIG, None), (2, "A", "1", 1, "buy", 1, 5, None)]
    done = fold(spark.createDataFrame(rows, EVENTS))
    assert {(r["viewpoint"], r["instrument"]) for r in positions(done).collect()} == {(1, "A"), (2, "A")}
    assert {(r["seq"], r["detail"]) for r in refusals(done).collect()} == {(2, "buy would overflow cash balance"), (3, "buy cost (qty*price) overflows int64")}


def test_a_global_sequence_is_sorted_in_parts(spark):
    rng = random.Random(6)
    rows = [(view, f"I{rng.randint(0, 9)}", f"d{rng.randint(0, 99):02}", i, rng.choice(["buy", "sell"]), rng.randint(1, 9), rng.randint(1, 9) * 10**17, None) for view in (1, 2, 3) for i in range(700)]
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/sequence-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = fold(spark.createDataFrame(rows, EVENTS))
        for view in (1, 2, 3):
            ledger, refused = brute([r for r in rows if r[0] == view])
            assert {(r["instrument"], r["qty"], r["total_cost"]) for r in positions(done).where(f"viewpoint = {view}").collect()} == {(k, *v) for k, v in ledger.held.items()}
            assert sorted((r["seq"], r["kind"], r["detail"]) for r in refusals(done).where(f"viewpoint = {view}").collect()) == sorted(refused)
            assert any("cash balance" in detail for _, _, detail in refused)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (folder,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/sequence-*")) - before
    assert len(glob.glob(f"{folder}/part-*")) > 1  # no task sorted the whole


@settings(max_examples=200)
@given(st.integers(0, BIG), st.integers(1, BIG), st.data())
def test_relief_stays_within_cost(cost, held, data):
    sold = data.draw(st.integers(0, held))
    assert 0 <= relieve(cost, sold, held) <= cost and abs(2 * (relieve(cost, sold, held) * held - cost * sold)) <= held


def test_valuation_evicts_greedily(spark):
    held = spark.createDataFrame([(1, "A", 1, 0), (1, "B", 1, 0), (1, "C", 1, BIG), (1, "D", 2, 0), (1, "E", 1, 0)], "viewpoint bigint, instrument string, qty bigint, total_cost bigint")
    prices = spark.createDataFrame([(1, "A", BIG, 1), (1, "B", 5, 2), (1, "C", 1, 3), (1, "D", BIG, 4)], "viewpoint bigint, instrument string, price bigint, price_seq bigint")
    got = {r["instrument"]: (r["unrealized"], r["reason"]) for r in value(held, prices).collect()}
    assert got == {"A": (BIG, None), "B": (None, "valuation_overflow"), "C": (1 - BIG, None), "D": (None, "valuation_overflow"), "E": (None, "no_price_in_prefix")}


def test_set_differences(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2, 3, None], [2, 2, 4]))
    assert tuple(set_difference(a, b).first()) == (4, 5)
    assert tuple(set_difference(a, b, spark.range(7).select("id")).first()) == (4, 7)
    assert tuple(multiset_difference(a, b).first()) == (6,)


def test_events_that_several_viewpoints_share(spark):
    rng = random.Random(8)
    schema = EVENTS.replace("viewpoint", "views", 1)
    for price in (9, BIG // 60):  # the second may overflow the balances
        rows = [(rng.choice([1, 5, 7, 7, 7]), rng.choice("ABC"), str(rng.randint(1, 5)), i, *rng.choice([("buy", rng.randint(1, 9), price, None), ("sell", rng.randint(1, 6), price, None), ("split", None, None, 2), ("dividend", None, None, 3)])) for i in range(300)]
        rows += [(2, "D", "1", 301, "buy", 1, 1, None), (4, "E", "1", 301, "sell", 1, 1, None)]
        got = fold_views(spark.createDataFrame(rows, schema), [10, 20, 30])
        want = fold(spark.createDataFrame([(v, *r[1:]) for i, v in enumerate((10, 20, 30)) for r in rows if r[0] >> i & 1], EVENTS))
        for part in (positions, refusals, totals):
            assert sorted(map(tuple, part(got).collect())) == sorted(map(tuple, part(want).collect()))
        assert refusals(got).count() and {r["viewpoint"] for r in totals(got).collect()} == {10, 20, 30}
