import json
import random

from tallyfeed.functions.canon import decode
from tallyfeed.operators import compare
from tallyfeed.operators.leaves import count_leaves, leaf_differences
from tallyfeed.plans import replay


def value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.55:
        return {rng.choice("abcd") + rng.choice(["", ".x"]): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([1, 2, "s", "", None, True, [1, {"a": 2}], [], 12345678901234])


def test_leaves_of_many_documents(spark):
    """As the walk over one document at a time has them: lists are leaves, objects for leaves and leaves for objects, empty and absent ones."""
    rng = random.Random(5)
    pairs = [(i, {f"k{j}": value(rng, 4) for j in range(3)}, {f"k{j}": value(rng, 4) for j in range(3)}) for i in range(80)]
    pairs += [(100 + i, g, g) for i, (_, g, _) in enumerate(pairs[:5])] + [(200, {}, {"a": 1}), (201, {"a": {}}, {})]
    table = lambda at: spark.createDataFrame([(p[0], json.dumps(p[at])) for p in pairs], "id bigint, doc string")
    want = sorted((i, *d) for i, g, d in pairs for d in compare.leaf_differences(decode(json.dumps(g)), decode(json.dumps(d))))
    assert sorted(map(tuple, leaf_differences(table(1), table(2)).collect())) == want and len(want) > 100
    assert {tuple(r) for r in count_leaves(table(1)).collect()} == {(i, len(compare.leaves(g))) for i, g, _ in pairs}
    odd = spark.createDataFrame([(1, None), (2, "no json"), (3, '{"a":1}')], "id bigint, doc string")
    assert [tuple(r) for r in leaf_differences(odd, odd.where("false")).collect()] == [(3, "a", "1", "<absent>")]


def test_replay_digest_and_first_difference(spark):
    rows = [(f"S{i}", i, None if i % 5 == 0 else i * i) for i in range(300)] + [("é", 1, 1), ("", 2, 2), (None, 3, 3)]
    book = spark.createDataFrame(rows, "k string, a bigint, b bigint")
    assert replay.same(book.repartition(5), book.repartition(3, "a")) and replay.digest(book.where("false")).first()["n"] == 0
    assert replay.first_difference(book, book.repartition(7), ["k"]).count() == 0
    changed = spark.createDataFrame([(k, a, 7 if a in (34, 290, 9) and k != "" else b) for k, a, b in rows], book.schema)
    assert not replay.same(book, changed)
    found = {(r["side"], r["k"], r["b"]) for r in replay.first_difference(book, changed, ["k"]).collect()}
    assert found == {("a", "S290", None), ("b", "S290", 7)}
    assert {(r["side"], r["k"]) for r in replay.first_difference(book, book.where("k IS NOT NULL"), ["k"]).collect()} == {("a", None)}
    twice = book.union(book.where("k = 'S1'"))  # a row more of the same
    assert replay.first_difference(book, twice, ["k"]).groupBy("side").count().count() == 2 and not replay.same(book, twice)
    # columns are told apart: values that move from one to the next are no equal rows
    a, b = (spark.createDataFrame([t], "x string, y string") for t in (("1", "23"), ("12", "3")))
    assert not replay.same(a, b)
