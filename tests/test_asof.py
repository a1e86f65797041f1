import random

import pytest
from pyspark.sql import functions as F

from tallyfeed.operators.asof import as_of, in_force


@pytest.mark.parametrize("greatest", [False, True])
def test_as_of_equals_brute_force(spark, greatest):
    """Ties, null keys, keys without prices, a key that holds most rows and spans partitions, and one without rows in between."""
    rng = random.Random(8)
    keys = ["A"] * 12 + ["B", "C", "D", None]
    left = [(i, rng.choice(keys), rng.randint(0, 300)) for i in range(700)]
    right = [(rng.choice(keys), rng.randint(0, 300), rng.randint(0, 9), rng.randint(0, 99)) for _ in range(150)]
    right = [r for r in right if r[0] != "C" and (r[0] != "A" or r[1] < 20 or r[1] > 250)]
    l_df = spark.createDataFrame(left, "id bigint, k string, t bigint").repartition(3)
    r_df = spark.createDataFrame(right, "k string, t bigint, rank bigint, price bigint").repartition(2)
    want = []
    for i, k, t in left:
        seen = [(rank, price) if greatest else (at, rank, price) for kk, at, rank, price in right if kk == k and k is not None and at <= t]
        want.append((i, k, t, *(max(seen)[-2:] if seen else (None, None))))
    for partitions, batch in ((1, 10_000), (7, 10_000), (23, 16)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = as_of(l_df, r_df, "k", "t", ["rank", "price"], greatest=greatest).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        assert sorted(map(tuple, got)) == sorted(want), (partitions, batch)
    assert as_of(l_df.where("false"), r_df, "k", "t", ["price"]).count() == 0
    assert as_of(l_df, r_df.where("false"), "k", "t", ["price"]).where("price IS NULL").count() == 700
    with pytest.raises(ValueError):
        as_of(l_df, l_df, "k", "t", ["id"])


def test_in_force_equals_brute_force(spark):
    """Intervals of all lengths, touching, empty and open ones; points on their ends, negative and far ones."""
    rng = random.Random(2)
    intervals = [(i, s, s + n if rng.random() < 0.9 else None) for i, (s, n) in enumerate((rng.randint(-500, 500), rng.choice([0, -3, 1, 2, 3, 4, 5, 16, 17, 64, 255, 256, 1 << 20, 1 << 40])) for _ in range(300))]
    points = [(p,) for p in [*range(-30, 30), -(1 << 40), 1 << 40, (1 << 40) + 3, 500, 501]] + [(None,), (7,)]
    got = in_force(spark.createDataFrame(points, "p bigint"), spark.createDataFrame(intervals, "id bigint, start bigint, stop bigint"), "p")
    want = [(p, i, s, e) for (p,) in points if p is not None for i, s, e in intervals if s <= p and (e is None or p < e)]
    rows = [(r["p"], r["id"], r["start"], r["stop"]) for r in got.collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert in_force(spark.createDataFrame(points, "p bigint"), spark.createDataFrame([], "id bigint, start bigint, stop bigint"), "p").count() == 0


def test_an_interval_is_two_rows(spark):
    """However long: what is joined grows with rows, not with lengths."""
    intervals = spark.createDataFrame([(i, i, i + (1 << (i % 50))) for i in range(1, 1000)], "id bigint, start bigint, stop bigint")
    plan = in_force(spark.range(10).withColumnRenamed("id", "p"), intervals, "p")
    assert plan.where(F.col("start") > F.col("p")).count() == 0
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
