"""Property checks of a ledger, as tables of (check, violations, evaluated).

Each check derives what it compares in another way than the ledger does, and counts
what it examined, so that a check of nothing shows. ``emitted`` judges rows of
checks: live data must be clean, a twin must fail exactly as planted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.events import has_key, told_by


def _counted(name: str, df: DataFrame, violation) -> DataFrame:
    return df.agg(F.count_if(violation).alias("violations"), F.count("*").alias("evaluated")).select(F.lit(name).alias("check"), "violations", "evaluated")


def holdings_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(instrument, field, a, b) where two books (instrument, qty, total_cost) differ; field presence: 1 or 0 on each side."""
    sides = a.select("instrument", F.col("qty").alias("qa"), F.col("total_cost").alias("ca"), F.lit(1).cast("bigint").alias("ha")).join(b.select("instrument", F.col("qty").alias("qb"), F.col("total_cost").alias("cb"), F.lit(1).cast("bigint").alias("hb")), "instrument", "full_outer")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), x.alias("a"), y.alias("b")) for n, x, y in (("presence", F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))), ("qty", F.col("qa"), F.col("qb")), ("total_cost", F.col("ca"), F.col("cb")))])
    return sides.select("instrument", F.explode(pairs).alias("x")).select("instrument", "x.*").where("a <> b")


def latest_prices_again(prices: DataFrame) -> DataFrame:
    """(viewpoint, instrument, price, price_seq) by ranking visible prices, to hold the ledger's own against."""
    order = Window.partitionBy("viewpoint", "instrument").orderBy(F.desc("effective"), F.desc("seq"))
    return prices.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("viewpoint", "instrument", "price", F.col("seq").alias("price_seq"))


def at_most_once(fills: DataFrame) -> DataFrame:
    """Of classified fills: keys applied more than once; absorbed fills that differ from the applied one; collisions that equal it."""
    key, said = told_by(fills)
    fills = fills.withColumn("said", F.struct(*said))
    rows = fills.where(has_key(fills)).select(*key, "status", "said")
    applied = F.col("status") == "applied"
    of = rows.groupBy(*key).agg(F.count_if(applied).alias("n"), F.max(F.when(applied, F.col("said"))).alias("was"))
    late = rows.where("status IN ('absorbed', 'collision')").join(of.select(*key, "was"), list(key))
    absorbed = F.col("status") == "absorbed"
    same = reduce(Column.__and__, [F.col(f"said.{c}") == F.col(f"was.{c}") for c in said])
    both = late.agg(F.count_if(absorbed & ~same).alias("a"), F.count_if(absorbed).alias("b"), F.count_if(~absorbed & same).alias("c"), F.count_if(~absorbed).alias("d"))
    row = lambda name, x, y: F.struct(F.lit(name).alias("check"), F.col(x).alias("violations"), F.col(y).alias("evaluated"))
    told = both.select(F.inline(F.array(row("absorbed_equal", "a", "b"), row("collision_differs", "c", "d"))))
    return _counted("applied_once", of, F.col("n") > 1).union(told)


def fail_closed(valued: DataFrame, prices: DataFrame) -> DataFrame:
    """Of valued positions and visible prices: values without a price of the prefix, prices carried from elsewhere, and positions neither valued nor declared unevaluable (or both)."""
    both = valued.join(latest_prices_again(prices).select("viewpoint", "instrument", F.col("price").alias("p"), F.col("price_seq").alias("s")), ["viewpoint", "instrument"], "left")
    silent = _counted("silent_zero", both, F.col("unrealized").isNotNull() & F.col("p").isNull())
    stale = _counted("stale_price", both.where("p IS NOT NULL AND reason IS NULL"), (F.col("price") != F.col("p")) | (F.col("price_seq") != F.col("s")))
    declared = _counted("undeclared_unpriced", both, F.col("unrealized").isNull() != F.col("reason").isNotNull())
    return reduce(DataFrame.union, [silent, stale, declared])


def emitted(rows: DataFrame) -> DataFrame:
    """(name, reason) of rows (name, cell, checks map, evaluated map, expected map) that must not be reported."""
    none = F.create_map().cast("map<string,bigint>")
    checks, evaluated, expected = (F.coalesce(c, none) for c in ("checks", "evaluated", "expected"))
    keys = F.array_union(F.map_keys(checks), F.map_keys(expected))
    zero = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    reasons = F.array(
        F.when(F.size(checks) == 0, "no check"),
        F.when(F.exists(F.map_keys(checks), lambda k: zero(evaluated, k) <= 0), "a check examined nothing"),
        F.when((F.col("cell") == "live") & F.exists(F.map_values(checks), lambda v: v != 0), "live data fails"),
        F.when((F.col("cell") == "twin") & ~F.exists(F.map_values(checks), lambda v: v != 0), "the planted defect goes unseen"),
        F.when((F.col("cell") == "twin") & F.exists(keys, lambda k: zero(checks, k) != zero(expected, k)), "other violations than planted"),
    )
    return rows.select("name", F.explode(F.array_compact(reasons)).alias("reason"))
