"""Synthetic ledgers of any size, by arithmetic on ``spark.range``: the same rows on every run and any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers and offsets of the pseudo-random columns. Fixed values.
_MIX = {"instrument": (7919, 13), "kind": (104729, 7), "qty": (31337, 3), "price": (27644437, 11), "day": (611953, 5)}


def _number(name: str, n: int):
    a, b = _MIX[name]
    return F.pmod(F.col("seq") * a + b, F.lit(1_000_003)) % n


def generated_events(spark: SparkSession, n: int, instruments: int = 50) -> DataFrame:
    """n fold events (see operators.fold) of one viewpoint: in 16 of them, 9 buys, 5 sells, a dividend, and a split or a dividend; effective dates are not in order of seq."""
    kind = F.when(F.col("k") < 9, "buy").when(F.col("k") < 14, "sell").when((F.col("k") == 14) & (F.col("seq") % 997 == 0), "split").otherwise("dividend")
    trade = F.col("k") < 14
    rows = spark.range(1, n + 1).select(F.col("id").alias("seq")).select("*", _number("kind", 16).alias("k"))
    return rows.select(
        F.lit(n).cast("bigint").alias("viewpoint"),
        F.concat(F.lit("G"), _number("instrument", instruments).cast("string")).alias("instrument"),
        F.concat(F.lit("2026-"), F.lpad((_number("day", 12) + 1).cast("string"), 2, "0")).alias("effective"),
        "seq",
        kind.alias("kind"),
        F.when(trade, _number("qty", 90) + 1).alias("qty"),
        F.when(trade, _number("price", 9000) + 100).alias("price"),
        F.when(~trade, F.when(kind == "split", 2).otherwise(_number("qty", 5))).cast("bigint").alias("term"),
    )


def traded_events(rows: DataFrame) -> DataFrame:
    """Fold events of one viewpoint, one for each row (seq, pick, amount, effective) of a table: the kind follows seq as above, the instrument and price follow pick, the quantity or term follows amount."""
    kind = F.when(F.col("k") < 9, "buy").when(F.col("k") < 14, "sell").when((F.col("k") == 14) & (F.col("seq") % 997 == 0), "split").otherwise("dividend")
    trade = F.col("k") < 14
    return rows.select("*", _number("kind", 16).alias("k")).select(
        F.lit(0).cast("bigint").alias("viewpoint"),
        F.concat(F.lit("G"), F.pmod("pick", F.lit(50)).cast("string")).alias("instrument"),
        "effective",
        "seq",
        kind.alias("kind"),
        F.when(trade, F.pmod("amount", F.lit(90)) + 1).alias("qty"),
        F.when(trade, F.pmod("pick", F.lit(9000)) + 100).alias("price"),
        F.when(~trade, F.when(kind == "split", 2).otherwise(F.pmod("amount", F.lit(5)))).cast("bigint").alias("term"),
    )


def repeated_ids(events: DataFrame, column: str = "id") -> DataFrame:
    """(id, n): ids that more than one event has."""
    return events.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def count_true(df: DataFrame, **conditions) -> DataFrame:
    """(name, n): rows for which each named condition holds."""
    counts = df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in conditions])).alias("x")).select("x.*")
