"""Unrealised profit of positions at their latest price; what cannot be valued says why."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import INT64_MAX, fits


def value(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Each position with price, price_seq, unrealized and reason (null if valued, else unevaluable's reason).

    ``prices`` are (viewpoint, instrument, price, price_seq). Valued positions are admitted in order of
    instrument while their running sum stays within int64; one that would leave it is valuation_overflow, and
    later ones may still fit. Viewpoints whose absolute values sum to less skip that sequence.
    """
    rows = positions.join(prices, ["viewpoint", "instrument"], "left")
    worth = F.col("qty").cast("decimal(19,0)") * F.col("price").cast("decimal(19,0)")
    reason = F.when(F.col("price").isNull(), "no_price_in_prefix").when(worth > F.lit(INT64_MAX).cast("decimal(38,0)"), "valuation_overflow")
    rows = rows.withColumn("reason", reason).withColumn("unrealized", F.when(F.col("reason").isNull(), worth - F.col("total_cost").cast("decimal(38,0)")).cast("bigint"))
    reach = rows.groupBy("viewpoint").agg(F.sum(F.abs(F.col("unrealized").cast("decimal(38,0)"))).alias("reach"))
    tight = [r["viewpoint"] for r in reach.where(F.col("reach") > F.lit(INT64_MAX).cast("decimal(38,0)")).collect()]
    if tight:
        some = rows.where(F.col("viewpoint").isin(tight))
        rows = rows.where(~F.col("viewpoint").isin(tight)).unionByName(some.repartition("viewpoint").sortWithinPartitions("viewpoint", "instrument").mapInArrow(_admit(rows.columns), some.schema))
    valued = F.col("reason").isNull()
    return rows.select("viewpoint", "instrument", "qty", "total_cost", *[F.when(valued, F.col(c)).alias(c) for c in ("price", "price_seq", "unrealized")], "reason")


def _admit(columns: list[str]):
    view, gain, why = columns.index("viewpoint"), columns.index("unrealized"), columns.index("reason")

    def run(batches):
        now, total = None, 0
        for b in batches:
            views, gains, reasons = (b.column(i).to_pylist() for i in (view, gain, why))
            for i, (v, g) in enumerate(zip(views, gains, strict=True)):
                if v != now:
                    now, total = v, 0
                if g is not None:
                    if fits(total + g):
                        total += g
                    else:
                        gains[i], reasons[i] = None, "valuation_overflow"
            cols = list(b.columns)
            cols[gain], cols[why] = pa.array(gains, cols[gain].type), pa.array(reasons, cols[why].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return run


def unrealized_total(valued: DataFrame) -> DataFrame:
    return valued.groupBy("viewpoint").agg(F.coalesce(F.sum(F.col("unrealized").cast("decimal(38,0)")), F.lit(0)).cast("bigint").alias("unrealized_pnl"))


def unevaluable(valued: DataFrame) -> DataFrame:
    return valued.where("reason IS NOT NULL").select("viewpoint", "instrument", "reason")
