"""Verification of a feed as DataFrames: each line is judged where it lies, neighbours meet by window.

A segment (a block of a file) has its lines numbered and linked inside it; one
small row per segment (records so far, last hash) links the segments. Only the
first fault counts, and an earlier line's verdict never depends on a later line.
Lines are classified once a call and written out, as are their faults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.feed import GENESIS, UNFINISHED, ChainError, read_lines
from ..store import materialize


@dataclass
class VerifiedFeed:
    """Records of a valid chain: seq, type, id, effective, payload, prev, line_hash."""

    records: DataFrame
    count: int
    residue: int
    head: str

    def prefix_hash(self, seq: int) -> str:
        if seq == 0:
            return "sha256:" + GENESIS
        if not 0 < seq <= self.count:
            raise ValueError(f"seq {seq} is not within 0 to {self.count}")
        return "sha256:" + (self.head if seq == self.count else self.records.where(F.col("seq") == seq).first()["line_hash"])


def chain_faults(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered lines with their fault or null, one row per segment) of classified lines."""
    inside = Window.partitionBy("segment").orderBy("line_no")
    accepted = F.col("class").isin("record", "hard")
    per = lines.groupBy("segment").agg(
        F.count_if(accepted).alias("n"),
        F.max_by("line_hash", F.when(accepted, F.col("line_no"))).alias("last_hash"),
        F.max(F.when(accepted, F.col("line_no"))).alias("last_record"),
        F.max(F.when(F.col("class") == "residue", F.col("line_no"))).alias("last_residue"),
        F.max_by("terminated", F.when(F.col("class") == "residue", F.col("line_no"))).alias("residue_terminated"),
        F.count_if(F.col("class").isin("blank", "residue")).alias("residue"),
    )
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row per segment
    per = per.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "base_hash": F.coalesce(F.last("last_hash", True).over(before), F.lit(GENESIS))})
    rows = lines.where(accepted).join(per.select("segment", "base", "base_hash"), "segment")
    n = F.col("base") + F.row_number().over(inside)
    prev = F.coalesce(F.lag("line_hash").over(inside), F.col("base_hash"))
    rows = rows.withColumns({"want": n, "prev_hash": prev})
    fault = (
        F.when(F.col("class") == "hard", F.col("reason"))
        .when(F.col("seq") < F.col("want"), F.concat(F.lit("seq "), "seq", F.lit(" comes again after "), F.col("want") - 1, F.lit(" records")))
        .when(F.col("seq") > F.col("want"), F.concat(F.lit("seq "), "seq", F.lit(" leaves out "), "want"))
        .when(F.col("prev") != F.col("prev_hash"), F.lit("prev is not the hash of the line before"))
    )
    return rows.withColumn("fault", fault), per


def summary(rows: DataFrame, per: DataFrame) -> DataFrame:
    """One row about numbered lines and their segments: records, residue, head, and the first fault (seq, fault; null if none).

    The first fault of a line counts. Where there is none, a feed whose last residue is a whole line with no record
    after it is at fault at the seq that would come next.
    """
    first = rows.where("fault IS NOT NULL").agg(F.min(F.struct("segment", "line_no", "seq", "fault")).alias("x"))
    with_residue, with_records = F.col("last_residue").isNotNull(), F.col("n") > 0
    told = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("residue"), F.lit(0)).alias("residue"),
        F.max_by("last_hash", F.when(with_records, F.col("segment"))).alias("head"),
        F.max(F.when(with_residue, F.struct("segment", F.col("last_residue").alias("line_no"), "residue_terminated"))).alias("residue_at"),
        F.max(F.when(with_records, F.struct("segment", F.col("last_record").alias("line_no")))).alias("record_at"),
    )
    at = lambda c: F.struct(f"{c}.segment", f"{c}.line_no")
    open_end = F.col("residue_at.residue_terminated") & (F.col("record_at").isNull() | (at("residue_at") > at("record_at")))
    late = F.when(F.coalesce(open_end, F.lit(False)), F.struct((F.col("records") + 1).alias("seq"), F.lit(UNFINISHED).alias("fault")))
    found = F.when(F.col("x").isNotNull(), F.struct(F.col("x.seq").alias("seq"), F.col("x.fault").alias("fault"))).otherwise(late)
    return told.crossJoin(first).select("records", "residue", F.coalesce("head", F.lit(GENESIS)).alias("head"), found.alias("f")).select("records", "residue", "head", "f.seq", "f.fault")


def verify(spark: SparkSession, path: str) -> VerifiedFeed:
    """The verified feed at the path; raises FeedNotFound or ChainError."""
    rows, per = chain_faults(read_lines(spark, path))
    rows, per = materialize(rows, "records"), materialize(per, "segments")
    told = summary(rows, per).first()
    if told["fault"]:
        raise ChainError(told["seq"], told["fault"])
    return VerifiedFeed(rows.select("seq", "type", "id", "effective", "payload", "prev", "line_hash"), told["records"], told["residue"], told["head"])
