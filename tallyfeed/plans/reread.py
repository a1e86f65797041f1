"""A second reading of a feed, which shares nothing with the first: lines as Spark's text and JSON readers see them.

Links are checked by a join of each record with the one of the seq before it, not by
position, so that a fault of the first reading's numbering would show here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records_again(spark: SparkSession, path: str) -> DataFrame:
    """seq, id, type, prev, digest (of the line) of every line that is a JSON object with a seq."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r\z", "").alias("line"))
    read = lines.withColumn("r", F.from_json("line", "seq bigint, id string, type string, prev string"))
    return read.where("r.seq IS NOT NULL").select("r.*", F.sha2("line", 256).alias("digest"))


def chain_again(spark: SparkSession, path: str) -> DataFrame:
    """One row: records, head (digest of the last seq's line), first_break (the least seq that does not follow the one before it, or null)."""
    rows = records_again(spark, path)
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("digest").alias("want"))
    linked = rows.join(before, "seq", "left").withColumn("want", F.when(F.col("seq") == 1, "0" * 64).otherwise(F.col("want")))
    broken = F.coalesce(F.col("prev") != F.col("want"), F.lit(True))
    return linked.agg(F.count("*").alias("records"), F.max_by("digest", "seq").alias("head"), F.min(F.when(broken, F.col("seq"))).alias("first_break"))
