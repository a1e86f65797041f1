"""Replay identity: whether two runs gave the same rows, and if not, where they first differ.

``digest`` is an aggregate that no order and no partitioning alters: a row's sha256 is
cut into four lanes of 60 bits, which are summed. Equal multisets of rows have equal
sums; others have so with a probability of 2^-60 or so in each lane. It is combined on
the map side, and one row comes out, whatever the book's size.

``first_difference`` descends a tree over ranges of keys: a node is a prefix of the
key's bytes (in hex, so that a range of prefixes is a range of keys in UTF-8 order), a
level is the digests of a node's children on both sides, and the least child whose
digests differ is entered. Each level reads what begins with its prefix and sends the
driver at most as many rows as there are children (256 to the power of ``step``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, DIGITS = 4, 15


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """sha256 of a row: each value's length and text, one after the other; a null has none."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *[part(f"`{c}`") for c in sorted(df.columns if columns is None else columns)]), 256)


def _sums(h: Column) -> list[Column]:
    return [F.sum(F.conv(F.substring(h, 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(38,0)")).alias(f"lane{i}") for i in range(LANES)]


def digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n, and lane0 to lane3 as text; an empty table has n = 0 and lanes of 0."""
    sums = df.select(row_hash(df, columns).alias("h")).agg(F.count("*").alias("n"), *_sums(F.col("h")))
    return sums.select("n", *[F.coalesce(F.col(f"lane{i}"), F.lit(0)).cast("string").alias(f"lane{i}") for i in range(LANES)])


def same(a: DataFrame, b: DataFrame) -> bool:
    return digest(a).first() == digest(b).first()


def _key(keys: list[str]) -> Column:
    """The keys' texts as hex, one after the other, between 01 and 00; a null is 00."""
    return F.concat(*[F.coalesce(F.concat(F.lit("01"), F.hex(F.encode(F.col(f"`{k}`").cast("string"), "UTF-8")), F.lit("00")), F.lit("00")) for k in keys])


def first_difference(a: DataFrame, b: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """Rows of the least key (as text) whose rows differ, with ``side`` ("a" or "b"); none if the two are the same."""
    sides = [df.withColumn("_key", _key(keys)).withColumn("_hash", row_hash(df)) for df in (a, b)]
    prefix, width = "", 2 * step
    while True:
        at = [s.where(F.col("_key").startswith(prefix)) for s in sides] if prefix else sides
        child = F.substring("_key", 1, len(prefix) + width)
        level = [s.groupBy(child.alias("child")).agg(F.count("*").alias("n"), *_sums(F.col("_hash"))) for s in at]
        both = level[0].alias("a").join(level[1].alias("b"), "child", "full_outer")
        unequal = reduce(Column.__or__, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", *[f"lane{i}" for i in range(LANES)])])
        found = both.where(unequal).agg(F.min("child").alias("x")).first()["x"]
        if found is None or len(found) < len(prefix) + width:
            # a key ends here: nothing differs at all, or the key itself does
            picked = [s.where(F.col("_key") == found if found is not None else F.lit(False)) for s in sides]
            return picked[0].withColumn("side", F.lit("a")).unionByName(picked[1].withColumn("side", F.lit("b"))).drop("_key", "_hash")
        prefix = found
