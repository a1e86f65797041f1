"""Token counts by an exact length histogram.

Each document is encoded once and only its length is kept; an aggregate with a
map-side sum gives documents by length, which is written out. Suffix sums over lengths then answer,
for a context limit L: documents and tokens at least L long, the tokens that
remain when each document is cut at L, the tokens lost, and how many documents
come before (ranks for quantiles). Suffix sums are taken in two levels, inside
blocks of ``BLOCK`` lengths and over the block totals, so no task holds the
whole histogram. A null or empty text has length 0; an empty table has no rows. Repeated rows count
each for itself; other columns, of any name, are ignored. A text of any length is
encoded as a whole by its task and only its length kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain, materialize, produce
from .tokens import Encoder

BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(length, n_docs): documents by encoded length."""

    def count(batches):
        encoder = Encoder.of(tokenizer)
        for b in batches:
            col = b.column(0)
            length, n = np.unique(np.fromiter((len(encoder.encode(x.as_py())) // 4 for x in col), np.int64, len(col)), return_counts=True)
            yield {"length": length, "n": n}

    plain = Plain(docs)
    return produce(plain.df.select(plain[text]), count, "length bigint, n bigint").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with docs_at_least, tokens_at_least, truncated_total, lost_total and docs_below for L = length."""
    # read by two branches below: written once, so that documents are encoded once
    blocks = materialize(histogram, "lengths").withColumns({"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("n_docs") * F.col("length")})
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # as many rows as the longest document has blocks of lengths
    later, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outer = totals.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    before = Window.partitionBy("block").orderBy(F.desc("length"))
    return (
        blocks.withColumns({"d_in": F.sum("n_docs").over(before), "t_in": F.sum("tokens").over(before)})
        .join(outer, "block")
        .select(
            "length",
            "n_docs",
            (F.col("d_in") + F.col("d_after")).alias("docs_at_least"),
            (F.col("t_in") + F.col("t_after")).alias("tokens_at_least"),
            (F.col("all_tokens") - F.col("t_in") - F.col("t_after") + F.col("length") * (F.col("d_in") + F.col("d_after"))).alias("truncated_total"),
            (F.col("t_in") + F.col("t_after") - F.col("length") * (F.col("d_in") + F.col("d_after"))).alias("lost_total"),
            (F.col("all_docs") - F.col("d_in") - F.col("d_after")).alias("docs_below"),
        )
    )


def answer(sums: DataFrame, limits: list[int] | None = None, quantiles: list[float] | None = None) -> dict:
    """Totals for any context limits and exact quantiles of length, each from one row of the suffix sums."""
    out: dict = {"limits": {}, "quantiles": {}}
    for limit in limits or []:
        row = sums.where(F.col("length") >= limit).orderBy("length").first()
        whole = sums.agg(F.sum(F.col("length") * F.col("n_docs"))).first()[0] or 0
        out["limits"][limit] = whole if row is None else whole - row["tokens_at_least"] + limit * row["docs_at_least"]
    n = sums.agg(F.max(F.col("docs_below") + F.col("n_docs"))).first()[0]
    for q in quantiles or []:
        rank = max(1, -(-int(q * 1_000_000) * n // 1_000_000)) if n else None
        out["quantiles"][q] = None if rank is None else sums.where(F.col("docs_below") + F.col("n_docs") >= rank).agg(F.min("length")).first()[0]
    return out
