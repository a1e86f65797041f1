"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers, floor(scale * x). Candidates are grouped into
buckets of similar length (quantile ranges of the norm), and a bucket into
blocks of bounded size; queries are grouped into blocks of bounded size too. A
block pair is one task's group, so no group grows with the table.

1. Seed: each query meets the first block of the longest bucket only. Its k-th
   best score there is a lower bound of its final k-th score.
2. For a query and a bucket, the bound over the product of the query's length
   and the bucket's largest length is the local cosine threshold. Above 1 the
   query skips the bucket. Queries are then put into blocks by the number of
   buckets they visit, and a candidate is shipped only to blocks with a query
   that visits its bucket. A block pair prunes by coordinates where the threshold
   is high (the exact product over the query's largest coordinates plus the
   Cauchy-Schwarz bound of the rest must reach the bound) and by length where it is
   low (the candidates are sorted by length, and those too short for the bound are
   cut off).
3. Survivors are verified by exact integer products; the k best of each block
   are merged per query by an aggregate that keeps k.

Each query row is a query of its own, also where rows share a vec_id, and meets all
rows but itself. Ties go to the smaller vec_id. Vectors that are null, or hold null
or non-finite components, take no part, nor do rows with a null vec_id. Vectors of
different length than the query's are no candidates for it. Components are kept
within int64, and a score beyond int64 is its nearest limit. Repeated rows are
candidates each for itself; other columns, of any name, are ignored. Queries and
candidates that meet are shipped to their pair of blocks, and past ``MAX_NEEDS`` pairs
of query block and bucket a candidate goes to every query block: what is shipped grows
with the product of both in blocks. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 8192
BUCKETS = 8
#: Local cosine thresholds from here on prune by coordinates.
HIGH_COSINE = 0.5
FOCUS = 16
#: Pairs of query block and bucket whose list is broadcast; with more, a candidate goes to every query block.
MAX_NEEDS = 1_000_000
_INT64 = np.iinfo(np.int64)


def quantise(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>, norm double, dim): usable vectors only."""
    x = F.col(embedding)
    usable = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint"))
    return usable.select(F.col(vec_id).alias("vec_id"), v.alias("v")).select("vec_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))).alias("norm"), F.size("v").alias("dim"))


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products as int64: floats hold them below 2^53; integers that might leave int64 are Python's, cut off at its limits."""
    if c.dtype == object:
        return np.array([min(max(sum(map(int.__mul__, row, q)), _INT64.min), _INT64.max) for row in c.tolist()], np.int64)
    return (c @ q).astype(np.int64)


def _best(q: np.ndarray, q_key: np.ndarray, q_norm: np.ndarray, bound: np.ndarray, c: np.ndarray, c_key: np.ndarray, c_id: np.ndarray, c_norm: np.ndarray, k: int):
    """For each query: its number, and ids and scores of its k best candidates of the block that can reach its bound."""
    order = np.argsort(-c_norm, kind="stable")
    c, c_key, c_id, c_norm = c[order], c_key[order], c_id[order], c_norm[order]
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(np.isfinite(bound), bound / (q_norm * c_norm[0]), -np.inf)
    for i in range(len(q)):
        if cosine[i] > 1 + 1e-9:
            continue
        n = len(c)
        if cosine[i] > 0:  # too short for the bound, even if parallel
            n = int(np.searchsorted(-c_norm, -(bound[i] / q_norm[i]) * (1 - 1e-9), side="right"))
        pick = slice(0, n)
        if cosine[i] >= HIGH_COSINE and c.shape[1] > FOCUS:
            own = q[i].astype(float)
            focus = np.argpartition(-np.abs(own), FOCUS)[:FOCUS]
            part = c[:n, focus].astype(float)
            rest = np.sqrt(np.maximum(c_norm[:n] ** 2 - (part**2).sum(axis=1), 0)) * np.sqrt(max(q_norm[i] ** 2 - float((own[focus] ** 2).sum()), 0))
            pick = np.flatnonzero(part @ own[focus] + rest + 1e-9 * q_norm[i] * c_norm[:n] + 1e-6 >= bound[i])
        score = _products(c[pick], q[i].tolist() if c.dtype == object else q[i])
        ok = c_key[pick] != q_key[i]
        if np.isfinite(bound[i]):
            ok &= score.astype(float) >= bound[i]
        ids, score = c_id[pick][ok], score[ok]
        if len(ids) > k:
            ok = score >= np.partition(score, -k)[-k]
            ids, score = ids[ok], score[ok]
        top = np.lexsort((ids, ~score))[:k]  # ~x falls as x rises, and holds at the least integer too
        yield i, ids[top], score[top]


def _pairs(k: int):
    def run(q, c):
        import pyarrow as pa

        def stack(t):
            return np.array(t.column("v").to_pylist(), np.int64).reshape(t.num_rows, -1)

        def num(t, name):
            return t.column(name).to_numpy()

        out = {"key": [], "query_id": [], "vec_id": [], "score": []}
        if q.num_rows and c.num_rows:
            x, y = stack(q), stack(c)
            most = max(abs(int(x.min(initial=0))), int(x.max(initial=0)), 1) * max(abs(int(y.min(initial=0))), int(y.max(initial=0)), 1) * max(1, x.shape[1])
            kind = float if most < 1 << 53 else np.int64 if most < 1 << 63 else object  # floats: exact, and BLAS
            x, y = x.astype(kind), y.astype(kind)
            bound = np.array([-np.inf if b is None else b for b in q.column("bound").to_pylist()], float)
            key, query_id = num(q, "key"), num(q, "vec_id")
            for i, ids, score in _best(x, key, num(q, "norm"), bound, y, num(c, "key"), num(c, "vec_id"), num(c, "norm"), k):
                out["key"] += [key[i]] * len(ids)
                out["query_id"] += [query_id[i]] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += score.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def _meet(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(key, query_id, vec_id, score): the k best of each (query, candidate block); both have the columns pair_q, pair_c, dim."""
    keys = ["pair_q", "pair_c", "dim"]
    # both sides come from one table: columns of their own
    queries, blocks = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, blocks))
    return queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_pairs(k), "key bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, scale: int = 256, buckets: int = BUCKETS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row for whose id ``is_query(vec_id)`` holds."""
    # a key for each row; written once, so that it stays
    rows = materialize(quantise(vectors, scale, vec_id, embedding).withColumn("key", F.monotonically_increasing_id()), "vectors")
    edges = sorted(set(rows.approxQuantile("norm", [i / buckets for i in range(1, buckets)], 0.01)))
    bucket = sum((F.when(F.col("norm") > e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    queries = rows.where(is_query(F.col("vec_id"))).drop("bucket")
    # at most buckets x dimensions rows
    stats = [(r["bucket"], r["dim"], r["longest"], max(1, -(-r["n"] // CANDIDATE_BLOCK))) for r in rows.groupBy("bucket", "dim").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()]
    spark = vectors.sparkSession
    of_bucket = F.broadcast(spark.createDataFrame(stats or [(0, 0, 0.0, 1)], "bucket int, dim int, longest double, blocks bigint"))
    candidates = rows.join(of_bucket, ["bucket", "dim"]).withColumn("pair_c", F.concat_ws(":", "bucket", F.pmod(F.xxhash64("key"), F.col("blocks")))).select("key", "vec_id", "v", "norm", "dim", "bucket", "pair_c")

    # the first block of the longest bucket gives each query a bound
    some = max(1, -(-queries.count() // QUERY_BLOCK))
    every = F.explode(F.sequence(F.lit(0), F.lit(some - 1))).alias("pair_q")
    last = of_bucket.groupBy("dim").agg(F.max("bucket").alias("bucket"))
    first = candidates.join(F.broadcast(last), ["dim", "bucket"], "left_semi").where(F.col("pair_c").endswith(":0")).drop("bucket").select("*", every)
    seeded = queries.withColumn("pair_q", F.pmod(F.xxhash64("key"), F.lit(some)).cast("int")).join(F.broadcast(last), "dim")
    seed = _meet(seeded.withColumns({"pair_c": F.concat_ws(":", "bucket", F.lit(0)), "bound": F.lit(None).cast("double")}), first, k)
    bound = seed.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))

    # queries that visit as many buckets share blocks
    visits = queries.join(bound, "key", "left").join(of_bucket, "dim").where(F.col("bound").isNull() | (F.col("bound") <= F.col("norm") * F.col("longest") * (1 + 1e-9) + 1e-9))
    visits = visits.groupBy("key").agg(F.first("bound").alias("bound"), F.collect_list(F.struct("bucket", "blocks")).alias("to"))
    visits = materialize(visits.withColumn("depth", F.size("to")), "visits")  # at most ``buckets`` entries each
    groups = [(r["depth"], max(1, -(-r["n"] // QUERY_BLOCK))) for r in visits.groupBy("depth").agg(F.count("*").alias("n")).collect()]
    of_depth = F.broadcast(spark.createDataFrame(groups or [(0, 1)], "depth int, parts bigint"))
    placed = visits.join(of_depth, "depth").withColumn("pair_q", F.concat_ws(":", "depth", F.pmod(F.xxhash64("key"), F.col("parts"))))
    met = queries.join(placed, "key").select("key", "vec_id", "v", "norm", "dim", "bound", "pair_q", F.explode("to").alias("x")).select("*", "x.bucket", "x.blocks").drop("x")
    pairs = met.select("key", "vec_id", "v", "norm", "dim", "bound", "pair_q", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.concat_ws(":", "bucket", b))).alias("pair_c"))
    if sum(n for _, n in groups) * max(1, len(stats)) <= MAX_NEEDS:
        candidates = candidates.join(F.broadcast(met.select("pair_q", "dim", "bucket").distinct()), ["dim", "bucket"])
    else:
        blocks = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).cast("bigint").alias("n")) for d, n in groups])
        candidates = candidates.select("*", F.explode(blocks).alias("g")).select("*", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g.n") - 1), lambda i: F.concat_ws(":", F.col("g.d"), i))).alias("pair_q")).drop("g")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return _meet(pairs, candidates.drop("bucket"), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
