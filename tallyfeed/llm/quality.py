"""Document quality from random-indexing word vectors and a two-layer network.

1. Random indexing. A white-space separated chunk is two tokens: its word (letters
   and digits, lower case) and its shape (case pattern, digits and symbols), each
   hashed to a bucket. A bucket has a fixed sparse index vector; its word vector
   is the sum of the index vectors of the tokens around it, over every document.
   The matrix has a fixed size (``BUCKETS`` x ``DIM``) at any input size; tasks
   send theirs in compressed blocks, which are summed in two levels.
2. A document's features pool its words' vectors and its shapes' vectors (means),
   the length of its summed index vectors and the share of words that repeat
   their neighbour (both rise with repetition), and its length.
3. A network of one hidden layer learns the label, by Adam in numpy, from at most
   ``MAX_TRAIN`` labelled documents that are not held out (those of the smallest
   hash); a fifth of these sets the temperature that calibrates probabilities.

Scores come from texts alone. A null or blank text has features of zero and a
score like any other. Labels of unknown documents or null labels are ignored;
with labels of one class only (or none) all scores are that class's share (0.5).
Repeated rows get equal scores. Where texts share a labelled doc_id, the one of the
smallest hash is learned from. A text of any length is read as a whole by its task; an empty
table gives no rows. Input columns named like an output column (in any
case) are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Plain, map_rows, produce, sum_blocks
from .substring_dedup import _mix

BUCKETS, SHAPES, DIM, NONZERO = 8192, 1024, 32, 4
BLOCK = 512
MAX_TRAIN, HIDDEN, EPOCHS = 8000, 32, 250
THRESHOLD = 0.7
CHUNK_WORDS = 200_000
_CORE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UPPER, _LOWER, _DIGIT = (re.compile(p) for p in (rb"[A-Z]+", rb"[a-z\x80-\xff]+", rb"[0-9]+"))


class TokenCache(dict):
    """Chunk -> word bucket * 2^16 + shape bucket."""

    def __missing__(self, chunk: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        core = b"".join(_CORE.findall(chunk)).lower()
        shape = _DIGIT.sub(b"9", _LOWER.sub(b"a", _UPPER.sub(b"A", chunk)))[:12]
        value = self[chunk] = ((zlib.crc32(core) % (BUCKETS - SHAPES) + SHAPES) << 16) | zlib.crc32(shape) % SHAPES
        return value


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero components."""
    x = _mix(np.arange(1, BUCKETS * NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, NONZERO)
    # one place in each quarter of the dimensions, so that places are distinct
    place = (x % np.uint64(DIM // NONZERO)).astype(np.int64) + np.arange(NONZERO) * (DIM // NONZERO)
    return place, np.where(x >> np.uint64(63), 1.0, -1.0)


def _chunks(texts):
    """Token ids and document lengths, some CHUNK_WORDS at a time."""
    cache = TokenCache()

    def of(docs):
        ids, lens = [w for d in docs for w in d], [len(d) for d in docs]
        x = np.fromiter(map(cache.__getitem__, ids), np.int64, len(ids))
        return x >> 16, x & 0xFFFF, np.array(lens, np.int64)

    docs, n = [], 0
    for t in texts:
        docs.append(t.split() if t is not None else [])
        n += len(docs[-1])
        if n >= CHUNK_WORDS:
            yield of(docs)
            docs, n = [], 0
    if docs:
        yield of(docs)


def _accumulate(batches):
    place, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for word, shape, lens in _chunks(x.as_py() for b in batches for x in b.column(0)):
        doc = np.repeat(np.arange(len(lens)), lens)
        near = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = ((word, shape), (word[near], word[near + 1]), (word[near + 1], word[near]), (shape[near], shape[near + 1]), (shape[near + 1], shape[near]), (shape[near], word[near + 1]))
        for target, source in pairs:
            for s in range(NONZERO):
                total += np.bincount(target * DIM + place[source, s], sign[source, s], BUCKETS * DIM)
    total = total.reshape(BUCKETS // BLOCK, BLOCK * DIM)
    yield {"block": list(range(len(total))), "data": [zlib.compress(x.astype("<i8").tobytes(), 1) for x in total]}


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIM unit word vectors from all documents."""
    out = "block int, data binary"
    parts = produce(docs.select(F.col(text).cast("binary")), _accumulate, out).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    halves = produce(parts.repartition("block", "salt").select("block", "data"), sum_blocks, out)
    sums = produce(halves.repartition("block"), sum_blocks, out).collect()  # a row per block and task: BUCKETS x DIM numbers
    vectors = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for r in sums:
        vectors[r["block"]] += np.frombuffer(zlib.decompress(r["data"]), "<i8")
    vectors = vectors.reshape(BUCKETS, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)).astype(np.float32)


N_FEATURES = 2 * DIM + 4


def _features(texts, vectors: np.ndarray) -> np.ndarray:
    place, sign = index_vectors()
    index = np.zeros((BUCKETS, DIM), np.float32)
    np.put_along_axis(index, place, sign.astype(np.float32), axis=1)
    out = [np.zeros((0, N_FEATURES), np.float32)]
    for word, shape, lens in _chunks(texts):
        f = np.zeros((len(lens), N_FEATURES), np.float32)
        some = np.flatnonzero(lens)
        if len(some):
            start, n = (np.cumsum(lens) - lens)[some], lens[some][:, None].astype(np.float32)
            f[some, :DIM] = np.add.reduceat(vectors[word], start) / n
            f[some, DIM : 2 * DIM] = np.add.reduceat(vectors[shape], start) / n
            pooled = np.add.reduceat(index[word], start)
            f[some, -4] = np.log((pooled**2).sum(axis=1) / (NONZERO * n[:, 0]) + 1e-3)
            same = np.zeros(len(word), np.float32)
            same[1:] = word[1:] == word[:-1]
            same[start] = 0
            f[some, -3] = np.add.reduceat(same, start) / n[:, 0]
            f[some, -2] = np.log1p(n[:, 0])
            f[some, -1] = 1
        out.append(f)
    return np.concatenate(out)


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> dict:
    """A network of standardised inputs, one hidden layer and a temperature, as a dict of arrays."""
    if len(set(y.tolist())) < 2:
        return {"prior": float(y[0]) if len(y) else 0.5}
    rng = np.random.default_rng(7)
    held = rng.random(len(y)) < 0.2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    net: dict = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3, "temperature": 1.0}
    z, t = (x[~held] - net["mean"]) / net["scale"], y[~held]
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    moment = [[np.zeros_like(a), np.zeros_like(a)] for a in p]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 1024)):
            step += 1
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = z[rows].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)
            for a, g, m in zip(p, grads, moment, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                a -= 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net["layers"] = p
    if held.any():
        logit, t = _logit(net, x[held]), y[held]
        loss = lambda c: np.logaddexp(0, np.where(t > 0, -logit, logit) / c).mean()
        net["temperature"] = min(np.geomspace(0.25, 8, 60).tolist(), key=loss)
    return net


def _logit(net: dict, x: np.ndarray) -> np.ndarray:
    w, b, v, c = net["layers"]
    return np.clip(np.maximum((x - net["mean"]) / net["scale"] @ w + b, 0) @ v + c, -60, 60)


def probability(net: dict, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), net["prior"]) if "prior" in net else 1 / (1 + np.exp(-_logit(net, x) / net["temperature"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_train: int = MAX_TRAIN, text: str = "text", doc_id: str = "doc_id") -> dict:
    """The network learned from labels (id, label)."""
    chosen = labels.select("id", F.col("label").cast("double").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("t"), F.xxhash64(text).alias("th")).join(F.broadcast(chosen), "id")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    fit = map_rows(rows, lambda texts: (list(_features(texts, shared.value).tolist()),), "f array<float>", ["t"], ["id", "y", "th"])
    fit = fit.groupBy("id").agg(F.min(F.struct("th", "y", "f")).alias("x")).select("id", "x.y", "x.f").toArrow().sort_by("id")
    x = np.array(fit["f"].to_pylist(), float).reshape(-1, N_FEATURES)
    return fit_network(x, fit["y"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with held_out, score (probability of label 1) and predicted (1 if score >= threshold)."""
    plain, new = Plain(docs), ["held_out", "score", "predicted"]
    text, doc_id, own_id = plain[text], plain[doc_id], doc_id
    vectors = word_vectors(plain.df, text)
    labels = Plain(labels)
    labels = labels.df.select(F.col(labels[own_id]).alias("id"), F.col(labels[label]).alias("label"))
    network = train(plain.df, labels, vectors, max_train, text, doc_id)
    kept = plain.kept(keep, new)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    rows = plain.df.select(*kept, F.col(text).cast("binary").alias("t"), F.col(doc_id).alias("id"))
    scored = map_rows(rows, lambda texts: (probability(shared.value[1], _features(texts, shared.value[0])).tolist(),), "score double", ["t"], [*kept, "id"])
    return plain.restore(scored.select(*kept, held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")), new, keep)
