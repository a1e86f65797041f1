"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document; every word covered by a
window whose word sequence also starts elsewhere (in any document, the same one
included) is removed, judged on the input.

1. Each window has a minimiser: the run of ``M`` words in it with the smallest
   hash, leftmost on ties, so equal windows choose the same run. Consecutive
   windows that share a minimiser occurrence form one super-k-mer. A first pass
   counts super-k-mers by minimiser (a map-side combined aggregate of 24 bytes a
   row). A window can only repeat if its minimiser has two super-k-mers, so a
   Bloom filter of those minimisers, sized from their number, lets a second pass
   ship just the packed strings that can matter. The filter has a fixed largest
   size: where it is full it passes more strings, never fewer.
2. A packed string travels to the bucket of its minimiser once per distinct
   string, with its count. A minimiser with a great many distinct strings (a
   frequent line in changing surroundings), flagged by a second such filter, is
   split: each of its windows travels alone, keyed by its own hash. So no bucket
   holds an unbounded group.
3. In a bucket the windows are sorted and counted exactly, on their words; the
   result joins back to the occurrences and from there to the documents. Texts
   that repeat nothing skip that join, by a third filter.

A worker holds the arrays of some ``CHUNK_WORDS`` words and ``OUT_ROWS`` output rows
at a time. Null or empty texts have no words; texts of fewer than ``k`` words keep
all. Repeated rows repeat each other's windows. Rows are matched by (doc_id, text
hash), so null or repeated ids are no problem: rows equal in both get equal
results. A text of any length is one chunk of its task; an empty table gives no rows.
Input columns named like an output column (in any case) are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import block_of, blocks_for, build, probe
from .common import HashCache, Plain, map_rows, materialize, produce

K, M = 35, 4
#: Words handled as arrays at once.
CHUNK_WORDS = 40_000
#: Output rows collected before they leave a worker.
OUT_ROWS = 2000
_POS_BITS = np.uint64(31)
_POS = np.uint64((1 << 31) - 1)
_PRIME = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.uint64]:
    return [np.uint64(pow(_PRIME, i, 1 << 64)) for i in range(n)]


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i, p in enumerate(_powers(width)):
        out += h[i : i + n] * p
    return _mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


class SuperKmers:
    """Super-k-mers of many documents at once; arrays over super-k-mers."""

    def __init__(self, docs: list[list[bytes]], cache: HashCache, k: int, m: int):
        self.words = [w for d in docs for w in d]
        n = len(self.words)
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        ends = np.cumsum(lens)
        self.doc_start = ends - lens
        if n < k:
            self.start = self.n_win = self.doc = np.zeros(0, np.int64)
            self.mini = self.sig = np.zeros(0, np.uint64)
            return
        self.h = np.fromiter(map(cache.__getitem__, self.words), np.uint64, n)
        grams = _rolling(self.h, m)
        key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(key, k - m + 1) & _POS).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), lens)[: len(at)]
        ok = np.flatnonzero(np.arange(len(at)) + k <= ends[doc])
        at = at[ok]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        self.start = ok[first]
        self.n_win = np.diff(np.append(first, len(at)))
        self.doc = doc[self.start]
        self.mini = grams[at[first]]
        # a fingerprint of the packed string: the sum over its words, by position
        total = self.n_win + k - 1
        scale = np.cumprod(np.full(int(total.max()) if len(total) else 0, _PRIME, np.uint64))
        spread = np.repeat(self.start - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum()) if len(total) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(total)[:-1]]).astype(np.int64)
        offset = np.arange(len(spread)) - np.repeat(bounds, total)
        self.sig = _mix(np.add.reduceat(self.h[spread] * scale[offset], bounds)) if len(total) else np.zeros(0, np.uint64)


def _chunks(batches, text_at: int):
    """(row numbers of a batch, its documents' words), some CHUNK_WORDS at once."""
    for batch in batches:
        texts, rows, docs, n = batch.column(text_at), [], [], 0
        for i in range(batch.num_rows):
            t = texts[i].as_py()
            w = t.split() if t is not None else []
            rows.append(i)
            docs.append(w)
            n += len(w)
            if n >= CHUNK_WORDS:
                yield batch, rows, docs
                rows, docs, n = [], [], 0
        if rows:
            yield batch, rows, docs


def _hits(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, mask = block_of(_mix(x), len(table))
    return (table[at] & mask) == mask


def _count_minis(k: int, m: int):
    def run(batches):
        cache = HashCache()
        for _, _, docs in _chunks(batches, 0):
            s = SuperKmers(docs, cache, k, m)
            if len(s.mini):
                mini, inverse, n = np.unique(s.mini, return_inverse=True, return_counts=True)
                bits = np.zeros((2, len(mini)), np.uint64)
                np.bitwise_or.at(bits, (((s.sig >> np.uint64(6)) & np.uint64(1)).astype(np.int64), inverse), np.uint64(1) << (s.sig & np.uint64(63)))
                yield {"mini": mini.view(np.int64), "n": n, "low": bits[0].view(np.int64), "high": bits[1].view(np.int64)}

    return run


def _slots(blocks: int):
    """(at, mask) of each minimiser in a filter of so many blocks."""

    def run(batches):
        for b in batches:
            at, mask = block_of(_mix(b.column(0).to_numpy().view(np.uint64)), blocks)
            yield {"at": at, "mask": mask.view(np.int64)}

    return run


def _filter(minis: DataFrame, blocks: int) -> np.ndarray:
    """The Bloom filter of minimisers; a minimiser is a small hash, so it is hashed again."""
    found = produce(minis.select("mini"), _slots(blocks), "at bigint, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(blocks, np.uint64)
    table[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def _ship(shared, k: int, m: int):
    names = ("bucket", "sh", "packed", "doc_id", "th", "start", "alone")

    def rows_of(batch, rows, docs, s, pick, is_hot):
        from xxhash import xxh3_64_intdigest as digest

        ids, hashes = batch.column(1), batch.column(2)
        for j, split in zip(pick.tolist(), is_hot.tolist(), strict=True):
            a, n, d = int(s.start[j]), int(s.n_win[j]), int(s.doc[j])
            doc_id, th, from_ = ids[rows[d]].as_py(), hashes[rows[d]].as_py(), a - int(s.doc_start[d])
            for i, w in ((x, 1) for x in range(n)) if split else ((0, n),):
                packed = b" ".join(s.words[a + i : a + i + w + k - 1])
                bucket = digest(packed, 7) - (1 << 63) if split else int(s.mini[j].view(np.int64))
                yield bucket, digest(packed) - (1 << 63), packed, doc_id, th, from_ + i, split

    def run(batches):
        cache = HashCache()
        repeated, hot = shared.value
        out: list[tuple] = []
        for batch, rows, docs in _chunks(batches, 0):
            s = SuperKmers(docs, cache, k, m)
            if not len(s.mini):
                continue
            pick = np.flatnonzero(_hits(repeated, s.mini))
            for row in rows_of(batch, rows, docs, s, pick, _hits(hot, s.mini[pick])):
                out.append(row)
                if len(out) >= OUT_ROWS:
                    yield dict(zip(names, zip(*out, strict=True), strict=True))
                    out = []
        if out:
            yield dict(zip(names, zip(*out, strict=True), strict=True))

    return run


def _groups(batches, key: int):
    """Rows (tuples) of equal key, which are adjacent, across batches."""
    now, rows = None, []
    for whole in batches:
        for lo in range(0, whole.num_rows, OUT_ROWS):
            b = whole.slice(lo, OUT_ROWS)
            for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                if row[key] != now:
                    if rows:
                        yield rows
                    now, rows = row[key], []
                rows.append(row)
    if rows:
        yield rows


def _count_windows(k: int):
    """Of each distinct string of a bucket: runs (from, to) of windows that occur twice or more."""

    def run(batches):
        out: dict[str, list] = {"bucket": [], "sh": [], "runs": []}
        for rows in _groups(batches, 0):
            if len(rows) == 1:
                if rows[0][3] > 1:
                    _, sh, packed, _ = rows[0]
                    found = {0: [0, packed.count(b" ") + 2 - k]}
                else:
                    continue
            else:
                windows = []
                for r, (_, _, packed, n) in enumerate(rows):
                    words = packed.split(b" ")
                    windows += [(b" ".join(words[i : i + k]), n, r, i) for i in range(len(words) - k + 1)]
                windows.sort()
                hits: list[tuple[int, int]] = []
                lo = 0
                while lo < len(windows):
                    hi = lo + 1
                    while hi < len(windows) and windows[hi][0] == windows[lo][0]:
                        hi += 1
                    if hi - lo > 1 or windows[lo][1] > 1:
                        hits += [w[2:] for w in windows[lo:hi]]
                    lo = hi
                found = {}
                for r, i in sorted(hits):
                    runs = found.setdefault(r, [])
                    if runs and runs[-1] == i:
                        runs[-1] = i + 1
                    else:
                        runs += [i, i + 1]
            for r, runs in found.items():
                out["bucket"].append(rows[r][0])
                out["sh"].append(rows[r][1])
                out["runs"].append([{"a": a, "b": b} for a, b in zip(runs[::2], runs[1::2], strict=True)])
            if len(out["sh"]) >= OUT_ROWS:
                yield out
                out = {"bucket": [], "sh": [], "runs": []}
        if out["sh"]:
            yield out

    return run


def repeated_spans(source: DataFrame, k: int = K, m: int = M, most_blocks: int = 1 << 23) -> DataFrame:
    """(doc_id, th, spans) of source (t, doc_id, th): word spans (start, end) of documents that repeated windows cover; th stands for the text."""
    sc = source.sparkSession.sparkContext
    source = source.where("t IS NOT NULL")
    minis = produce(source.select("t"), _count_minis(k, m), "mini bigint, n bigint, low bigint, high bigint").groupBy("mini").agg(F.sum("n").alias("n"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high")).where("n > 1")
    # 126 of 128 bits set: some 600 distinct strings
    minis = materialize(minis.select("mini", (F.bit_count("low") + F.bit_count("high") >= 126).alias("hot")), "minimisers")
    hot = minis.where("hot")
    tables = tuple(_filter(x, blocks_for(x.count(), most=most_blocks) if most_blocks > 1 else 1) for x in (minis, hot))
    id_type = source.schema["doc_id"].dataType.simpleString()
    shipped = materialize(produce(source.select("t", "doc_id", "th"), _ship(sc.broadcast(tables), k, m), f"bucket bigint, sh bigint, packed binary, doc_id {id_type}, th bigint, start bigint, alone boolean"), "superkmers")
    distinct = shipped.groupBy("bucket", "sh", "packed", "alone").agg(F.count("*").alias("n"))
    alone = distinct.where("alone AND n > 1").select("bucket", "sh", F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))).alias("runs"))
    runs = produce(distinct.where("NOT alone").drop("alone").repartition("bucket").sortWithinPartitions("bucket"), _count_windows(k), "bucket bigint, sh bigint, runs array<struct<a: bigint, b: bigint>>")
    spans = (
        shipped.select("bucket", "sh", "doc_id", "th", "start")
        .join(runs.union(alone), ["bucket", "sh"])
        .select("doc_id", "th", F.transform("runs", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start") + (k - 1)).alias("b"))).alias("s"))
    )
    # a set: a row that is repeated very often gives the same spans each time
    return spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("s")).alias("spans"))


def _remove(texts, spans):
    n_words, n_removed, kept = [], [], []
    for t, s in zip(texts, spans, strict=True):
        words = t.split() if t is not None else []
        out, upto = [], 0
        for a, b in sorted((x["a"], x["b"]) for x in s or ()):
            if a > upto:
                out += words[upto:a]
            upto = max(upto, b)
        out += words[upto:]
        n_words.append(len(words))
        n_removed.append(len(words) - len(out))
        kept.append(b" ".join(out))
    return n_words, n_removed, kept, [hashlib.sha256(x).hexdigest() for x in kept]


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", most_blocks: int = 1 << 23) -> DataFrame:
    """docs with n_words, n_removed, kept_text (binary UTF-8, words joined by a space) and kept_sha256."""
    plain, new = Plain(docs), ["n_words", "n_removed", "kept_text", "kept_sha256"]
    kept = plain.kept(keep, new)
    rows = plain.df.select(*kept, F.col(plain[doc_id]).alias("doc_id"), F.col(plain[text]).cast("binary").alias("t"), F.xxhash64(plain[text]).alias("th"))
    spans = materialize(repeated_spans(rows.select("t", "doc_id", "th"), k, m, most_blocks).select(F.col("doc_id").alias("of"), F.col("th").alias("hash"), "spans"), "spans")
    # most documents repeat nothing: a filter of those with spans spares the others' texts the shuffle
    rows = probe(rows.withColumn("key", F.xxhash64("doc_id", "th")), build(spans.select(F.xxhash64("of", "hash")), blocks_for(spans.count())), "key", "maybe")
    joined = rows.where("maybe").join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("hash")), "left")
    whole = rows.where("NOT maybe").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    out = "n_words bigint, n_removed bigint, kept_text binary, kept_sha256 string"
    return plain.restore(map_rows(joined, _remove, out, ["t", "spans"], kept).unionByName(map_rows(whole, _remove, out, ["t", "spans"], kept)), new, keep)
