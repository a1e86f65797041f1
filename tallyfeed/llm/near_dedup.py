"""Near-dedup by a chosen-path set similarity join.

Documents are sets of hashed word shingles. Documents with equal sets form a
class and only classes are joined, so exact copies cost nothing.

1. Trees. The join is a set of independent trees over the classes. A node holds
   the classes that share the minwise tokens chosen on the path to it: a class
   goes to one child for each minhash position that the node chooses (two in the
   first ``FORKED`` levels, then one or two, by the node's own hash), keyed by its
   minimum there. A node of one class is dropped, one of at most ``LEAF`` classes
   is a leaf, a larger one branches again. Sets of similarity s share a chosen
   minimum with probability s, so ``together`` gives the probability that a pair
   of the threshold's similarity stays in a common node down to the deepest level,
   and ``trees_for`` the number of trees that would miss it with probability 1e-4 at
   most there, were all choices independent (4 trees at 0.85, 6 at 0.80). They are not
   quite: all trees choose among the same ``HASHES`` minima, and a pair with few equal
   ones is unlucky in all trees. Simulated with that, the deepest level misses 1.5e-3
   at 0.85 and 3.5e-3 at 0.80, the usual shallow leaves far less; the tests measure a
   recall of 0.99 or more at either threshold with nothing but branching.
2. Leaves are compared exhaustively. Sizes and the number of agreeing minima rule
   pairs out (the latter loses a pair with probability 1e-7); what remains
   connected is a cluster, which leaves that find it share. Every pair of a cluster
   that is not yet connected is decided on the full sets, which travel as compressed
   texts, of documents in question only (a Bloom filter picks them).
3. Dense nodes. A node that keeps ``DENSE`` of its parent's classes holds near
   copies that branching doesn't part, as does one at ``MAX_DEPTH``. Its classes are
   joined exactly instead: sets of similarity t share one of their n - ceil(t n) + 1
   rarest shingles. Only components matter, so first each class is compared with one
   pivot (of those sharing such a shingle, the class where it comes earliest: the
   original of edited copies), then with the pivots of all its rare shingles, and
   last, inside each shingle's group, classes outside the group's main component
   with all others, in pairs of blocks of bounded size.

Components of the links come from repeated minimum exchange with pointer jumping,
written out between rounds.

Null and blank texts have no words and no set: they are linked with nothing. A
text of fewer words than a shingle is one shingle. Repeated rows are copies. A text of
any length is one set, held whole by the task that describes or compares it; an empty
table gives no rows.
doc_id identifies a document; rows with a null doc_id take part, and get a null
component_id unless a document with an id is in their component; where there is
none, all are kept. Rows that repeat a kept doc_id are kept too. Input columns named
like an output column (in any case) are replaced.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import block_of, blocks_for, build
from .common import SLICE_ROWS, HashCache, Plain, map_rows, materialize, produce, sum_blocks
from .substring_dedup import _mix, _powers

HASHES = 64
LEAF, MAX_DEPTH, FORKED = 128, 12, 3
DENSE = 0.6
#: Largest probability to miss a pair of the threshold's similarity at the deepest level, and by its minima.
MISS, MISS_BY_MINIMA = 1e-4, 1e-7
#: Classes of a shingle's group that one task compares with as many others.
BLOCK = 512
CELLS, TALLY_BLOCKS = 1 << 16, 8
_NO_ID = 1 << 62


def together(s: float, depth: int = MAX_DEPTH) -> float:
    """Probability that a pair of similarity s shares a node of a tree at each level down to ``depth``."""
    p = 1.0
    for level in range(depth, 0, -1):
        two = 2 * s * p - (s * p) ** 2
        p = two if level <= FORKED else (2 * s * p + two) / 3
    return p


def trees_for(s: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log1p(-together(s)))) if s < 1 else 1


def least_agreement(s: float) -> int:
    """Agreeing minima below which a pair of similarity s falls with probability MISS_BY_MINIMA at most."""
    below = 0.0
    for n in range(HASHES + 1):
        below += math.comb(HASHES, n) * s**n * (1 - s) ** (HASHES - n)
        if below > MISS_BY_MINIMA:
            return n
    return HASHES


# ---- sets and signatures --------------------------------------------------------


def shingle_set(words: list[bytes], k: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words (of all words, if fewer)."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        return _mix((h * np.array(_powers(len(h)), np.uint64)).sum(dtype=np.uint64)[None] + np.uint64(len(h)))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i, p in enumerate(_powers(k)):
        out += h[i : i + n] * p
    return np.unique(_mix(out))


def signature(s: np.ndarray, n: int = HASHES) -> np.ndarray:
    """n minima (upper 31 bits) of the set under hash functions of the form a * x + b."""
    a, b = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, n, 1) | np.uint64(1)
    low = np.full((n, 1), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, (a * s[None, i : i + 1024] + b).min(axis=1, keepdims=True))
    return (low[:, 0] >> np.uint64(33)).astype(np.int32)


def _words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text is not None else []


def _class_key(s: np.ndarray) -> bytes:
    a, b = int(_mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(_mix(s + np.uint64(1))))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def _describe(k: int):
    cache: list = []

    def run(texts):
        if not cache:
            cache.append(HashCache())
        keys, sizes, sigs = [], [], []
        for t in texts:
            s = shingle_set(_words(t), k, cache[0])
            sizes.append(len(s))
            keys.append(_class_key(s) if len(s) else None)
            sigs.append(signature(s) if len(s) else None)
        return keys, sizes, sigs

    return run


# ---- trees ------------------------------------------------------------------------


def _children(sig: Column, node: Column, depth: int) -> Column:
    """Keys of a class's children at a node, which chooses the minhash positions."""

    def child(j):
        return F.xxhash64(node, F.lit(j), F.get(sig, F.pmod(F.xxhash64(node, F.lit(j)), F.lit(HASHES)).cast("int")))

    if depth <= FORKED:
        return F.array(child(0), child(1))
    return F.when(F.pmod(F.xxhash64(node, F.lit("fork")), F.lit(3)) == 0, F.array(child(0), child(1))).otherwise(F.array(child(0)))


def tree_nodes(heads: DataFrame, trees: int, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """((node, id): the leaves of all trees, of 2 to ``leaf`` classes; (id): classes of dense nodes) of heads (id, sig)."""
    # the roots choose distinct positions
    roots = F.array(*[F.xxhash64(F.lit("root"), F.lit(i), F.get("sig", F.lit(i % HASHES))) for i in range(2 * trees)])
    rows = heads.select("id", F.explode(roots).alias("node"), F.lit(None).cast("bigint").alias("of"))
    leaves, dense = [], []
    for depth in range(1, MAX_DEPTH + 1):
        if depth > 1:
            rows = materialize(rows, "paths")
        sizes = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        alive = materialize(rows.join(sizes, "node"), "nodes")
        leaves.append(alive.where(F.col("n") <= leaf).select("node", "id"))
        large = alive.where(F.col("n") > leaf)
        stuck = F.lit(True) if depth == MAX_DEPTH else F.coalesce(F.col("n") >= DENSE * F.col("of"), F.lit(False))
        dense.append(large.where(stuck).select("id"))
        large = large.where(~stuck)
        if depth == MAX_DEPTH or large.isEmpty():
            break
        if depth == 1:  # all that are in large nodes later are in one now
            heads = materialize(heads.select("id", "sig").join(large.select("id").distinct(), "id", "left_semi"), "large")
        rows = large.join(heads, "id").select("id", F.explode(_children(F.col("sig"), F.col("node"), depth + 1)).alias("node"), F.col("n").alias("of"))
    return reduce(DataFrame.union, leaves), reduce(DataFrame.union, dense).distinct()


# ---- leaves -------------------------------------------------------------------------


def _groups(batches):
    """Rows of equal first column, which are adjacent, if there are two or more."""
    now, rows = None, []
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            for row in zip(*[part.column(i).to_pylist() for i in range(part.num_columns)], strict=True):
                if row[0] != now:
                    if len(rows) > 1:
                        yield rows
                    now, rows = row[0], []
                rows.append(row)
    if len(rows) > 1:
        yield rows


def _near(rows, num: int, den: int, least: int):
    """(agreeing minima, pairs i < j) of rows (_, id, size, sig, ...) that sizes and minima don't rule out as links."""
    size, sig = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int32)
    same = np.zeros((len(rows), len(rows)), np.int16)
    for c in range(HASHES):
        same += sig[:, None, c] == sig[None, :, c]
    return same, np.nonzero(np.triu((same >= least) & (np.minimum(size[:, None], size) * den >= num * np.maximum(size[:, None], size)), 1))


class _Sets:
    """Union-find."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


def _emit(pairs, names):
    out: tuple[list, list] = [], []
    for x, y in pairs:
        out[0].append(x)
        out[1].append(y)
        if len(out[0]) >= 5000:
            yield dict(zip(names, out, strict=True))
            out = [], []
    if out[0]:
        yield dict(zip(names, out, strict=True))


def _clusters(num: int, den: int):
    """(cluster, id): the members of a leaf that may be linked, directly or through others. A cluster is known by its members, so that leaves with the same ones give the same cluster."""
    least = least_agreement(num / den)

    def pairs(batches):
        from xxhash import xxh3_64_intdigest as digest

        for rows in _groups(batches):
            _, (a, b) = _near(rows, num, den, least)
            sets = _Sets(len(rows))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                sets.join(i, j)
            members: dict[int, list[int]] = {}
            for i in set(a.tolist()) | set(b.tolist()):
                members.setdefault(sets.find(i), []).append(rows[i][1])
            for ids in members.values():
                key = digest(np.sort(np.array(ids, np.int64)).tobytes()) - (1 << 63)
                for i in ids:
                    yield key, i

    return lambda batches: _emit(pairs(batches), ("cluster", "id"))


def _compare(k: int, num: int, den: int):
    """Links (a, b): a class and the smallest class it is connected with inside a cluster, by pairs with den * intersection >= num * union."""
    least = least_agreement(num / den)

    def pairs(batches):
        cache = HashCache()
        for rows in _groups(batches):
            full: list = [None] * len(rows)
            same, (a, b) = _near(rows, num, den, least)
            order = np.argsort(-same[a, b], kind="stable")
            sets = _Sets(len(rows))
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                if sets.find(i) == sets.find(j):
                    continue
                for x in (i, j):
                    if full[x] is None:
                        full[x] = frozenset(shingle_set(zlib.decompress(rows[x][4]).split(), k, cache).tolist())
                both = len(full[i] & full[j])
                if den * both >= num * (len(full[i]) + len(full[j]) - both):
                    sets.join(i, j)
            low: dict[int, int] = {}
            for i, row in enumerate(rows):
                r = sets.find(i)
                low[r] = min(row[1], low.get(r, row[1]))
            for i, row in enumerate(rows):
                if row[1] != low[sets.find(i)]:
                    yield row[1], low[sets.find(i)]

    return lambda batches: _emit(pairs(batches), ("a", "b"))


# ---- texts of the classes in question ------------------------------------------------


def _pack_hits(shared):
    """Compressed words of the documents whose hash the filter may hold."""

    def run(batches):
        for b in batches:
            hash_, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            at, mask = block_of(hash_.view(np.uint64), len(shared.value))
            hits = np.flatnonzero((shared.value[at] & mask) == mask)
            for lo in range(0, len(hits), 500):
                some = hits[lo : lo + 500]
                yield {"hk": hash_[some], "th": th[some], "blob": [zlib.compress(b" ".join(_words(b.column(2)[i].as_py())), 1) for i in some.tolist()]}

    return run


def _texts(source: DataFrame, used: DataFrame) -> DataFrame:
    """(id, blob) of the classes in used (id, hk, th)."""
    shared = source.sparkSession.sparkContext.broadcast(build(used.select("hk"), blocks_for(used.count())))
    texts = produce(source.select("hk", "th", "t"), _pack_hits(shared), "hk bigint, th bigint, blob binary").dropDuplicates(["hk", "th"])
    return used.join(texts, ["hk", "th"]).drop("hk", "th")


# ---- components -------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for ids in links (a, b)."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    while True:
        # each id takes the least label around it, then the label of that id's own least label
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = materialize(labels.join(near, "a").select("a", F.least("l", "m").alias("m"), "l"), "step")
        jump = step.select(F.col("a").alias("m"), F.col("m").alias("j"))
        new = materialize(step.join(jump, "m").select("a", F.col("j").alias("l"), (F.col("j") != F.col("l")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select(F.col("a").alias("id"), F.col("l").alias("component"))
        labels = new.select("a", "l")


# ---- the exact join of dense classes ---------------------------------------------------------


def _sets_of(batches, k: int):
    """(id, set) of rows (id, blob)."""
    cache = HashCache()
    for b in batches:
        for lo in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(lo, SLICE_ROWS)
            for i, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                yield i, shingle_set(zlib.decompress(blob).split(), k, cache)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(CELLS - 1)).astype(np.int64)


def _tally(k: int):
    """(block, data): how many shingles fall into each cell, as compressed arrays of a task's counts."""

    def run(batches):
        cells, some = np.zeros(CELLS, np.int64), False
        for _, s in _sets_of(batches, k):
            some = True
            np.add.at(cells, _cell(s), 1)
        if some:
            parts = cells.reshape(TALLY_BLOCKS, -1)
            yield {"block": list(range(TALLY_BLOCKS)), "data": [zlib.compress(x.astype("<i8").tobytes(), 1) for x in parts]}

    return run


def _prefixes(k: int, num: int, den: int, shared):
    """(token, id, n, rest): a set's rarest shingles, with its size and the number of shingles after each."""
    names = ("token", "id", "n", "rest")

    def run(batches):
        out, rows = [], 0
        for i, s in _sets_of(batches, k):
            n = len(s)
            p = n - -(-num * n // den) + 1
            first = s[np.argsort(shared.value[_cell(s)], kind="stable")[:p]]
            out.append((first.view(np.int64), np.full(p, i, np.int64), np.full(p, n, np.int64), np.arange(n - 1, n - 1 - p, -1, dtype=np.int64)))
            rows += p
            if rows >= 20000:
                yield dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))
                out, rows = [], 0
        if out:
            yield dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))

    return run


def _prefix_rows(texts: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """(token, id, n, rest): prefix shingles that several classes have. Any order of shingles is right, rare first is fast; it comes from counts in CELLS cells."""
    out = "block int, data binary"
    parts = produce(texts, _tally(k), out).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    halves = produce(parts.repartition("block", "salt").select("block", "data"), sum_blocks, out)
    cells = np.zeros((TALLY_BLOCKS, CELLS // TALLY_BLOCKS), np.int64)
    for r in produce(halves.repartition("block"), sum_blocks, out).collect():  # a row per block and task: CELLS numbers
        cells[r["block"]] += np.frombuffer(zlib.decompress(r["data"]), "<i8")
    shared = texts.sparkSession.sparkContext.broadcast(cells.reshape(-1))
    rows = materialize(produce(texts, _prefixes(k, *threshold, shared), "token bigint, id bigint, n bigint, rest bigint"), "prefixes")
    several = rows.groupBy("token").agg(F.count("*").alias("of")).where("of > 1")
    return materialize(rows.join(several.select("token"), "token"), "prefixes")


def _apart(rows: DataFrame) -> DataFrame:
    """rows (token, component, ...) of tokens that classes of several components have, with ``of``, the number of their rows, and ``main``, a frequent component."""
    tokens = rows.groupBy("token").agg(F.min("component").alias("main"), F.max("component").alias("high"), F.count("*").alias("of")).where("main < high").drop("high")
    return rows.join(tokens, "token")


def _pivot_pairs(rows: DataFrame, threshold: tuple[int, int], single: bool) -> DataFrame:
    """Pairs (a, b): b with the pivots a of its prefix shingles, or with one of them."""
    num, den = threshold
    first = F.max(F.struct((F.col("rest") / F.col("n")).alias("early"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("rest").alias("after"), F.col("component").alias("at")))
    pivots = rows.groupBy("token").agg(first.alias("pivot"))
    found = rows.join(pivots, "token").select("id", "n", "rest", "component", "pivot.*").where("component != at")
    most = 1 + F.least("rest", "after")
    found = found.where((den * most >= num * (F.col("n") + F.col("m") - most)) & (den * F.least("n", "m") >= num * F.greatest("n", "m")))
    if single:
        return found.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("early", "a")).alias("p")).select("p.a", "b")
    return found.select("a", F.col("id").alias("b")).distinct()


def _candidates(num: int, den: int):
    """Pairs (a, b) of different components that sizes and the shingle's places don't rule out. Rows: key, id, n, rest, component, main, own, cross."""

    def pairs(batches):
        for rows in _groups(batches):
            _, ids, size, rest, component, main, own, cross = (np.array(x) for x in zip(*rows, strict=True))
            # classes of the main component are known to be connected: only the others look for links
            for i in np.flatnonzero(component != main):
                both = size[i] + size
                most = 1 + np.minimum(rest[i], rest)
                fits = (component[i] != component) & (den * most >= num * (both - most))
                fits &= np.minimum(size[i], size) * den >= num * np.maximum(size[i], size)
                fits[:i] &= component[:i] == main[:i]
                if cross[i]:
                    fits &= own[i] != own
                for j in ids[fits].tolist():
                    yield min(int(ids[i]), j), max(int(ids[i]), j)

    return lambda batches: _emit(pairs(batches), ("a", "b"))


def _other_pairs(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs (a, b) that may be links, of classes in different components; rows as of ``_apart``."""
    blocks = F.ceil(F.col("of") / BLOCK)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    # a block meets itself where own = other
    rows = rows.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "n", "rest", "component", "main", "own", (F.col("own") != F.col("other")).alias("cross"))
    return produce(rows.repartition("key").sortWithinPartitions("key"), _candidates(*threshold), "a bigint, b bigint").distinct()


def _verify(k: int, num: int, den: int):
    """Links (a, b) among a part's first class and its others, by their full sets."""

    def pairs(batches):
        cache = HashCache()
        for rows in _groups(batches):
            full = lambda blob: frozenset(shingle_set(zlib.decompress(blob).split(), k, cache).tolist())
            first = [(r[1], full(r[3])) for r in rows if r[2]]
            for _, b, is_first, blob in rows:
                other = frozenset() if is_first else full(blob)
                for a, own in first:
                    both = len(own & other)
                    if both and den * both >= num * (len(own) + len(other) - both):
                        yield a, b

    return lambda batches: _emit(pairs(batches), ("a", "b"))


def _decide(texts: DataFrame, pairs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are links: a class meets at most some 256 others in a task."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("parts"))
    pairs = pairs.join(parts, "a").withColumn("part", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))))
    members = pairs.select("part", F.col("a").alias("id"), F.lit(True).alias("first")).distinct().union(pairs.select("part", F.col("b").alias("id"), F.lit(False).alias("first")))
    full = members.join(texts, "id").select("part", "id", "first", "blob")
    return materialize(produce(full.repartition("part").sortWithinPartitions("part"), _verify(k, *threshold), "a bigint, b bigint"), "links")


def dense_links(texts: DataFrame, links: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """links (a, b), with those that connect the classes of texts (id, blob) as comparing all of their pairs would."""
    rows = _prefix_rows(texts, k, threshold)
    for find in (lambda r: _pivot_pairs(r, threshold, True), lambda r: _pivot_pairs(r, threshold, False), lambda r: _other_pairs(r, threshold)):
        label = components(links)
        now = materialize(_apart(rows.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))), "apart")
        pairs = materialize(find(now), "pairs")
        if not pairs.isEmpty():
            links = links.union(_decide(texts, pairs, k, threshold))
    return links


# ---- the operator ------------------------------------------------------------------------------


def _links(source: DataFrame, heads: DataFrame, k: int, threshold: tuple[int, int], leaf: int) -> DataFrame:
    """Links (a, b) that connect the classes."""
    signed = ["id", "n_shingles", "sig"]
    leaves, dense = tree_nodes(heads.select("id", "sig"), trees_for(threshold[0] / threshold[1]), leaf)
    members = leaves.join(heads.select(*signed), "id").select("node", *signed)
    clusters = materialize(produce(members.repartition("node").sortWithinPartitions("node"), _clusters(*threshold), "cluster bigint, id bigint").distinct(), "clusters")
    dense = materialize(dense, "dense")
    used = materialize(heads.select("id", "hk", "th").join(clusters.select("id").union(dense).distinct(), "id", "left_semi"), "used")
    texts = materialize(_texts(source, used), "texts")
    full = clusters.join(heads.select(*signed), "id").join(texts, "id").select("cluster", *signed, "blob")
    links = materialize(produce(full.repartition("cluster").sortWithinPartitions("cluster"), _compare(k, *threshold), "a bigint, b bigint").distinct(), "links")
    if dense.isEmpty():
        return links
    return dense_links(materialize(texts.join(dense, "id", "left_semi"), "dense-texts"), links, k, threshold)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """docs with n_shingles (set size), component_id (smallest doc_id reachable) and kept (doc_id is component_id).

    Documents are linked if threshold[1] * intersection >= threshold[0] * union.
    """
    plain = Plain(docs)
    t, i = plain[text], plain[doc_id]
    source = plain.df.select(F.col(i).alias("doc_id"), F.xxhash64(i, F.xxhash64(t)).alias("hk"), F.xxhash64(t).alias("th"), F.col(t).cast("binary").alias("t"))
    described = materialize(map_rows(source, _describe(k), "c binary, n_shingles bigint, sig array<int>", ["t"], ["doc_id", "hk", "th"]), "sets")
    some_id = F.coalesce("doc_id", F.lit(_NO_ID) + F.pmod(F.xxhash64("c"), F.lit(_NO_ID)))
    # a class is known by its smallest id; the row of that id stands for it
    heads = described.where("c IS NOT NULL").groupBy("c").agg(F.min(F.struct(some_id.alias("id"), "hk", "th", "n_shingles", "sig")).alias("h"))
    heads = materialize(heads.select("c", "h.*"), "heads")
    found = components(_links(source, heads, k, threshold, leaf))
    labels = heads.select("c", "id").join(found, "id", "left").select("c", F.coalesce("component", "id").alias("component"))
    # every document gets its class's component; a text without words is its own
    by_doc = described.select("doc_id", "th", "c", "n_shingles").join(labels, "c", "left").select("doc_id", "th", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).when(F.col("component") < _NO_ID, F.col("component")).alias("component_id"))
    by_doc = by_doc.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    new = ["n_shingles", "component_id", "kept"]
    if keep == [doc_id]:
        return by_doc.select(F.col("doc_id").alias(doc_id), *new)
    by_doc = by_doc.dropDuplicates(["doc_id", "th"]).withColumnRenamed("doc_id", "d")
    rows = plain.df.select(*plain.kept(keep, new), F.col(i).alias("key"), F.xxhash64(t).alias("hash"))
    return plain.restore(rows.join(by_doc, F.col("key").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("th"))), new, keep)
