"""Source divergence audit: how the sources of a language differ in their terms, from joint count histograms.

Terms are runs of letters (ASCII letters in lower case, and all characters beyond
ASCII). Each language keeps the terms that occur in at least ``min_docs`` of its
documents. In a group (language, source), or a whole language, a kept term with
``count`` occurrences among N of all V kept terms has
``p = 1 + floor(10^9 * (count + 2) / (N + 2 V))``; two such values differ by
``f = floor((p - q)^2 / (p + q))``.

- part ``pair``: f summed over all kept terms, for each other source of the language.
- part ``term``: the terms of a group whose p exceeds the language's q, the top ten.

f depends on the two counts alone, so a pair of groups is its joint histogram of
(count, count) cells. Terms that both hold are tallied in the tasks that hold the
terms' counts, as cells with their multiplicity; cells with a zero follow from each
group's own histogram less the tallied cells, the cell of two zeros from V. f is
evaluated once per cell. A sum of f stays below 2*10^9 + 2 V, so bigint holds it.

Texts are counted where they lie, and what leaves a task is a row per (group,
term): a source that holds a third of all rows costs no task more than another.
A term's counts, one per source, are what meets in one task. The pairs of sources
are the result: as many rows as it has.

Defined cases: null text, lang and source are empty strings, and an empty string is
a language or source like others; repeated rows are documents of their own; a
language without kept terms has pairs of value 0; a language with one source has no
pairs; an empty table gives no rows; long texts are read in pieces; other columns,
of any name, are ignored. Ties rank by item in order of UTF-8.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Plain, materialize, produce

#: What a term's UTF-8 bytes become: ASCII letters in lower case, bytes beyond ASCII as they are, all others a space.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE, PRIOR = 10**9, 2
#: Distinct (group, term) counts, and distinct cells, that a task holds before it hands them on: some 120 bytes each.
HELD = 1_000_000
#: Bytes of a text that are words at once.
PIECE = 1 << 20
#: (group, term) rows that are paired at once.
ROWS_AT_ONCE = 1 << 16


def pieces(text: bytes):
    """The text, cut between terms into parts of about ``PIECE`` bytes."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = text.find(b" ", lo + PIECE)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:] if lo else text


def _count(batches):
    # (lang, source) -> term -> occurrences, and documents times 2^40
    counts: dict[tuple, dict[bytes, int]] = defaultdict(dict)
    held = rows = size = 0

    def flush():
        for (lang, source), of in counts.items():
            terms, packed = list(of), np.fromiter(of.values(), np.int64, len(of))
            for lo in range(0, len(terms), 50_000):
                part, n = terms[lo : lo + 50_000], packed[lo : lo + 50_000]
                yield {"lang": [lang] * len(part), "source": [source] * len(part), "term": pa.array(part, pa.binary()).cast(pa.string()), "n": n & ((1 << 40) - 1), "docs": n >> 40}
        counts.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            own = Counter()
            for part in pieces(text.as_py().translate(TERM_BYTES)):
                own.update(part.split())
            of = counts[lang, source]
            held -= len(of)
            get = of.get
            for term, n in own.items():
                of[term] = get(term, 0) + n + (1 << 40)
            held, rows, size = held + len(of), rows + 1, size + len(text.as_py())
            if held >= HELD or rows >> 22 or size >> 39:  # so that the packed numbers hold what they must
                yield from flush()
                held = rows = size = 0
    yield from flush()


def count_terms(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(groups, counts): every (lang, source); and its terms with n, their occurrences, and docs, the documents that hold them."""
    plain = Plain(documents)
    rows = plain.df.select(*[F.coalesce(F.col(plain[c]).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = produce(rows, _count, "lang string, source string, term string, n bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return rows.select("lang", "source").distinct(), counts


def _cells(batches):
    """Rows (lang, term, source, n) sorted so, whole terms in a task, to tallies (lang, a, b, x, y, m) of pairs of sources a < b."""
    held: list[tuple] = []
    names: dict[str, int] = {}
    tally: np.ndarray = np.empty((0, 6), np.int64)

    def number(x: str) -> int:
        return names.setdefault(x, len(names))

    def summed(rows):
        """Rows (lang, a, b, x, y, m) with m summed over equal cells."""
        if not len(rows):
            return rows
        rows = rows[np.lexsort(rows[:, :5].T)]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :5] != rows[:-1, :5]).any(axis=1)]))
        return np.column_stack([rows[first, :5], np.add.reduceat(rows[:, 5], first)])

    def pair(rows):
        """All pairs of rows of one term, an offset at a time, as tallies."""
        lang, term, source, n = (np.array(x) for x in zip(*rows, strict=True))
        for k in range(1, len(rows)):
            same = term[k:] == term[:-k]
            if not same.any():
                break
            i = np.flatnonzero(same)
            yield np.column_stack([lang[i], source[i], source[i + k], n[i], n[i + k], np.ones(len(i), np.int64)])

    def out(tally):
        told = np.array(list(names), object)
        for lo in range(0, len(tally), 50_000):
            lang, a, b, x, y, m = tally[lo : lo + 50_000].T
            yield {"lang": told[lang].tolist(), "a": told[a].tolist(), "b": told[b].tolist(), "x": x, "y": y, "m": m}

    open_term, serial = None, 0
    for batch in batches:
        for lang, term, source, n in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if (lang, term) != open_term:
                open_term, serial = (lang, term), serial + 1
                if len(held) >= ROWS_AT_ONCE:
                    tally, held = summed(np.concatenate([tally, *map(summed, pair(held))])), []
                    if len(tally) >= HELD:
                        yield from out(tally)
                        tally = tally[:0]
            held.append((number(lang), serial, number(source), n))
    if held:
        tally = np.concatenate([tally, *map(summed, pair(held))])
    if len(tally):
        yield from out(summed(tally))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count: exact, in decimal(38,0)."""
    wide = lambda c: c.cast("decimal(28,0)")
    return 1 + F.call_function("div", wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * kept).cast("decimal(38,0)"))


def differ(p: Column, q: Column) -> Column:
    """f of two values of at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(documents: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module."""
    groups, counts = count_terms(documents, text, lang, source)
    groups, counts = materialize(groups, "divergence-groups"), materialize(counts, "divergence-counts")
    # the language's own counts, of the terms it keeps
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    held = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "divergence-held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # one row a group: its N, its language's V and N
    about = materialize(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"]), "divergence-groups")

    one = lambda name: about.select("lang", F.col("source").alias(name), F.col("total").alias(f"total_{name}"), "v")
    pairs = materialize(one("a").join(one("b").drop("v"), "lang").where(F.col("a") < F.col("b")), "divergence-pairs")
    both = materialize(produce(held.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source"), _cells, "lang string, a string, b string, x bigint, y bigint, m bigint").groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")), "divergence-cells")
    own = held.groupBy("lang", "source", F.col("n").alias("x")).agg(F.count("*").alias("m"))
    none = F.lit(0).cast("bigint")
    of = lambda side, x, y: pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", side), ["lang", side]).select("lang", "a", "b", x.alias("x"), y.alias("y"), "m")
    minus = lambda x, y: both.select("lang", "a", "b", x.alias("x"), y.alias("y"), (-F.col("m")).alias("m"))
    x, y = F.col("x"), F.col("y")
    # (x, 0): what a holds so often, less where b holds it too; (0, 0): V less what either holds
    zeros = of("a", x, none).unionByName(minus(x, none)).unionByName(of("b", none, x)).unionByName(minus(none, y))
    zeros = materialize(zeros.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m <> 0"), "divergence-zeros")
    some = both.unionByName(zeros)
    rest = some.groupBy("lang", "a", "b").agg(F.sum("m").alias("some"))
    blank = pairs.join(rest, ["lang", "a", "b"], "left").select("lang", "a", "b", none.alias("x"), none.alias("y"), (F.col("v") - F.coalesce("some", none)).alias("m"))
    cells = some.unionByName(blank).join(pairs, ["lang", "a", "b"])
    f = F.when(F.col("v") > 0, differ(share(x, F.col("total_a"), F.col("v")), share(y, F.col("total_b"), F.col("v"))) * F.col("m")).otherwise(none)
    # f is the same from either side
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    turned = cells.groupBy("lang", "a", "b").agg(F.sum(f).alias("value")).select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    terms = held.join(about, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value"))
    # the top of each slice of a group's terms first, so that no group's terms meet in one task
    slice_order = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("r", F.row_number().over(slice_order)).where(F.col("r") <= top).drop("r")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")
    return columns(ranked(turned), "pair").unionByName(columns(ranked(terms).where(F.col("rank") <= top), "term"))
