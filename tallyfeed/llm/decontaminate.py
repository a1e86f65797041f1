"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the words of a text (lower-cased ASCII, split at anything but
digits, letters and characters from U+0080 on). Patterns are all runs of
``window`` consecutive words of benchmark items; an item of fewer words is one
pattern. Patterns of one length form one scanner: a shift table over blocks of
two words says how far the window may be moved without missing an occurrence, a
zero shift selects a bucket by the window's last block and first word, and the
patterns in it are compared directly.

Benchmark text is broadcast in blocks of some ``BLOCK_CHARS`` characters, each a
broadcast of its own. A block's tables hold words as numbers and patterns packed
in one string, some 40 MB; a worker keeps the tables of ``KEPT`` blocks and, if
there are more, builds them anew for each ``SLICE`` documents. Documents are read once,
whatever the benchmark's size; of each block that a worker has used, its text stays in
the worker's memory (the broadcast's value), tables do not.

Nulls and texts without words have no windows: a document gets n_words 0 and is
clean, an item matches nothing. An item with a null id hits words like any other,
but has no id to be counted or listed. Repeated items and repeated rows are judged
each for itself. Empty tables: no documents give no rows, no items leave all clean. A
text of any length is matched as a whole. Input columns named like an output column (in any case) are
replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Plain, map_rows

WINDOW = 13
BLOCK_CHARS = 1_000_000
KEPT, SLICE = 4, 4000
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_KEEP).split()


class Scanner:
    """Wu-Manber tables for patterns of one length: an array of word numbers below ``unknown``, and the item of each."""

    def __init__(self, patterns: np.ndarray, item: np.ndarray, unknown: int):
        distinct, which = np.unique(patterns, axis=0, return_inverse=True)
        which = which.reshape(-1)
        m = self.m = distinct.shape[1]
        self.b, self.base = min(2, m), unknown + 1
        self.default = m - self.b + 1
        self.packed = distinct.astype("<i4").tobytes()
        # items of each distinct pattern: a range of one array
        pairs = np.unique(np.stack([which, item], axis=1), axis=0)
        self.items, self.items_from = pairs[:, 1].tolist(), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)).tolist()
        wide = distinct.astype(np.int64)
        blocks = [wide[:, end - 2] * self.base + wide[:, end - 1] if self.b == 2 else wide[:, end - 1] for end in range(self.b, m + 1)]
        every, away = np.concatenate(blocks), np.repeat(np.arange(m - self.b, -1, -1), len(distinct))
        order = np.lexsort((away, every))
        first = np.flatnonzero(np.diff(every[order], prepend=-1))
        self.shift = dict(zip(every[order][first].tolist(), away[order][first].tolist(), strict=True))
        # patterns by (last block, first word): a range of one array
        key = [a * self.base + b for a, b in zip(blocks[-1].tolist(), distinct[:, 0].tolist(), strict=True)]
        self.order = sorted(range(len(key)), key=key.__getitem__)
        self.bucket: dict[int, tuple[int, int]] = {}
        for at, p in enumerate(self.order):
            self.bucket[key[p]] = (self.bucket.get(key[p], (at, at))[0], at + 1)

    def scan(self, words: list[int]):
        """Yield (start, distinct pattern) of every occurrence in a text's word numbers."""
        m, n, get, default, base, two = self.m, len(words), self.shift.get, self.default, self.base, self.b == 2
        packed, width, text = self.packed, 4 * self.m, None
        i = m - 1
        while i < n:
            block = words[i - 1] * base + words[i] if two else words[i]
            move = get(block, default)
            if move:
                i += move
                continue
            start = i - m + 1
            if found := self.bucket.get(block * base + words[start]):
                text = text or np.array(words, "<i4").tobytes()
                own = text[4 * start : 4 * start + width]
                for at in range(*found):
                    p = self.order[at]
                    if packed[p * width : (p + 1) * width] == own:
                        yield start, p
            i += 1


class Matcher:
    """The scanners of one block of items (id, text)."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for k, (_, text) in enumerate(items):
            words = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int32)
            if len(words):
                m = min(window, len(words))
                runs = np.lib.stride_tricks.sliding_window_view(words, m)
                by_length.setdefault(m, []).append((runs, np.full(len(runs), k)))
        self.unknown = len(self.number)
        self.scanners = [Scanner(np.concatenate([r for r, _ in own]), np.concatenate([k for _, k in own]), self.unknown) for _, own in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans and item ids of a text."""
        get, unknown = self.number.get, self.unknown
        numbers = [get(w, unknown) for w in words]
        spans, found = [], set()
        for s in self.scanners:
            for start, p in s.scan(numbers):
                spans.append((start, start + s.m))
                found.update(self.ids[k] for k in s.items[s.items_from[p] : s.items_from[p + 1]])
        return spans, found - {None}


#: Matchers of this process, by name: later tasks of a worker find them built.
_BUILT: OrderedDict[str, Matcher] = OrderedDict()


def _matcher(key: str, shared, window: int) -> Matcher:
    if key not in _BUILT:
        _BUILT[key] = Matcher(shared.value, window)
        while len(_BUILT) > KEPT:
            _BUILT.popitem(last=False)
    _BUILT.move_to_end(key)
    return _BUILT[key]


def covered(spans: list[tuple[int, int]]) -> int:
    total = upto = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


OUT = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean"


def _judge(blocks: dict, window: int):
    def run(texts):
        spans, found, n_words = [[] for _ in texts], [set() for _ in texts], [0] * len(texts)
        for key, shared in blocks.items():
            matcher = _matcher(key, shared, window)
            for i, text in enumerate(texts):
                words = words_of(text)
                n_words[i] = len(words)
                s, f = matcher.find(words)
                if s:
                    spans[i] += s
                    found[i] |= f
        return [list(c) for c in zip(*map(_row, n_words, spans, found), strict=True)] or [[]] * 6

    return run


def _row(n: int, spans: list[tuple[int, int]], found) -> tuple:
    hit, items = covered(spans), sorted(found)
    return n, hit, len(items), items, hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, n_items, items (array of item ids), items_sha256 and contaminated."""
    plain, new = Plain(docs), ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
    sc = docs.sparkSession.sparkContext
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).where("t IS NOT NULL")
    size = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item", "t"), F.lit(n))
    blocks = {uuid.uuid4().hex: sc.broadcast([tuple(r) for r in bench.where(block == k).collect()]) for k in range(n)}
    done = map_rows(plain.df, _judge(blocks, window), OUT, [plain[text]], plain.kept(keep, new), SLICE_ROWS if n <= KEPT else SLICE)
    return plain.restore(done, new, keep)
