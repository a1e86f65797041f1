"""Order-preserving packing of documents into token windows.

Documents are encoded and laid end to end, in input order within a partition, as
one stream of ids. A dynamic programme chooses the cuts: over the positions where
a cut is allowed (document ends, sentence ends, and fixed steps inside longer
runs without either) it minimises padding plus a penalty for each cut that
splits a document, larger where the cut falls inside a sentence. A window costs
``size - length`` padding plus the cut's penalty, so the best predecessor of a
position is the smallest ``cost + position`` among those at most ``size``
tokens before it, which a monotone queue keeps at constant cost a step. What
remains at the end of a partition's stream is laid out in power-of-two lengths,
which are not padded. Memory: ids and positions of ``FLUSH`` tokens; the
programme continues over a flush at the last window but one.

A null or empty text is the end id alone. Ids fall in exactly one piece each;
pieces of a window are gapless from offset 0. Repeated rows are packed each for itself.
A text of any length is one stream of ids, encoded as a whole by its task. An empty
table gives no rows.
Input columns of the output's names (in any case) are replaced.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Plain, arrow_schema
from .tokens import Encoder

SIZE, END_ID = 4096, 2
SENTENCE_COST, STEP_COST, STEP = 2, 24, 64
FLUSH = 1_000_000


def choose_cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Cut positions (some of ``at``, its last included) of least padding plus penalties.

    ``at`` rises from above 0 in steps of at most ``size``; ``cost[i]`` is the penalty of a cut at
    ``at[i]``. The last window's padding does not count.
    """
    n = len(at)
    pos, pen = [0, *at.tolist()], [0, *cost.tolist()]
    back, key = [0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque([0])
    for j in range(1, n + 1):
        p = pos[j]
        while p - pos[queue[0]] > size:
            queue.popleft()
        # the last window ends the stream: its padding is not a choice, so only what came before counts
        back[j] = i = queue[0] if j < n else min(queue, key=lambda i: key[i] - pos[i])
        # least cost of cuts up to p, plus p: the part of a later window's cost that depends on its start
        key[j] = k = key[i] + size + pen[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def tail_lengths(n: int, size: int) -> list[int]:
    """n as powers of two of at most size, largest first: sequences that need no padding."""
    return [size] * (n // size) + [1 << b for b in range(n % size, -1, -1) if b < 63 and n % size >> b & 1]


class Packer:
    """Windows of one partition's stream; yields pieces (row, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, sentence_end: np.ndarray, size: int):
        self.sentence_end, self.size = sentence_end, size
        self.docs: list[list] = []  # row, ids, ids already placed
        self.n = self.sequence = 0

    def add(self, row, ids: np.ndarray):
        self.docs.append([row, ids, 0])
        self.n += len(ids)
        if self.n >= FLUSH:
            yield from self.flush(False)

    def flush(self, last: bool):
        if not self.n:
            return
        ends = np.cumsum([len(ids) - done for _, ids, done in self.docs])
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        cost = np.full(self.n + 1, -1, np.int32)
        cost[np.flatnonzero(self.sentence_end[stream]) + 1] = SENTENCE_COST
        cost[ends] = 0
        at = np.flatnonzero(cost[1:] >= 0) + 1
        gaps = np.diff(at, prepend=0)
        step = min(STEP, self.size)
        for i in np.flatnonzero(gaps > step):
            cost[np.arange(at[i] - gaps[i] + step, at[i], step)] = STEP_COST
        at = np.flatnonzero(cost[1:] >= 0) + 1
        cuts = choose_cuts(at, cost[at], self.size)
        if last:
            done = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + np.add.accumulate([done, *tail_lengths(cuts[-1] - done, self.size)]).tolist()[1:]
        else:
            cuts = cuts[:-2]
        i = begin = 0
        for cut in cuts:
            offset = 0
            while begin < cut:
                row, ids, done = self.docs[i]
                n = min(len(ids) - done, cut - begin)
                yield row, done, ids[done : done + n], len(ids), self.sequence, offset
                begin, offset = begin + n, offset + n
                self.docs[i][2] += n
                if done + n == len(ids):
                    i += 1
            self.sequence += 1
        self.docs, self.n = self.docs[i:], self.n - begin


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, keep: list[str] | None = None, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pieces of documents: the kept columns, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    fields = T.StructType.fromDDL("start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    plain = Plain(docs)
    kept = plain.kept(keep, fields.names)
    source = plain.df.select(*kept, F.col(plain[text]).alias("t"))
    out = T.StructType(source.schema.fields[:-1] + fields.fields)
    arrow = arrow_schema(out)

    def run(batches):
        import re

        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        vocab = encoder.tokenizer.get_vocab()
        sentence_end = np.zeros(max(vocab.values()) + 1, bool)
        sentence_end[[i for t, i in vocab.items() if re.fullmatch(r"[^\w<]*[.!?][^\w<]*(</w>)", t)]] = True
        packer, first = Packer(sentence_end, size), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")

        def batch(pieces):
            cols = [[p[0][i] for p in pieces] for i in range(len(kept))]
            cols += [[p[1] for p in pieces], [len(p[2]) for p in pieces], [p[2].tobytes() for p in pieces], [p[3] for p in pieces], [first + p[4] for p in pieces], [p[5] for p in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in cols]
                if pieces := list(packer.add(row[:-1], np.concatenate([np.frombuffer(encoder.encode(row[-1]), "<u4"), end]))):
                    yield batch(pieces)
        if pieces := list(packer.flush(True)):
            yield batch(pieces)

    return plain.restore(source.mapInArrow(run, out), fields.names, keep)
