"""Streaming fold: positions kept current in keyed state, a late event refolding from the last saved position before it.

The state of an instrument (at a viewpoint, if events have several) is its book (see
``operators.book``): a map of runs of some 64 events in effective order, each with the
position before it, and one value, the position and sums after the last. A micro-batch reads the runs that its events
fall into and those after them, as far as positions change; events in order read one
run, so that a batch's time doesn't grow with the history. The state store is RocksDB,
on the executors' disks and in the checkpoint folder.

Each touched instrument gives one row: its position and sums, how many of its events
were refused, and ``refolded``, how many events the batch folded for it. Sums are text,
as they may exceed int64; where they do, ``operators.fold`` has the global rule.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.book import EMPTY, KEY, NOTHING, take
from ..operators.fold import EVENT_COLUMNS

OUT = "viewpoint bigint, instrument string, qty bigint, total_cost bigint, cash string, realized string, dividends string, reach string, refused bigint, n_events bigint, refolded bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StateRuns:
    """Runs in the keyed state of one instrument: read when asked for, written as they change."""

    def __init__(self, ends, runs):
        self.ends, self.runs = ends, runs
        found = ends.get() if ends.exists() else None
        self.n, self.events_held = (found[0], found[2]) if found else (0, 0)
        self.end = tuple(map(tuple, json.loads(found[1]))) if found else (EMPTY, NOTHING)
        self.read: dict[int, tuple] = {}

    def __len__(self) -> int:
        return self.n

    def _at(self, i: int) -> tuple:
        if i not in self.read:
            self.read[i] = self.runs.getValue((i,))
        return self.read[i]

    def low(self, i: int) -> tuple:
        row = self._at(i)
        return row[0], row[1]

    def run(self, i: int) -> tuple:
        before, events, sums = json.loads(self._at(i)[2])
        return tuple(before), [tuple(e) for e in events], tuple(sums)

    def find(self, key: tuple) -> int:
        lo, hi = 0, self.n - 1
        if self.low(hi) <= key:  # the usual case: it comes last
            return hi
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.low(mid) <= key else (lo, mid - 1)
        return lo

    def put(self, i: int, before: tuple, events: list[tuple], sums: tuple) -> None:
        self.events_held += len(events) - (self._at(i)[3] if i < self.n else 0)
        row = (*events[0][KEY], json.dumps((before, events, sums)), len(events))
        self.runs.updateValue((i,), row)
        self.read[i] = row
        self.n = max(self.n, i + 1)

    def save(self) -> None:
        self.ends.update((self.n, json.dumps(self.end), self.events_held))


class Positions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "runs bigint, end string, events bigint")
        self.runs = handle.getMapState("runs", "i bigint", "effective string, seq bigint, run string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        refolded = 0
        runs = StateRuns(self.ends, self.runs)
        for frame in rows:
            events = {(e, s): (e, s, *rest) for e, s, *rest in zip(*(frame[c].tolist() for c in ("effective", "seq", "kind", "qty", "price", "term")), strict=True)}
            refolded += take(runs, [events[k] for k in sorted(events)])
            runs.read = {}  # memory is bounded by a frame and the runs that it touches
        runs.save()
        (qty, cost), (cash, realized, dividends, reach, refused) = runs.end
        yield pd.DataFrame([(int(key[0]), key[1], qty, cost, str(cash), str(realized), str(dividends), str(reach), refused, runs.events_held, refolded)], columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def folded(stream: DataFrame) -> DataFrame:
    """A row (``OUT``) for each instrument that a micro-batch of fold events touches, in update mode."""
    # a column with nulls would come as floats, which hold no large integer
    whole = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("qty", "price", "term")]
    return stream.select(*[c for c in EVENT_COLUMNS if c not in ("qty", "price", "term")], *whole).groupBy("viewpoint", "instrument").transformWithStateInPandas(statefulProcessor=Positions(), outputStructType=OUT, outputMode="Update", timeMode="None")


def start_folded(stream: DataFrame, checkpoint: str, book_path: str):
    """Keep the book at ``book_path`` (a folder per batch, see ``positions.latest_positions``) current with a stream of fold events."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{book_path}/batch={batch_id:012d}")

    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:  # a query keeps the settings that it was started with
        return folded(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
