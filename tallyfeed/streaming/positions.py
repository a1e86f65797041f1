"""Streaming: a feed's arriving events keep positions current.

An event that arrives late (by effective date) or an amendment restates history.
``streaming.book`` keeps positions in keyed state and refolds from a saved one: use it
to keep a book current. Here is the event store, from which a book can be folded anew:
each micro-batch appends its events, by buckets of instruments, folds the touched
instruments from their buckets and writes their positions under its number; others
keep their rows. Written for foreachBatch: a batch that is replayed writes the same
rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import EVENT_COLUMNS, fold, positions

#: Folders of a batch's events, by instrument.
BUCKETS = 64


def upsert(events_path: str, positions_path: str | None = None):
    """A foreachBatch function that stores a micro-batch of fold events by batch id, and the positions of what it touches."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id:012d}"
        bucket = F.pmod(F.xxhash64("instrument"), F.lit(BUCKETS))
        batch.select(*EVENT_COLUMNS, bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{events_path}/{part}")
        if positions_path:
            stored = batch.sparkSession.read.parquet(events_path)
            here = stored.where(F.col("batch") == batch_id)
            # other buckets' folders aren't read
            stored = stored.where(F.col("bucket").isin([r["bucket"] for r in here.select("bucket").distinct().collect()]))
            touched = here.select("viewpoint", "instrument").distinct()
            # an instrument that is sold off has a row of zero
            rows = touched.join(current_positions(stored, touched), ["viewpoint", "instrument"], "left").na.fill(0)
            rows.write.mode("overwrite").parquet(f"{positions_path}/{part}")

    return write


def latest_positions(written: DataFrame) -> DataFrame:
    """The book, of the positions that ``start`` has written: each instrument's row of its last batch."""
    last = written.groupBy("viewpoint", "instrument").agg(F.max_by(F.struct("qty", "total_cost"), "batch").alias("x"))
    return last.select("viewpoint", "instrument", "x.*").where("qty > 0")


def current_positions(events: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Positions of the instruments in ``touched`` (all, if None), from every event stored so far."""
    if touched is not None:
        events = events.join(touched.select("viewpoint", "instrument").distinct(), ["viewpoint", "instrument"], "left_semi")
    return positions(fold(events))


def start(stream: DataFrame, events_path: str, checkpoint: str, positions_path: str | None = None):
    return stream.writeStream.foreachBatch(upsert(events_path, positions_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_volume(stream: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Traded quantity and number of events by instrument and tumbling window of ``ts``, late events up to the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "instrument").agg(F.sum("qty").alias("qty"), F.count("*").alias("n_events")).select(F.col("window.start").alias("start"), "instrument", "qty", "n_events")
