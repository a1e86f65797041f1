"""The ordered fold: events of an instrument, by (effective, seq), into a position and its effects.

Events are hash partitioned by (viewpoint, instrument) and sorted inside the
partition, so a task streams over them with one position in memory: an
instrument with very many events costs time, not memory, and the sort spills.
Of a few viewpoints (``fold_views``) an event is shuffled once, with a bit for each
that sees it, and a task holds a position for each set of viewpoints that have seen
the same events so far. Arithmetic is in exact integers with int64 checks.

Cash, realised profit and dividend income are one running balance over all
instruments, whose overflow refuses an event. Where the sum of absolute changes
of a viewpoint stays below 2^63, no order of events can overflow, and the
parallel result is the sequential one; the other viewpoints, if any, are folded
again as one global sequence each, by the same code; it is sorted by many tasks and
streamed by one, whose memory holds the positions alone. The fold's result is written
to the shared folder, so that a call folds once, whatever it asks for. Details of
refusals are part of a snapshot's hashed bytes: fixed values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import INT64_MAX, fits, relieve
from ..functions.schema import flat
from ..store import materialize, open_path, shared_dir

#: Events: viewpoint, instrument, effective, seq, kind (buy, sell, split, dividend), qty, price (fills), term (ratio or rate).
EVENT_COLUMNS = ["viewpoint", "instrument", "effective", "seq", "kind", "qty", "price", "term"]
#: Results: a position, a refusal, or a group's sums; sums are text, as they may exceed int64.
OUT = flat("what string, viewpoint bigint, instrument string, qty bigint, total_cost bigint, seq bigint, kind string, detail string, cash string, realized string, dividends string, reach string")


_NONE = (0, 0)
#: Viewpoints that ``fold_views`` takes, a bit each.
MOST_VIEWS = 62


class Ledger:
    """Running state of one group. ``checked``: whether balances are global and their overflow refuses."""

    def __init__(self, checked: bool):
        self.checked, self.held = checked, {}
        self.cash = self.realized = self.dividends = self.reach = 0

    def copy(self) -> Ledger:
        other = Ledger(self.checked)
        other.held = dict(self.held)
        other.cash, other.realized, other.dividends, other.reach = self.cash, self.realized, self.dividends, self.reach
        return other

    def move(self, cash: int, realized: int = 0, dividends: int = 0) -> None:
        self.cash += cash
        self.realized += realized
        self.dividends += dividends
        self.reach += abs(cash) + abs(realized)

    def apply(self, instrument: str, kind: str, qty: int, price: int, term: int) -> tuple[str, str] | None:
        """The refusal (kind, detail) of an event, or None and the state has moved."""
        held, cost = self.held.get(instrument, _NONE)
        checked = self.checked
        if kind == "buy":
            paid = qty * price
            if paid > INT64_MAX:
                return "malformed", "buy cost (qty*price) overflows int64"
            if held + qty > INT64_MAX:
                return "malformed", "buy would overflow position quantity"
            if cost + paid > INT64_MAX:
                return "malformed", "buy would overflow position total cost"
            if checked and not fits(self.cash - paid):
                return "malformed", "buy would overflow cash balance"
            self.held[instrument] = held + qty, cost + paid
            self.cash -= paid
            self.reach += paid
        elif kind == "sell":
            if qty > held:
                return "oversell", f"sell {qty} exceeds held {held}"
            got = qty * price
            if got > INT64_MAX:
                return "malformed", "sell proceeds (qty*price) overflows int64"
            if checked and not fits(self.cash + got):
                return "malformed", "sell would overflow cash balance"
            gone = relieve(cost, qty, held)
            if checked and not fits(self.realized + got - gone):
                return "malformed", "sell would overflow realized P&L"
            if held == qty:
                del self.held[instrument]
            else:
                self.held[instrument] = held - qty, cost - gone
            self.move(got, got - gone)
        elif kind == "split" and instrument in self.held:
            if held * term > INT64_MAX:
                return "malformed", "split qty*ratio overflows int64"
            self.held[instrument] = held * term, cost
        elif kind == "dividend" and held > 0:
            paid = held * term
            if paid > INT64_MAX:
                return "malformed", "dividend qty*rate overflows int64"
            if checked and not fits(self.cash + paid):
                return "malformed", "dividend would overflow cash balance"
            if checked and not fits(self.dividends + paid):
                return "malformed", "dividend would overflow dividend income"
            self.move(paid, 0, paid)
        return None


def values(column: pa.Array) -> list:
    """A column's values, a null number as 0: many times faster than to_pylist."""
    if column.null_count and pa.types.is_integer(column.type):
        column = column.fill_null(0)
    return column.to_numpy(zero_copy_only=False).tolist()


def _closed(view: int, instrument: str | None, ledger: Ledger) -> Iterator[tuple]:
    """Rows of ``OUT``: a group's positions and sums."""
    for held, (qty, cost) in ledger.held.items():
        yield "position", view, held, qty, cost, None, None, None, None, None, None, None
    yield "sums", view, instrument, None, None, None, None, None, str(ledger.cash), str(ledger.realized), str(ledger.dividends), str(ledger.reach)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fold(group_by_instrument: bool):
    """Of events without ``effective``, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, ledger = None, None
        for b in batches:
            for view, instrument, seq, kind, qty, price, term in zip(*map(values, b.columns), strict=True):
                key = (view, instrument if group_by_instrument else None)
                if key != now:
                    if ledger:
                        rows += _closed(*now, ledger)
                    now, ledger = key, Ledger(not group_by_instrument)
                if refused := ledger.apply(instrument, kind, qty, price, term):
                    rows.append(("refusal", view, instrument, None, None, seq, *refused, None, None, None, None))
            if len(rows) >= 5000:
                yield _batch(rows)
                rows = []
        if ledger:
            rows += _closed(*now, ledger)
        if rows:
            yield _batch(rows)

    return run


def _fold_views(views: list[int]):
    """Of events without ``effective``, in order, by instrument; ``views`` in place of ``viewpoint``: bit i for views[i]."""
    every, bits = (1 << len(views)) - 1, range(len(views))
    names = lambda mask: [views[i] for i in bits if mask >> i & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        # ledgers of sets of viewpoints that have seen the same; all that have seen any event
        now, ledgers, seen = None, [], 0

        def close() -> None:
            for mask, ledger in ledgers:
                for view in names(mask & seen):
                    rows.extend(_closed(view, now, ledger))

        for b in batches:
            for shown, instrument, seq, kind, qty, price, term in zip(*map(values, b.columns), strict=True):
                if instrument != now or not ledgers:
                    close()
                    now, ledgers, seen = instrument, [(every, Ledger(False))], 0
                seen |= shown
                for i, (mask, ledger) in enumerate(ledgers):
                    here = mask & shown
                    if not here:
                        continue
                    if here != mask:
                        ledgers[i] = here, ledger
                        ledgers.append((mask & ~shown, ledger.copy()))
                    if refused := ledger.apply(instrument, kind, qty, price, term):
                        rows.extend(("refusal", view, instrument, None, None, seq, *refused, None, None, None, None) for view in names(here))
            if len(rows) >= 5000:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    return run


_PASSED = [c for c in EVENT_COLUMNS if c != "effective"]


def _in_sequence(events: DataFrame) -> DataFrame:
    """Each viewpoint's events as one global sequence, whose sort is many tasks' work: one task a viewpoint streams over what they wrote."""
    spark, order = events.sparkSession, ["viewpoint", "effective", "seq"]
    path = f"{shared_dir(spark)}/sequence-{uuid.uuid4().hex}"
    events.repartitionByRange(*order).sortWithinPartitions(*order).select(*_PASSED).write.option("compression", "zstd").parquet(path)
    views = spark.read.schema(events.select(*_PASSED).schema).parquet(path).select("viewpoint").distinct().repartition("viewpoint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, folder = open_path(path)
        # ranges in the order of their numbers, which files are named by
        files = [f for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")]
        names = [f.path for f in sorted(files, key=lambda f: (int(f.base_name.split("-")[1]), f.base_name))]

        def rows_of(view: int) -> Iterator[pa.RecordBatch]:
            for name in names:
                with pq.ParquetFile(name, filesystem=store) as file:
                    for b in file.iter_batches(10_000, columns=_PASSED):
                        if (found := b.filter(pc.equal(b.column(0), view))).num_rows:
                            yield found

        for b in batches:
            for view in b.column(0).to_pylist():
                yield from _fold(False)(rows_of(view))

    return views.mapInArrow(run, OUT)


def fold(events: DataFrame, force_global: bool = False) -> DataFrame:
    """Positions, refusals and sums (``OUT``) of events (``EVENT_COLUMNS``); written once, for all that reads them."""
    events = events.select(*EVENT_COLUMNS)
    if force_global:
        return materialize(_in_sequence(events), "fold")
    keys = ["viewpoint", "instrument"]
    done = materialize(events.repartition(*keys).sortWithinPartitions(*keys, "effective", "seq").select(*_PASSED).mapInArrow(_fold(True), OUT), "fold")
    return _checked(done, lambda late: events.where(F.col("viewpoint").isin(late)))


def fold_views(events: DataFrame, views: list[int]) -> DataFrame:
    """As ``fold``, of events that come once, with ``views`` in place of ``viewpoint``: bit i is set if views[i] sees the event."""
    if len(views) > MOST_VIEWS:
        raise ValueError(f"more than {MOST_VIEWS} viewpoints: fold a copy of the events for each")
    rows = events.select("views", *EVENT_COLUMNS[1:])
    done = materialize(rows.repartition("instrument").sortWithinPartitions("instrument", "effective", "seq").select("views", *_PASSED[1:]).mapInArrow(_fold_views(views), OUT), "fold")

    def copies(late: list[int]) -> DataFrame:
        at = F.array(*[F.when(F.col("views").bitwiseAND(F.lit(1 << i)) != 0, F.lit(v).cast("bigint")) for i, v in enumerate(views) if v in late])
        return rows.withColumn("viewpoint", F.explode(F.array_compact(at))).select(*EVENT_COLUMNS)

    return _checked(done, copies)


def _checked(done: DataFrame, events_of) -> DataFrame:
    """A fold's result, whose viewpoints that may overflow are folded again, of ``events_of`` them, as one sequence each."""
    # what each instrument's balances moved in all, up or down: where the sum fits, no order of events can overflow
    reach = done.where("what = 'sums'").groupBy("viewpoint").agg(F.sum(F.col("reach").cast("decimal(38,0)")).alias("reach"))
    late = [r["viewpoint"] for r in reach.where(F.col("reach") > F.lit(INT64_MAX).cast("decimal(38,0)")).collect()]
    if not late:
        return done
    again = materialize(_in_sequence(events_of(late)), "fold")
    return done.where(~F.col("viewpoint").isin(late)).unionByName(again)


def positions(folded: DataFrame) -> DataFrame:
    return folded.where("what = 'position'").select("viewpoint", "instrument", "qty", "total_cost")


def refusals(folded: DataFrame) -> DataFrame:
    return folded.where("what = 'refusal'").select("viewpoint", "seq", "kind", "detail")


def totals(folded: DataFrame) -> DataFrame:
    """(viewpoint, cash, realized_pnl, dividend_income) of viewpoints with any event."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("bigint")
    return folded.where("what = 'sums'").groupBy("viewpoint").agg(whole("cash").alias("cash"), whole("realized").alias("realized_pnl"), whole("dividends").alias("dividend_income"))
