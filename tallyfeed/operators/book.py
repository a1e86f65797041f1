"""One instrument's events in effective order with saved positions, so that a late event refolds from the last one before it.

Events are kept in runs of ``RUN`` to twice as many, each with the position before its
first event and what the run itself adds to the sums. New events (also ones that
replace an event of their (effective, seq)) are merged into the runs they fall into;
folding goes on from the first of those, and stops as soon as a run's saved position
comes out as it was (a late dividend moves cash, and no later position). Events that
arrive in order touch the last run alone, whatever the history.

Where runs live is the store's affair: ``ListRuns`` in memory, for one pass over many
viewpoints (below); a keyed state in ``streaming.book``.

``fold_at_viewpoints`` answers any number of viewpoints in one pass per instrument:
events pass in order of knowledge, and at a viewpoint the book takes what became known
since the one before. An event is shuffled once, not once a viewpoint. A task holds
one instrument's events (some 100 bytes each); viewpoints are a broadcast list, of
checked length.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import INT64_MAX
from ..store import materialize
from .fold import EVENT_COLUMNS, OUT, Ledger, fold, values

RUN = 64
#: Viewpoints that a broadcast list may hold: 8 MB of numbers.
MOST_VIEWPOINTS = 1_000_000
#: A position (qty, cost), and sums: cash, realized, dividends, reach, refused.
EMPTY, NOTHING = (0, 0), (0, 0, 0, 0, 0)
#: An event: (effective, seq, kind, qty, price, term).
KEY = slice(0, 2)


class ListRuns:
    """Runs in memory. ``end``: the position and the sums after all."""

    def __init__(self):
        self.lows, self.rows, self.end = [], [], (EMPTY, NOTHING)

    def __len__(self) -> int:
        return len(self.rows)

    def find(self, key: tuple) -> int:
        """The run that the key falls into: the last that begins at or before it, or the first."""
        return max(0, bisect_right(self.lows, key) - 1)

    def low(self, i: int) -> tuple:
        return self.lows[i]

    def run(self, i: int) -> tuple:
        """(position before, events, sums of the run)."""
        return self.rows[i]

    def put(self, i: int, before: tuple, events: list[tuple], sums: tuple) -> None:
        if i == len(self.rows):
            self.rows.append(None)
            self.lows.append(None)
        self.rows[i], self.lows[i] = (before, events, sums), events[0][KEY]


def merged(old: list[tuple], new: list[tuple]) -> list[tuple]:
    """Both in order of their keys; of equal keys the new one."""
    by_key = {e[KEY]: e for e in old}
    by_key |= {e[KEY]: e for e in new}
    return [by_key[k] for k in sorted(by_key)]


def advance(position: tuple, events: list[tuple]) -> tuple[tuple, tuple]:
    """(position, sums) of events that are applied to a position."""
    ledger, refused = Ledger(False), 0
    if position[0]:
        ledger.held[None] = position
    apply = ledger.apply
    for _, _, kind, qty, price, term in events:
        if apply(None, kind, qty, price, term) is not None:
            refused += 1
    return ledger.held.get(None, EMPTY), (ledger.cash, ledger.realized, ledger.dividends, ledger.reach, refused)


def take(runs, new: list[tuple]) -> int:
    """Merge events (in order, of different keys) into the runs; returns how many events were folded."""
    n, folded, at, ahead = len(runs), 0, 0, {}
    position, sums = runs.end
    read = write = runs.find(new[0][KEY]) if n else 0
    position = runs.run(read)[0] if n else EMPTY

    def put(events: list[tuple]) -> None:
        nonlocal position, sums, write, folded
        most = RUN if len(events) > 2 * RUN else 2 * RUN
        for lo in range(0, len(events), most):
            part = events[lo : lo + most]
            if read <= write < n and write not in ahead:
                ahead[write] = runs.run(write)
            after, more = advance(position, part)
            runs.put(write, position, part, more)
            position, sums, write, folded = after, tuple(map(int.__add__, sums, more)), write + 1, folded + len(part)

    if not n:
        put(new)
    while read < n:
        # a run as it was, though its place may have been written
        before, events, less = ahead.pop(read) if read in ahead else runs.run(read)
        if before == position and write == read:
            # no position has changed up to here: go to where the next new event falls
            if at == len(new):
                runs.end = runs.end[0], sums
                return folded
            to = runs.find(new[at][KEY])
            if to > read:
                read = write = to
                before, events, less = runs.run(to)
                position = before
        low = (ahead[read + 1][1][0][KEY] if read + 1 in ahead else runs.low(read + 1)) if read + 1 < n else None
        upto = at
        while upto < len(new) and (low is None or new[upto][KEY] < low):
            upto += 1
        events = merged(events, new[at:upto]) if upto > at else events
        at, read, sums = upto, read + 1, tuple(map(int.__sub__, sums, less))
        put(events)
    runs.end = position, sums
    return folded


def term_intervals(actions: DataFrame, amendments: DataFrame) -> DataFrame:
    """action_id, instrument, effective, seq, kind, term, and the seqs [start, stop) in which it is in force (stop null: since).

    Of classified actions. An amendment sets the term from its own seq on; one that came before its action, from the
    action's; one of no valid term, or of no applied action, sets none.
    """
    none = F.lit(None).cast("bigint")
    acts = actions.where("status = 'applied'").select("action_id", "instrument", "effective", "seq", "kind", F.coalesce("ratio", "rate").alias("term"))
    split = F.col("kind") == "split"
    notes = amendments.select("action_id", F.col("seq").alias("note"), "ratio", "rate").join(acts.drop("term"), "action_id").withColumn("term", F.when(split, F.col("ratio")).otherwise(F.col("rate")))
    notes = notes.where(F.coalesce(F.when(split, F.col("term") >= 1).otherwise(F.col("term") >= 0), F.lit(False)))
    told = acts.withColumn("note", none).unionByName(notes.drop("ratio", "rate")).withColumn("start", F.greatest("seq", F.coalesce("note", "seq")))
    # of several that hold from one seq, the last
    action = ["action_id", "instrument", "effective", "seq", "kind"]
    last = told.groupBy(*action, "start").agg(F.max(F.struct("note", "term")).alias("x")).select(*action, F.col("x.term").alias("term"), "start")
    return last.withColumn("stop", F.lead("start").over(Window.partitionBy("action_id").orderBy("start")))


def known_events(fills: DataFrame, actions: DataFrame, amendments: DataFrame) -> DataFrame:
    """Fold events with ``known``, the seq from which they hold: of classified fills and actions, and amendments.

    An amendment that holds an action's term replaces the action's event from then on (see ``term_intervals``).
    """
    return _known(fills, term_intervals(actions, amendments))


def last_events(fills: DataFrame, actions: DataFrame, amendments: DataFrame) -> DataFrame:
    """``known_events`` that hold at the end: one of each action."""
    return _known(fills, term_intervals(actions, amendments).where("stop IS NULL"))


def _known(fills: DataFrame, terms: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    trades = fills.where("status = 'applied'").select(F.col("seq").alias("known"), "instrument", "effective", "seq", F.col("side").alias("kind"), "qty", "price", none.alias("term"))
    return trades.unionByName(terms.select(F.col("start").alias("known"), "instrument", "effective", "seq", "kind", none.alias("qty"), none.alias("price"), "term"))


def _pass(points: list[int]):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(OUT), OUT.names
        cols: dict[str, list] = {n: [] for n in names}
        now, runs, waiting, at = None, None, {}, 0

        def tell(view: int) -> None:
            (qty, cost), (cash, realized, dividends, reach, refused) = runs.end
            rows = [("sums", view, now, None, None, None, None, str(refused), str(cash), str(realized), str(dividends), str(reach))]
            if qty:
                rows.append(("position", view, now, qty, cost, None, None, None, None, None, None, None))
            for row in rows:
                for name, x in zip(names, row, strict=True):
                    cols[name].append(x)

        def catch_up() -> None:
            if waiting:
                take(runs, [waiting[k] for k in sorted(waiting)])
                waiting.clear()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)
            for c in cols.values():
                c.clear()
            return out

        def until(known: int | None):
            """Answer the viewpoints before ``known`` (all that are left, if None)."""
            nonlocal at
            while at < len(points) and (known is None or points[at] < known):
                catch_up()
                if len(runs):
                    tell(points[at])
                at += 1
                if len(cols["what"]) >= 20_000:
                    yield batch()

        for b in batches:
            for instrument, known, *event in zip(*map(values, b.columns), strict=True):
                if runs is None or instrument != now:
                    if runs is not None:
                        yield from until(None)
                    now, runs, at = instrument, ListRuns(), 0
                    waiting.clear()
                yield from until(known)
                waiting[event[0], event[1]] = tuple(event)
        if runs is not None:
            yield from until(None)
        if cols["what"]:
            yield batch()

    return run


def fold_at_viewpoints(known: DataFrame, points: DataFrame) -> DataFrame:
    """As ``fold`` of each viewpoint's events (positions and sums; a sum's detail is how many events are refused), of ``known_events``.

    A viewpoint whose balances may leave int64 is folded again, as one global sequence.
    """
    views = sorted(r[0] for r in points.select("viewpoint").distinct().limit(MOST_VIEWPOINTS + 1).collect())
    if len(views) > MOST_VIEWPOINTS:
        raise ValueError(f"more than {MOST_VIEWPOINTS} viewpoints: ask for them in parts")
    rows = known.where(F.col("known") <= (views[-1] if views else 0)).select("instrument", "known", "effective", "seq", "kind", "qty", "price", "term")
    done = materialize(rows.repartition("instrument").sortWithinPartitions("instrument", "known", "effective", "seq").mapInArrow(_pass(views), OUT), "viewpoints")
    reach = done.where("what = 'sums'").groupBy("viewpoint").agg(F.sum(F.col("reach").cast("decimal(38,0)")).alias("reach"))
    late = [r["viewpoint"] for r in reach.where(F.col("reach") > F.lit(INT64_MAX).cast("decimal(38,0)")).collect()]
    if not late:
        return done
    some = points.where(F.col("viewpoint").isin(late)).select("viewpoint")
    seen = known.join(F.broadcast(some), F.col("known") <= F.col("viewpoint"))
    # what holds at a viewpoint: the event of a key that became known last
    at = seen.groupBy("viewpoint", "instrument", "effective", "seq").agg(F.max_by(F.struct("kind", "qty", "price", "term"), "known").alias("x")).select("viewpoint", "instrument", "effective", "seq", "x.*")
    again = fold(at.select(*EVENT_COLUMNS), force_global=True)
    return done.where(~F.col("viewpoint").isin(late)).unionByName(again.where("what <> 'refusal'"))
