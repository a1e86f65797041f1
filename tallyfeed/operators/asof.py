"""As-of and interval joins: what was known, or in force, at a point of an order.

``as_of`` gives each left row the last right row of its key at or before it. Both
sides are united and range partitioned by (key, order), so that a key that holds a
third of all rows is many tasks' work; a task carries the last right row through its
sorted rows. What must come from an earlier partition is left open: a task adds one
row about its borders, the driver chains those (a row a partition), and open rows meet
theirs in a join on the partition's number. Sorted rows are read once.

``in_force`` joins points with intervals [start, stop) by classes of length: an
interval lies in at most two bins of the least power-of-four width that is not
shorter than itself, a point looks into one bin of each width that occurs; candidates
are then compared exactly. An interval is two rows however long it is, a point a row
per width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import materialize


def _carry(out: pa.Schema, greatest: bool):
    """Rows sorted by (key, order, side), to left rows with the right row that counts, and one row about the borders."""

    def pick(rank: np.ndarray, starts: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The row whose right values count at each row, -1 for none in its group."""
        n = len(right)
        if not greatest:
            at = np.maximum.accumulate(np.where(right, np.arange(n), -1))
            return np.where(at >= starts, at, -1)
        # the best so far: groups ascend, so that a running maximum of (group, rank) is of the row's own group or of one before
        group, most = np.cumsum(starts == np.arange(n)), rank.max(initial=0) + 1
        best = np.maximum.accumulate(np.where(right, group * most + rank, -1))
        row_of = np.full(most, -1)
        row_of[rank[right]] = np.flatnonzero(right)
        return np.where(best // most == group, row_of[best % most], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None  # (key, one right row or None)
        first, whole = None, True  # the partition's first key, and whether no other has come
        seen = False
        for b in batches:
            if not b.num_rows:
                continue
            key, left, values = b.column("key"), b.column("left"), b.column("right")
            change = pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)), True).to_numpy(zero_copy_only=False)
            # null keys are each their own group: they match nothing
            starts = np.concatenate([[0], np.where(change, np.arange(1, len(key)), 0)])
            starts = np.maximum.accumulate(starts)
            head = key[0].as_py()
            if not seen:
                first, seen = head, True
            goes_on = held is not None and head is not None and head == held[0]
            right = pc.is_valid(values).to_numpy(zero_copy_only=False)
            n = len(key)
            all_values = pa.concat_arrays([_flat(values), _one(held[1], values.type)]) if goes_on and held[1] is not None else _flat(values)
            carried = len(all_values) > n
            if greatest:
                rank = np.empty(len(all_values), np.int64)
                rank[_order_of(all_values)] = np.arange(len(all_values))
            else:
                rank = np.zeros(len(all_values), np.int64)
            at = pick(rank[:n], starts, right)
            if carried:
                group = starts == 0
                better = group & ((at < 0) | (rank[at] < rank[n] if greatest else False))
                at = np.where(better, n, at)
            is_left = pc.is_valid(left).to_numpy(zero_copy_only=False)
            null_key = pc.is_null(key).to_numpy(zero_copy_only=False)
            at = np.where(null_key, -1, at)
            # open: rows of the first key, so long as none but it has come
            open_rows = (starts == 0) & whole & (head == first) & ~null_key
            chosen = all_values.take(pa.array(at, pa.int64(), mask=at < 0))
            keep = pa.array(is_left)
            cols = {"part": pa.array(np.full(n, part, np.int32)), "border": pa.array(np.zeros(n, bool)), "key": key, "last_key": key, "left": left, "right": chosen, "open": pa.array(open_rows), "whole": pa.array(np.zeros(n, bool))}
            yield pa.RecordBatch.from_arrays([cols[f.name].filter(keep).cast(f.type) for f in out], schema=out)
            if (starts > 0).any() or head != first:
                whole = False
            last = n - 1
            end_key = key[last].as_py()
            found = at[last] if not null_key[last] else -1
            value = all_values[int(found)].as_py() if found >= 0 else (held[1] if goes_on and starts[last] == 0 else None)
            held = (end_key, value)
        if seen:
            row = {"part": part, "border": True, "key": first, "last_key": held[0], "left": None, "right": held[1], "open": False, "whole": whole}
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in out], schema=out)

    return run


def _flat(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _one(value: dict, kind: pa.DataType) -> pa.Array:
    return pa.array([value], kind)


def _order_of(values: pa.Array) -> np.ndarray:
    """Positions of struct values in ascending order, nulls first."""
    fields = values.flatten()
    table = pa.table({str(i): f for i, f in enumerate(fields)})
    ascending = pc.sort_indices(table, sort_keys=[(str(i), "ascending") for i in range(len(fields))], null_placement="at_start").to_numpy()
    missing = pc.is_null(values).to_numpy(zero_copy_only=False)
    return np.concatenate([ascending[missing[ascending]], ascending[~missing[ascending]]])


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str], greatest: bool = False) -> DataFrame:
    """Left's columns, and right's ``values`` of the last row of the key whose ``order`` is not after left's; nulls if none.

    ``greatest``: of those rows the one with the greatest ``values`` instead, compared in their order. Of right rows of
    equal key and order the one of greatest values counts. Null keys match nothing; a null order comes first.
    """
    taken = {c.lower() for c in left.columns} & {c.lower() for c in values}
    if taken:
        raise ValueError(f"both sides have {sorted(taken)}: rename one")
    l_rows = left.select(F.col(key).alias("key"), F.col(order).alias("at"), F.lit(1).alias("side"), F.struct("*").alias("left"))
    r_rows = right.select(F.col(key).alias("key"), F.col(order).alias("at"), F.lit(0).alias("side"), F.struct(*values).alias("right"))
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True)
    by = ["key", "at", "side", "right"]
    placed = rows.repartitionByRange(*by[:3]).sortWithinPartitions(*by).select("key", "left", "right")
    kind = {f.name: f.dataType for f in placed.schema}
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("border", T.BooleanType()), T.StructField("key", kind["key"]), T.StructField("last_key", kind["key"]), T.StructField("left", kind["left"]), T.StructField("right", kind["right"]), T.StructField("open", T.BooleanType()), T.StructField("whole", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    done = materialize(placed.mapInArrow(_carry(to_arrow_schema(schema), greatest), schema), "as-of")
    # a row a partition: what each hands to the next
    carried, held = [], (None, None)
    for r in done.where("border").select("part", "key", "last_key", "right", "whole").orderBy("part").collect():
        carried.append((r["part"], *held))
        value = r["right"]
        if r["whole"] and r["key"] is not None and r["key"] == held[0] and (value is None or (greatest and held[1] is not None and tuple(held[1]) > tuple(value))):
            value = held[1]
        held = (r["last_key"], value)
    spark = left.sparkSession
    before = spark.createDataFrame(carried, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before_key", kind["key"]), T.StructField("before", kind["right"])]))
    rows = done.where("NOT border").join(F.broadcast(before), "part", "left")
    usable = F.col("open") & (F.col("key") == F.col("before_key")) & F.col("before").isNotNull()
    better = F.col("right").isNull() | ((F.col("before") > F.col("right")) if greatest else F.lit(False))
    found = F.when(F.coalesce(usable & better, F.lit(False)), F.col("before")).otherwise(F.col("right"))
    return rows.withColumn("found", found).select("left.*", *[F.col(f"found.{v}").alias(v) for v in values])


#: Widths of bins are powers of this many bits.
_BITS = 2


def in_force(points: DataFrame, intervals: DataFrame, point: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Every (point, interval) with start <= point < stop; a null stop is open. Bigint columns; empty intervals match nothing.

    Both sides' columns, whose names must differ.
    """
    last = F.coalesce(F.col(stop) - 1, F.lit((1 << 63) - 1).cast("bigint"))
    rows = intervals.withColumn("_last", last).where(F.col("_last") >= F.col(start))
    # the least class whose width is not shorter than the interval; at the widest all numbers are four bins
    length = F.col("_last").cast("double") - F.col(start).cast("double") + 1
    rows = rows.withColumn("_level", F.least(F.ceil(F.log2(length) / _BITS + F.lit(1e-9)).cast("int"), F.lit(62 // _BITS)))
    bin_of = lambda x: F.expr(f"shiftright({x}, _level * {_BITS})")
    rows = rows.withColumn("_bin", F.explode(F.sequence(bin_of(f"`{start}`"), bin_of("_last"))))
    levels = sorted(r[0] for r in rows.select("_level").distinct().collect())  # at most 32
    asked = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0]))))
    asked = asked.withColumn("_bin", bin_of(f"`{point}`"))
    found = asked.join(rows, ["_level", "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col("_last")))
    return found.drop("_level", "_bin", "_last")
