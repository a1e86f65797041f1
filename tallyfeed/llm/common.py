"""Helpers shared by the training-data operators.

``map_rows`` appends columns computed by an Arrow batch function to a DataFrame (no
shuffle, memory bounded by one slice of rows), ``produce`` replaces rows, ``Plain``
keeps an operator's column names apart from the input's.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import materialize, read_table, shared_dir  # noqa: F401  (the operators' own imports)

#: Rows a Python worker holds as objects at once; long texts are what needs it.
SLICE_ROWS = 500


class Plain:
    """A DataFrame whose columns are renamed by position, so that no name of the input meets one of an operator's own.

    Input names may hold dots or spaces, or differ from an operator's in case only.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"in_{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        """The renamed column of a name (Spark's own rule: case doesn't count, but an exact match comes first)."""
        found = [i for i, n in enumerate(self.names) if n == name] or [i for i, n in enumerate(self.names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name!r} among {self.names}")
        return f"in_{found[0]}"

    def _pairs(self, keep: list[str] | None, new: list[str]) -> list[tuple[str, str]]:
        taken = {n.lower() for n in new}
        return [(self[n], n) for n in (self.names if keep is None else keep) if n.lower() not in taken]

    def kept(self, keep: list[str] | None, new: list[str]) -> list[str]:
        """The renamed columns to carry along: those of ``keep`` (default: all) that no new column replaces."""
        return [c for c, _ in self._pairs(keep, new)]

    def restore(self, df: DataFrame, new: list[str], keep: list[str] | None = None) -> DataFrame:
        """The kept columns under their own names, then the new ones."""
        return df.select(*[F.col(c).alias(n) for c, n in self._pairs(keep, new)], *new)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, fn: Callable, new: str, uses: list[str], keep: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Append the columns ``new`` (a DDL string) that ``fn`` computes from ``uses``.

    ``fn(*lists)`` gets the Python values of ``uses`` for a slice of rows and
    returns one list per new column. Columns in ``keep`` (default: all) pass
    through untouched; a new column replaces an input column of its name.
    """
    fields = T.StructType.fromDDL(new)
    kept = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    lead = [c for c in uses if c not in kept]
    source = df.select(*[f"`{c}`" for c in kept], *[f"`{c}`" for c in lead])
    n, at = len(kept), [source.columns.index(c) for c in uses]
    out = T.StructType(source.schema.fields[:n] + fields.fields)
    out_arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                part = whole.slice(lo, slice_rows)
                made = fn(*[part.column(i).to_pylist() for i in at])
                arrays = [part.column(i).cast(out_arrow.field(i).type) for i in range(n)]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, out_arrow.field(n + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out_arrow)

    return source.mapInArrow(run, out)


def produce(df: DataFrame, fn: Callable, out: str) -> DataFrame:
    """mapInArrow where ``fn(iterator of batches)`` yields dicts of columns of the DDL ``out``."""
    schema = T.StructType.fromDDL(out)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip((cols[f.name] for f in arrow), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def sum_blocks(batches):
    """Rows (block, data) of compressed int64 arrays, summed by block."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(zlib.decompress(data.as_py()), "<i8")
            sums[block] = sums[block] + x if block in sums else x
    if sums:
        yield {"block": list(sums), "data": [zlib.compress(x.tobytes(), 1) for x in sums.values()]}


class HashCache(dict):
    """64-bit hashes of words; forgets all beyond ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        from xxhash import xxh3_64_intdigest

        self.digest, self.limit = xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.digest(word)
        return value
