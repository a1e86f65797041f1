"""What a run is expected to give: manifests of planted truths, lists of expected cells; and the emission of its rows."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import flat
from ..store import open_path


class Malformed(ValueError):
    """A manifest or a list of cells that is not what it should be."""


def _unique(pairs: list[tuple]) -> dict:
    keys = [k for k, _ in pairs]
    if twice := sorted({k for k in keys if keys.count(k) > 1}):
        raise Malformed(f"keys that come twice: {', '.join(twice)}")
    return dict(pairs)


def _parse(data: bytes | str):
    try:
        return json.loads(data, object_pairs_hook=_unique)
    except Malformed:
        raise
    except (ValueError, RecursionError) as e:
        raise Malformed(f"not JSON: {e}") from e


class Manifest:
    """Planted truths by dotted path; a path that leads nowhere, or to another type, is an error."""

    def __init__(self, data: bytes | str):
        self.doc = _parse(data)

    def get(self, path: str):
        at = self.doc
        for i, name in enumerate(parts := path.split(".")):
            if not isinstance(at, dict) or name not in at:
                raise Malformed(f"the manifest has no {'.'.join(parts[: i + 1])}")
            at = at[name]
        return at

    def _of(self, path: str, kind: type, what: str):
        value = self.get(path)
        if not isinstance(value, kind) or isinstance(value, bool):
            raise Malformed(f"{path} is no {what}")
        return value

    def int(self, path: str) -> int:
        return self._of(path, int, "whole number")

    def str(self, path: str) -> str:
        return self._of(path, str, "text")

    def list(self, path: str, kind: type) -> list:
        values = self._of(path, list, "list")
        if not all(isinstance(v, kind) and not isinstance(v, bool) for v in values):
            raise Malformed(f"{path} holds something other than {kind.__name__}")
        return values

    def planted(self, path: str) -> dict[str, int]:
        counts = self._of(path, dict, "object")
        return {name: self.int(f"{path}.{name}") for name in counts}


def expected_cells(spark: SparkSession, data: bytes | str) -> DataFrame:
    """surface, lane, twins (sorted) of a list ``{"cells": [{"surface", "lane", "twins"}]}``; no cell and no twin may come twice."""
    doc = _parse(data)
    if not isinstance(doc, dict) or set(doc) != {"cells"} or not isinstance(doc["cells"], list):
        raise Malformed("a list of cells has the one key cells")
    seen, rows = set(), []
    for i, cell in enumerate(doc["cells"]):
        if not isinstance(cell, dict) or set(cell) != {"surface", "lane", "twins"}:
            raise Malformed(f"cell {i} has other keys than surface, lane and twins")
        surface, lane, twins = cell["surface"], cell["lane"], cell["twins"]
        if not isinstance(surface, str) or not re.fullmatch("[a-z0-9][a-z0-9-]*", surface):
            raise Malformed(f"cell {i}: no surface")
        if not isinstance(lane, int) or isinstance(lane, bool) or lane < 1:
            raise Malformed(f"cell {i}: no lane")
        if not isinstance(twins, list) or not all(isinstance(t, str) and t for t in twins) or len(set(twins)) < len(twins):
            raise Malformed(f"cell {i}: twins are texts of which none comes twice")
        if (surface, lane) in seen:
            raise Malformed(f"cell {surface}:lane{lane} comes twice")
        seen.add((surface, lane))
        rows.append((surface, lane, sorted(twins)))
    return spark.createDataFrame(rows, "surface string, lane bigint, twins array<string>")


def twin_sets(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """surface, lane, expected, found (sorted names, comma-joined): where the twins of a cell are others than expected."""
    found = rows.groupBy("surface", "lane").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("cell") == "twin", F.col("mutation")))), ", ").alias("found"))
    want = expected.select("surface", "lane", F.array_join(F.array_sort("twins"), ", ").alias("expected"))
    both = want.join(found, ["surface", "lane"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("found"))).select("surface", "lane", "expected", "found")


def emit(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, and any columns that make its JSON object) as a file each, indented, and return their paths.

    A file has its row's name and is renamed into place when whole; null columns are left out.
    """
    columns = [c for c in rows.columns if c != "name"]
    texts = rows.select("name", F.to_json(F.struct(*columns)).alias("text"))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        import pyarrow as pa

        store, base = open_path(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            paths = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part, path = f"{base}/_{uuid.uuid4().hex}", f"{base}/{name}.json"
                with store.open_output_stream(part) as out:
                    out.write(json.dumps(json.loads(text), indent=2, sort_keys=True).encode() + b"\n")
                store.move(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths)], schema=to_arrow_schema(flat("path string")))

    return texts.mapInArrow(run, flat("path string"))
