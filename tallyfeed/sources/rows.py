"""Folders of JSON rows, one object a file, read strictly: what is no such object comes out with the reason."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.schema import flat

_OUT = "file string, row string, reason string"


class _Repeated(ValueError):
    """A key that an object has twice."""


def _unique(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Repeated
    return dict(pairs)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is beyond all numbers")
    return value


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


def parse_row(content: bytes) -> tuple[str | None, str | None]:
    """(text with sorted keys, None) of a JSON object without repeated keys at any depth, else (None, why not). NaN and numbers that overflow are not JSON."""
    try:
        value = json.loads(content.decode(), object_pairs_hook=_unique, parse_constant=_refuse, parse_float=_finite)
    except _Repeated:
        return None, "a key is repeated"
    except (ValueError, RecursionError):
        return None, "not JSON"
    return (json.dumps(value, sort_keys=True), None) if isinstance(value, dict) else (None, "not an object")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(file, row, reason): every file of the folder; row is its canonical text, or null with a reason. An empty folder is an error."""

    schema = to_arrow_schema(flat(_OUT))

    def parse(batches):
        for b in batches:
            parsed = [parse_row(x.as_py()) for x in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([r for r, _ in parsed], pa.string()), pa.array([why for _, why in parsed], pa.string())], schema=schema)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    if files.select("path").isEmpty():
        raise ValueError(f"no rows in {folder}")
    return files.mapInArrow(parse, flat(_OUT))


def altered_files(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(name, reason) where a list (name, sha256) and files (name, content) differ; hashes are of content with CRLF as LF."""
    lists = listed.groupBy("name").agg(F.count("*").alias("n"), F.min("sha256").alias("want"), F.max("sha256").alias("high"))
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    files = found.select("name", F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("got"))
    both = lists.join(files, "name", "full_outer")
    reason = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("n") > 1, "listed twice").when(F.col("want") != F.col("got"), "altered")
    return both.select("name", reason.alias("reason")).where("reason IS NOT NULL")
