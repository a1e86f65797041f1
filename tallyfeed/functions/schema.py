"""Flat schemas from text, without a session (so at import, and on executors)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType, "bigint": T.LongType, "boolean": T.BooleanType, "binary": T.BinaryType}


def flat(fields: str) -> T.StructType:
    """A schema from "name type, name type"."""
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in (f.split() for f in fields.split(","))])
