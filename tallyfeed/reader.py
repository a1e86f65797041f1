"""The three read questions: head, as-of, reconcile. Each call verifies and folds anew."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple, Protocol

from pyspark.sql import SparkSession

from .functions.canon import decode
from .operators.compare import mismatches, reconcile, whole_number
from .plans.snapshot import as_of_feed
from .plans.verify import verify
from .sources.feed import ChainError, FeedNotFound


class SeqOutOfRange(ValueError):
    """A viewpoint beyond the feed's end."""


class BadStatement(ValueError):
    """Bytes that are no custodian statement."""


class Head(NamedTuple):
    records: int
    prefix_hash: str


class AsOf(NamedTuple):
    seq: int
    prefix_hash: str
    snapshot_hash: str
    snapshot: bytes


class Recon(NamedTuple):
    compared: int
    mismatches: list


class Reader(Protocol):
    def head(self) -> Head: ...
    def as_of(self, seq: int = -1) -> AsOf: ...
    def reconcile(self, seq: int, statement: bytes) -> Recon: ...


def load_statement(data: bytes) -> dict:
    """as_of_seq, cash and holdings [(instrument, quantity, cost_basis)]; strict about types."""
    try:
        doc = decode(data)
    except ValueError as e:
        raise BadStatement(f"bad statement: {e}") from e
    if not isinstance(doc, dict):
        raise BadStatement("bad statement: statement is not an object")
    out = {"holdings": []}
    for name in ("as_of_seq", "cash"):
        out[name] = whole_number(doc.get(name))
        if out[name] is None:
            raise BadStatement(f"bad statement: {name}: not an integer: {doc.get(name)}")
    if not isinstance(doc.get("holdings"), list):
        raise BadStatement("bad statement: holdings missing")
    for i, h in enumerate(doc["holdings"]):
        if not isinstance(h, dict):
            raise BadStatement(f"bad statement: holding {i} not an object")
        name = h.get("instrument")
        if not isinstance(name, str) or whole_number(name) is not None or not name:
            raise BadStatement(f"bad statement: holding {i} instrument missing")
        numbers = [whole_number(h.get(k)) for k in ("quantity", "cost_basis")]
        if None in numbers:
            raise BadStatement(f"bad statement: holding {name} {('quantity', 'cost_basis')[numbers.index(None)]}: not an integer")
        out["holdings"].append((name, *numbers))
    return out


def reconcile_document(spark: SparkSession, doc: dict, statement: dict) -> Recon:
    """Mismatches between a snapshot document and a statement; fails on a document that can't be read."""
    cash = whole_number(doc.get("cash"))
    if cash is None:
        raise ValueError("doc cash: not an integer")
    if not isinstance(doc.get("positions"), dict):
        raise ValueError("doc positions: missing or not an object")
    held = []
    for name, p in doc["positions"].items():
        pair = [whole_number(p.get(k)) for k in ("qty", "total_cost")] if isinstance(p, dict) else [None]
        if None in pair:
            raise ValueError(f"doc position {name}: qty or total_cost is not an integer")
        held.append((name, *pair))
    table = reconcile(
        spark.createDataFrame(held, "instrument string, qty bigint, total_cost bigint"),
        spark.createDataFrame([(*h, i) for i, h in enumerate(statement["holdings"])], "instrument string, quantity bigint, cost_basis bigint, ordinal int"),
        spark.createDataFrame([(cash, statement["cash"])], "ledger bigint, custodian bigint"),
    )
    found = [tuple(r) for r in mismatches(table).select("instrument", "field", "ledger", "custodian", "delta").orderBy("instrument", "field").collect()]
    return Recon(table.count(), found)


@dataclass
class FeedReader:
    """The live reader of the feed at a path."""

    spark: SparkSession
    path: str

    def head(self) -> Head:
        feed = verify(self.spark, self.path)
        return Head(feed.count, feed.prefix_hash(feed.count))

    def _read(self, seq: int):
        feed = verify(self.spark, self.path)
        if seq > feed.count:
            raise SeqOutOfRange(f"seq out of range: seq {seq} > records {feed.count}")
        return as_of_feed(self.spark, feed, seq)

    def as_of(self, seq: int = -1) -> AsOf:
        at, prefix, _, data, digest = self._read(seq)
        return AsOf(at, prefix, digest, data)

    def reconcile(self, seq: int, statement: bytes) -> Recon:
        told = load_statement(statement)
        return reconcile_document(self.spark, self._read(seq)[2], told)


def status_of(error: Exception) -> str:
    """The class of a read's failure, in the words of RPC status codes."""
    if isinstance(error, FeedNotFound):
        return "NOT_FOUND"
    if isinstance(error, ChainError):
        return "DATA_LOSS"
    return "INVALID_ARGUMENT" if isinstance(error, (SeqOutOfRange, BadStatement)) else "INTERNAL"
