"""What the ledger knew at a viewpoint: the fold of a feed prefix, and its canonical document.

``ledger`` builds the tables for any number of viewpoints in one plan; ``build``
turns one viewpoint's tables into the content-addressed document. Nothing is
cached between calls, so an append is visible to the next read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canon import Number, decode, encode, sha256_hex
from ..operators import events as E
from ..operators.fold import EVENT_COLUMNS, MOST_VIEWS, fold, fold_views, positions, refusals, totals
from ..operators.valuation import unevaluable, unrealized_total, value
from ..store import materialize
from .verify import VerifiedFeed, verify


@dataclass
class LedgerTables:
    """Results keyed by viewpoint."""

    valued: DataFrame  # positions with their valuation
    absorbed: DataFrame
    refusals: DataFrame  # seq, event_id, key, kind, detail
    unevaluable: DataFrame
    totals: DataFrame  # cash, realized_pnl, dividend_income, unrealized_pnl
    folded: DataFrame


def applicable(fills: DataFrame, terms: DataFrame, points: DataFrame) -> DataFrame:
    """The fold's events: applied fills and actions that each viewpoint sees."""
    none = F.lit(None).cast("bigint")
    trades = E.visible(fills.where("status = 'applied'"), points).select("viewpoint", "instrument", "effective", "seq", F.col("side").alias("kind"), "qty", "price", none.alias("term"))
    actions = terms.select("viewpoint", "instrument", "effective", "seq", "kind", none.alias("qty"), none.alias("price"), F.coalesce("ratio", "rate").alias("term"))
    return trades.unionByName(actions).select(*EVENT_COLUMNS)


def folded_at(fills: DataFrame, terms: DataFrame, points: DataFrame, force_global: bool = False) -> DataFrame:
    """The fold of ``applicable`` events; of a few viewpoints, each event goes through it once."""
    views = sorted(r[0] for r in points.select("viewpoint").distinct().limit(MOST_VIEWS + 1).collect())
    if force_global or not views or len(views) > MOST_VIEWS:
        return fold(applicable(fills, terms, points), force_global)
    none, bit = F.lit(None).cast("bigint"), lambda i: F.lit(1 << i).cast("bigint")
    # they rise: what the i-th sees, all after it see
    upto = reduce(lambda c, i: c.when(F.col("seq") <= views[i], F.lit((1 << len(views)) - (1 << i)).cast("bigint")), range(1, len(views)), F.when(F.col("seq") <= views[0], F.lit((1 << len(views)) - 1).cast("bigint")))
    trades = fills.where("status = 'applied'").where(F.col("seq") <= views[-1]).select(upto.alias("views"), "instrument", "effective", "seq", F.col("side").alias("kind"), "qty", "price", none.alias("term"))
    own = reduce(lambda c, i: c.when(F.col("viewpoint") == views[i], bit(i)), range(1, len(views)), F.when(F.col("viewpoint") == views[0], bit(0)))
    return fold_views(trades.unionByName(shared_terms(terms.withColumn("views", own))), views)


def shared_terms(terms: DataFrame) -> DataFrame:
    """Fold events of terms with their ``views``: one of a term that several viewpoints share."""
    none = F.lit(None).cast("bigint")
    same = terms.select("views", "action_id", "instrument", "effective", "seq", "kind", F.coalesce("ratio", "rate").alias("term"))
    same = same.groupBy("action_id", "instrument", "effective", "seq", "kind", "term").agg(F.bit_or("views").alias("views"))
    return same.select("views", "instrument", "effective", "seq", "kind", none.alias("qty"), none.alias("price"), "term")


def ledger(tables: dict[str, DataFrame], points: DataFrame, force_global: bool = False) -> LedgerTables:
    """All results of typed event tables (see operators.events) at the viewpoints of a one-column DataFrame."""
    # each is read by several results below
    fills, actions = E.keyed(materialize(E.classify_fills(tables["fills"]), "fills")), materialize(E.classify_actions(tables["actions"]), "actions")
    terms, notes = E.resolve_amendments(actions, tables["amendments"], points)
    folded = folded_at(fills, terms, points, force_global)
    good = F.coalesce((F.length("instrument") > 0) & (F.col("price") > 0), F.lit(False))
    prices = tables["prices"].withColumn("good", good)
    valued = value(positions(folded), E.latest_prices(E.visible(prices.where("good"), points)))

    seen = fills.select("seq", "event_id", "key")
    # an action whose payload names a trade has its key too
    others = actions.select("seq", "event_id", F.col("key") if "key" in actions.columns else F.lit(None).cast("string").alias("key"))
    late = refusals(folded).join(seen.unionByName(others), "seq").select("viewpoint", "seq", "event_id", F.coalesce("key", F.lit("")).alias("key"), "kind", "detail")
    blank = F.lit("").alias("key")
    early = [
        E.visible(fills.where("status IN ('malformed', 'collision')"), points).select("viewpoint", "seq", "event_id", F.coalesce("key", F.lit("")).alias("key"), F.col("status").alias("kind"), "detail"),
        E.visible(actions.where("status = 'malformed'"), points).select("viewpoint", "seq", "event_id", blank, F.col("status").alias("kind"), "detail"),
        notes.where("status <> 'applied'").select("viewpoint", "seq", "event_id", blank, F.col("status").alias("kind"), "detail"),
        E.visible(prices.where("NOT good"), points).select("viewpoint", "seq", "event_id", blank, F.lit("malformed").alias("kind"), F.lit("price fields invalid").alias("detail")),
    ]
    if "unknown" in tables:
        early.append(E.visible(tables["unknown"], points).select("viewpoint", "seq", "event_id", blank, F.lit("malformed").alias("kind"), F.concat(F.lit("unknown event type "), "type").alias("detail")))
    refused = late
    for part in early:
        refused = refused.unionByName(part)
    absorbed = E.visible(fills.where("status = 'absorbed'"), points).select("viewpoint", "seq", "event_id", "key")
    sums = points.join(totals(folded), "viewpoint", "left").join(unrealized_total(valued), "viewpoint", "left").na.fill(0)
    return LedgerTables(valued, absorbed, refused, unevaluable(valued), sums, folded)


def build(tables: LedgerTables, seq: int, prefix_hash: str) -> tuple[dict, bytes, str]:
    """(document, canonical bytes with a final LF, "sha256:" hash) of one viewpoint's tables.

    The document holds every position and refusal, so it is as large as the book: it is assembled on the driver.
    """
    at = F.col("viewpoint") == seq
    n = lambda x: Number(str(x))
    book = {}
    for r in tables.valued.where(at).collect():
        worth = None if r["reason"] else {"price": n(r["price"]), "price_seq": n(r["price_seq"]), "unrealized": n(r["unrealized"])}
        book[r["instrument"]] = {"qty": n(r["qty"]), "total_cost": n(r["total_cost"]), "valuation": worth}
    total = tables.totals.where(at).first()
    doc = {
        "absorbed": [{"event_id": r["event_id"], "key": r["key"], "seq": n(r["seq"])} for r in tables.absorbed.where(at).orderBy("seq").collect()],
        "cash": n(total["cash"]),
        "dividend_income": n(total["dividend_income"]),
        "feed_prefix_hash": prefix_hash,
        "feed_seq": n(seq),
        "positions": book,
        "realized_pnl": n(total["realized_pnl"]),
        "refusals": [{k: r[k] for k in ("detail", "event_id", "key", "kind")} | {"seq": n(r["seq"])} for r in tables.refusals.where(at).orderBy("seq").collect()],
        "unevaluable": [{"instrument": r["instrument"], "reason": r["reason"]} for r in tables.unevaluable.where(at).orderBy("instrument").collect()],
        "unrealized_pnl": n(total["unrealized_pnl"]),
    }
    data = encode(doc) + b"\n"
    return doc, data, "sha256:" + sha256_hex(data)


def as_of_feed(spark: SparkSession, feed: VerifiedFeed, seq: int = -1) -> tuple[int, str, dict, bytes, str]:
    """(seq, prefix hash, document, bytes, hash) of a verified feed; a negative seq is its end."""
    seq = feed.count if seq < 0 else seq
    prefix = feed.prefix_hash(seq)
    tables = ledger(E.from_records(feed.records), E.viewpoints(spark, [seq]))
    return seq, prefix, *build(tables, seq, prefix)


def as_of(spark: SparkSession, path: str, seq: int = -1) -> tuple[int, str, dict, bytes, str]:
    return as_of_feed(spark, verify(spark, path), seq)


def read_document(data: bytes) -> dict:
    doc = decode(data)
    if not isinstance(doc, dict):
        raise ValueError("snapshot is not a JSON object")
    return doc


def write_snapshot(folder: str, data: bytes, digest: str) -> str:
    """Writes the bytes as <hex>.json and returns the path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, digest.removeprefix("sha256:") + ".json")
    with open(path, "wb") as f:
        f.write(data)
    return path
