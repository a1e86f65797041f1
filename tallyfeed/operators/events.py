"""Typed event tables of a feed prefix, and what the ledger decides about each event.

All tables carry seq, event_id and effective (ISO text, compared bytewise):

- fills: key (identity digest, null if a field is missing), payload_hash (null if
  there is no canonical form, with ``hash_error``), instrument, side, qty, price;
  or, in place of the digests, trade_id and venue (see ``told_by``)
- prices: instrument, price
- actions: action_id, instrument, kind, ratio, rate
- amendments: action_id, ratio, rate

Typed values are null where the payload's value is missing or of another JSON type.
What is decided about fills and actions does not depend on the viewpoint, because
the deciding event is the first valid one; amendments do, and take viewpoints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import CanonError, decode, encode, sha256_hex

EVENT_TYPES = ("fill", "price", "action", "action_amendment")


#: What tells fills apart, and what a fill says: digests; or, where a payload holds these fields and no other, the fields
#: themselves. Equal fields have equal digests and others other ones, and rows are shuffled at a third of the size.
DIGESTS = (("key",), ("payload_hash",))
FIELDS = (("trade_id", "venue"), ("instrument", "side", "qty", "price"))


def told_by(fills: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Names of the columns of a fill's identity and of what it says: digests, if the table has them."""
    return DIGESTS if "key" in fills.columns else FIELDS


def _named(trade_id: Column, venue: Column) -> Column:
    """Whether a fill has an identity: both are there, not empty, of printable ASCII."""
    plain = lambda x: (F.length(x) > 0) & x.rlike(r"\A[\x20-\x7E]*\z")
    return F.coalesce(plain(trade_id) & plain(venue), F.lit(False))


def fill_key(trade_id: Column, venue: Column) -> Column:
    """sha256 of the canonical {"trade_id","venue"} object; null if either is null or empty, or not printable ASCII."""
    text = lambda x: F.regexp_replace(x, r'(["\\])', r"\\$1")
    return F.when(_named(trade_id, venue), F.sha2(F.concat(F.lit('{"trade_id":"'), text(trade_id), F.lit('","venue":"'), text(venue), F.lit('"}')), 256))


def keyed(fills: DataFrame) -> DataFrame:
    """fills with their key, made of its fields if they have none."""
    return fills if "key" in fills.columns else fills.withColumn("key", fill_key(F.col("trade_id"), F.col("venue")))


def has_key(fills: DataFrame) -> Column:
    return F.col("key").isNotNull() if "key" in fills.columns else _named(F.col("trade_id"), F.col("venue"))


def _typed(v: Column, name: str, kind: str) -> Column:
    """A payload's value if its JSON type is the one asked for: a non-empty string, or an integer within int64."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    value = F.try_variant_get(v, f"$.{name}", "string" if kind == "STRING" else "bigint")
    return F.when((F.schema_of_variant(x) == kind) & (F.length(value) > 0 if kind == "STRING" else F.lit(True)), value)


def from_records(records: DataFrame) -> dict[str, DataFrame]:
    """fills, prices, actions, amendments and unknown (other types) of verified records."""
    v = F.try_parse_json("payload")
    s, i = (lambda n: _typed(F.col("v"), n, "STRING").alias(n)), (lambda n: _typed(F.col("v"), n, "BIGINT").alias(n))
    base = records.select("seq", F.col("id").alias("event_id"), "effective", "type", "payload", v.alias("v"))
    of = lambda kind, *cols: base.where(F.col("type") == kind).select("seq", "event_id", "effective", *cols)
    fills = of("fill", s("trade_id"), s("venue"), F.sha2("payload", 256).alias("payload_hash"), F.lit(None).cast("string").alias("hash_error"), s("instrument"), s("side"), i("qty"), i("price"))
    return {
        "fills": fills.withColumn("key", fill_key(F.col("trade_id"), F.col("venue"))),
        "prices": of("price", s("instrument"), i("price")),
        "actions": of("action", s("action_id"), s("instrument"), s("kind"), i("ratio"), i("rate"), fill_key(_typed(F.col("v"), "trade_id", "STRING"), _typed(F.col("v"), "venue", "STRING")).alias("key")),
        "amendments": of("action_amendment", s("action_id"), i("ratio"), i("rate")),
        "unknown": base.where(~F.col("type").isin(*EVENT_TYPES)).select("seq", "event_id", "effective", "type"),
    }


def payload_hash(payload: dict | str) -> str:
    """sha256 of the canonical payload; empty if it has none (never compare empty ones)."""
    try:
        return sha256_hex(encode(decode(payload) if isinstance(payload, str) else payload))
    except (CanonError, ValueError):
        return ""


def classify_fills(fills: DataFrame) -> DataFrame:
    """fills with status (applied, absorbed, collision, malformed) and detail.

    The first valid fill of a key wins; later ones with its hash are absorbed, with
    another are collisions, whatever their own fields. A key's winner comes from a
    map-side combined aggregate, and joins back: a key with very many copies is a
    skewed probe side only.
    """
    key, said = told_by(fills)
    identified, hashed = has_key(fills), reduce(Column.__and__, [F.col(c).isNotNull() for c in said])
    valid = identified & hashed & F.coalesce((F.length("instrument") > 0) & F.col("side").isin("buy", "sell") & (F.col("qty") > 0) & (F.col("price") > 0), F.lit(False))
    rows = fills.withColumns({"_key": identified, "_valid": valid})
    first = rows.where("_valid").groupBy(*key).agg(F.min(F.struct("seq", *said)).alias("_x"))
    winners = first.select(*key, F.col("_x.seq").alias("_first"), *[F.col(f"_x.{c}").alias(f"_{c}") for c in said])
    out = rows.where("_key").join(winners, list(key), "left").unionByName(rows.where("NOT _key"), allowMissingColumns=True)
    after = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in said])
    status = F.when(~F.col("_key") | ~hashed, "malformed").when(after & same, "absorbed").when(after, "collision").when(F.col("_valid"), "applied").otherwise("malformed")
    error = F.coalesce("hash_error", F.lit("")) if "hash_error" in fills.columns else F.lit("")
    detail = (
        F.when(~F.col("_key"), "fill identity fields missing")
        .when(~hashed, F.concat(F.lit("payload cannot canonicalize: "), error))
        .when(after & ~same, "payload hash mismatch")
        .when(~after & ~F.col("_valid"), "fill fields invalid")
    )
    return out.select(*fills.columns, status.alias("status"), detail.alias("detail"))


def classify_actions(actions: DataFrame) -> DataFrame:
    """actions with status (applied, malformed) and detail; the first valid action of an id wins."""
    named = F.col("action_id").isNotNull() & F.col("instrument").isNotNull() & F.col("kind").isNotNull()
    terms = F.when(F.col("kind") == "split", F.when(~F.coalesce(F.col("ratio") >= 1, F.lit(False)), "split ratio must be a whole number >= 1")).when(F.col("kind") == "dividend", F.when(~F.coalesce(F.col("rate") >= 0, F.lit(False)), "dividend rate must be an integer >= 0")).otherwise(F.concat(F.lit("unknown action kind "), "kind"))
    rows = actions.withColumns({"_named": named, "_terms": terms})
    first = rows.where("_named AND _terms IS NULL").groupBy("action_id").agg(F.min("seq").alias("_first"))
    rows = rows.join(first, "action_id", "left")
    detail = F.when(~F.col("_named"), "action missing action_id/instrument/kind").when(F.col("seq") > F.col("_first"), F.concat(F.lit("duplicate action_id "), "action_id")).otherwise(F.col("_terms"))
    return rows.withColumn("detail", detail).select(*actions.columns, F.when(F.col("detail").isNull(), "applied").otherwise("malformed").alias("status"), "detail")


def viewpoints(spark, seqs: list[int]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in seqs], "viewpoint bigint")


def visible(events: DataFrame, points: DataFrame) -> DataFrame:
    """One copy of each event for each viewpoint that sees it (seq <= viewpoint). Viewpoints are a short list."""
    return events.join(F.broadcast(points), F.col("seq") <= F.col("viewpoint"))


def resolve_amendments(actions: DataFrame, amendments: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied actions with their amended terms, amendments with status and detail), for each viewpoint.

    ``actions`` are classified. The last valid amendment that is visible sets the term, also one whose seq
    precedes its action's; one that names no visible action is an unknown_action.
    """
    shown = visible(actions.where("status = 'applied'").drop("status", "detail"), points)
    notes = visible(amendments, points)
    own = shown.select("viewpoint", F.col("action_id"), F.col("kind").alias("_kind"))
    notes = notes.join(own, ["viewpoint", "action_id"], "left")
    good = F.coalesce(F.when(F.col("_kind") == "split", F.col("ratio") >= 1).otherwise(F.col("rate") >= 0), F.lit(False))
    detail = (
        F.when(F.col("action_id").isNull(), "amendment missing action_id")
        .when(F.col("_kind").isNull(), F.concat(F.lit("amendment references unknown action "), "action_id"))
        .when(~good & (F.col("_kind") == "split"), "amendment ratio must be a whole number >= 1")
        .when(~good, "amendment rate must be an integer >= 0")
    )
    status = F.when(F.col("detail").isNull(), "applied").when(F.col("action_id").isNotNull() & F.col("_kind").isNull(), "unknown_action").otherwise("malformed")
    notes = notes.withColumn("detail", detail).withColumn("status", status)
    last = notes.where("status = 'applied'").groupBy("viewpoint", "action_id").agg(F.max_by("ratio", "seq").alias("_ratio"), F.max_by("rate", "seq").alias("_rate"))
    split = F.col("kind") == "split"
    terms = shown.join(last, ["viewpoint", "action_id"], "left").withColumns({"ratio": F.when(split, F.coalesce("_ratio", "ratio")), "rate": F.when(~split, F.coalesce("_rate", "rate"))})
    return terms.drop("_ratio", "_rate"), notes.drop("_kind")


def latest_prices(prices: DataFrame) -> DataFrame:
    """(viewpoint, instrument, price, price_seq): the price of the greatest (effective, seq) of each visible instrument."""
    return prices.groupBy("viewpoint", "instrument").agg(F.max(F.struct("effective", "seq", "price")).alias("x")).select("viewpoint", "instrument", F.col("x.price").alias("price"), F.col("x.seq").alias("price_seq"))
