"""Comparisons: reconciliation with a statement, set differences, leaf differences of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import CanonError, Number, encode


def reconcile(positions: DataFrame, holdings: DataFrame, cash: DataFrame) -> DataFrame:
    """Every compared pair: instrument (empty for cash), field, ledger, custodian, delta.

    ``positions`` are (instrument, qty, total_cost), ``holdings`` (instrument, quantity, cost_basis, ordinal), of which the
    last of an instrument counts, ``cash`` one row (ledger, custodian). A missing side is zero.
    """
    held = holdings.groupBy("instrument").agg(F.max_by("quantity", "ordinal").alias("quantity"), F.max_by("cost_basis", "ordinal").alias("cost_basis"))
    both = positions.join(held, "instrument", "full_outer")
    pairs = both.select("instrument", F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.coalesce(F.col(a), F.lit(0)).alias("ledger"), F.coalesce(F.col(b), F.lit(0)).alias("custodian")) for name, a, b in (("quantity", "qty", "quantity"), ("cost_basis", "total_cost", "cost_basis"))])).alias("x")).select("instrument", "x.*")
    money = cash.select(F.lit("").alias("instrument"), F.lit("cash").alias("field"), F.col("ledger").cast("bigint").alias("ledger"), F.col("custodian").cast("bigint").alias("custodian"))
    return pairs.unionByName(money).withColumn("delta", F.col("ledger") - F.col("custodian"))


def mismatches(compared: DataFrame) -> DataFrame:
    return compared.where("ledger <> custodian")


def set_difference(a: DataFrame, b: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row (violations, evaluated): elements in one set only, over those in either (or in the caller's universe)."""
    sides = a.select(F.col(a.columns[0]).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(b.columns[0]).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = sides.groupBy("x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = seen.agg(F.count_if(F.col("a") != F.col("b")).alias("violations"), F.count("*").alias("evaluated"))
    if universe is not None:
        n = universe.agg(F.countDistinct(universe.columns[0]).alias("evaluated"))
        out = out.select("violations").join(F.broadcast(n))
    return out


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (violations): the sum of absolute differences of counts of whole rows."""
    sides = a.select("*", F.lit(1).alias("_n")).unionByName(b.select("*", F.lit(-1).alias("_n")))
    return sides.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).agg(F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("violations"))


def leaf_text(x) -> str:
    try:
        return encode(x).decode()
    except CanonError:
        return "<unmarshalable>"


def leaves(doc, path: str = "") -> list[tuple[str, object]]:
    """(dotted path, value) of everything but objects; lists count as one leaf."""
    if not isinstance(doc, dict):
        return [(path, doc)]
    return [leaf for k, v in doc.items() for leaf in leaves(v, f"{path}.{k}" if path else k)]


_ABSENT = object()


def leaf_differences(golden: dict, doc) -> list[tuple[str, str, str]]:
    """(path, want, got) of golden's leaves that doc does not reproduce, by path; what only doc has is ignored."""
    out = []

    def walk(path: str, g, d) -> None:
        if isinstance(g, dict):
            for k, x in g.items():
                walk(f"{path}.{k}" if path else k, x, d.get(k, _ABSENT) if isinstance(d, dict) else _ABSENT)
        elif d is _ABSENT:
            out.append((path, leaf_text(g), "<absent>"))
        elif leaf_text(g) != leaf_text(d):
            out.append((path, leaf_text(g), leaf_text(d)))

    walk("", golden, doc)
    return sorted(out)


def whole_number(x) -> int | None:
    return x.as_int64() if isinstance(x, Number) else None
