"""Verdict rows of quality checks: which are sound, and which properties they let one claim.

A row reports one run: surface and lane (what was checked), cell (live data, or a
twin with a planted defect), result (GREEN, RED, UNEVALUABLE), and per check the
violations found and the items evaluated. ``judge_rows`` judges rows by themselves (the
schema compiled to one expression, then the rules between fields), ``set_reasons``
rows of one surface and lane together, ``credit`` derives claims:
a live check counts only once a twin, red exactly as planted, has shown it can
turn red.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variant_schema import problems
from ..store import materialize

SCHEMA_NAME = "tallyfeed/verdict/1"
RESULTS = ("GREEN", "RED", "UNEVALUABLE")

#: What a row must be. Fixed values.
_COUNTS = {"type": "object", "additionalProperties": {"type": "integer", "minimum": 0}}
_TEXT, _ANY = {"type": "string"}, {"type": "object"}
SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["schema", "kind", "surface", "lane", "cell", "result", "checks", "evaluated", "scope", "params", "content_hash", "content_hash_basis", "gate_sha", "gate_worktree", "ran_at", "runner"],
    "properties": {
        "schema": _TEXT | {"enum": [SCHEMA_NAME]}, "kind": _TEXT | {"enum": ["GATE_VERDICT"]}, "surface": _TEXT | {"pattern": "^[a-z0-9][a-z0-9-]*$"}, "lane": {"type": "integer", "minimum": 1},
        "cell": _TEXT | {"enum": ["live", "twin"]}, "result": _TEXT | {"enum": list(RESULTS)}, "unevaluable_reason": _TEXT, "checks": _COUNTS | {"minProperties": 1}, "evaluated": _COUNTS,
        "planted": {"type": "object", "required": ["mutation", "mutated_rows", "expected_violations"], "additionalProperties": False, "properties": {"mutation": _TEXT | {"pattern": "."}, "mutated_rows": {"type": "integer", "minimum": 0}, "expected_violations": _COUNTS}},
        "scope": _TEXT, "params": _ANY, "content_hash": _TEXT | {"pattern": "^sha256:[0-9a-f]{64}$"}, "content_hash_basis": _TEXT, "gate_sha": _TEXT | {"pattern": "^[0-9a-f]{40}$"},
        "gate_worktree": _TEXT | {"enum": ["clean", "dirty"]}, "ran_at": _TEXT | {"pattern": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"}, "runner": _TEXT | {"pattern": "."},
        "rows": {"type": "integer", "minimum": 0}, "metrics": _ANY,
    },
}


def typed_rows(rows: DataFrame) -> DataFrame:
    """The columns of ``row_faults`` and ``set_reasons`` of rows (file, row: JSON text), null where a field is of another type."""
    v = F.try_parse_json("row")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    text = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path, "string"))
    counts = lambda path: get(path, "map<string,bigint>")
    # escapes part words, as the characters that they stand for do
    plain = F.regexp_replace("row", r"\\(?:u[0-9a-fA-F]{4}|.)", " ")
    word = F.regexp_extract(plain, r'"([^"]*\b(?:CLAIMABLE|PARTIAL|UNCLAIMED)\b[^"]*)"', 1)
    return rows.select("file", "row", v.alias("v")).select(
        "file", get("$.lane", "bigint").alias("lane"), *[text(f"$.{c}").alias(c) for c in ("surface", "cell", "result", "unevaluable_reason")], counts("$.checks").alias("checks"), counts("$.evaluated").alias("evaluated"),
        counts("$.planted.expected_violations").alias("expected"), F.when(F.length(word) > 0, F.array(word)).otherwise(F.array().cast("array<string>")).alias("texts"), text("$.planted.mutation").alias("mutation"),
    )


def judge_rows(rows: DataFrame) -> DataFrame:
    """(file, reason): everything that is wrong with single rows (file, row: JSON text of an object; reason: why there is none)."""
    unread = rows.where("reason IS NOT NULL").select("file", "reason")
    read = rows.where("reason IS NULL")
    shape = read.select("file", F.explode(problems(SCHEMA, F.parse_json("row"))).alias("reason"))
    return unread.unionByName(shape).unionByName(row_faults(typed_rows(read)).where("reason NOT LIKE 'schema:%'"))


def judge_folder(rows: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(name, reason): rows as ``sources.rows.read_rows`` gives them, by themselves, then sound ones together, then cells against a list."""
    alone = materialize(judge_rows(rows), "row-reasons")
    sound = typed_rows(rows.where("reason IS NULL").join(alone.select("file").distinct(), "file", "left_anti"))
    out = alone.unionByName(set_reasons(sound)).withColumnRenamed("file", "name")
    if expected is None:
        return out
    cells = expected_cells(sound, expected)
    return out.unionByName(cells.select(F.concat_ws(":lane", "surface", F.col("lane").cast("string")).alias("name"), "reason"))


def row_faults(rows: DataFrame) -> DataFrame:
    """(file, reason): the rules that hold between the fields of a row.

    ``rows``: file, lane, cell, result, unevaluable_reason, checks and evaluated (maps), expected (map of the plant, null without one), texts (array of all its strings).
    """
    same = lambda a, b: F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    out, result, twin = F.col("result") == "UNEVALUABLE", F.col("result"), F.col("cell") == "twin"
    told = F.length(F.coalesce("unevaluable_reason", F.lit(""))) > 0
    zero = F.filter(F.map_keys("evaluated"), lambda k: F.try_element_at("evaluated", k) == 0)
    word = F.get(F.filter("texts", lambda t: t.rlike(r"\b(?:CLAIMABLE|PARTIAL|UNCLAIMED)\b")), 0)
    some = F.exists(F.map_values("checks"), lambda v: v > 0)
    red = twin & (result == "RED")
    reasons = F.array(
        F.when(F.col("lane") < 1, "schema: lane must be >= 1"),
        F.when(F.size("checks") < 1, "schema: checks must have at least 1 key"),
        F.when(out & ~told, "UNEVALUABLE needs an unevaluable_reason"),
        F.when(~out & F.col("unevaluable_reason").isNotNull(), "only UNEVALUABLE has an unevaluable_reason"),
        F.when(twin & F.col("expected").isNull(), "a twin says what was planted"),
        F.when(~twin & F.col("expected").isNotNull(), "live data has nothing planted"),
        F.when(F.array_sort(F.map_keys("checks")) != F.array_sort(F.map_keys("evaluated")), "checks and evaluated name different checks"),
        F.when(~out & (F.size(zero) > 0), F.concat(F.lit("nothing was evaluated, yet the result is not UNEVALUABLE: "), F.array_join(F.array_sort(zero), ", "))),
        F.when(~twin & (result == "GREEN") & some, "GREEN in spite of violations"),
        F.when(red & ~some, "RED without a violation"),
        F.when(red & F.col("expected").isNotNull() & ~same(F.col("checks"), F.col("expected")), "violations differ from those planted"),
        F.when(word.isNotNull(), F.concat(F.lit("holds a word that only crediting may use: "), word)),
    )
    return rows.select("file", F.explode(F.array_compact(reasons)).alias("reason"))


def set_reasons(rows: DataFrame) -> DataFrame:
    """(file, reason) of sound rows (file, surface, lane, cell, result, mutation) that don't go together or need a human."""
    order = Window.partitionBy("surface", "lane", "cell").orderBy("file")
    same = Window.partitionBy("surface", "lane", "cell", "mutation").orderBy("file")
    key = F.concat("surface", F.lit(":lane"), F.col("lane").cast("string"))
    live, twin = F.col("cell") == "live", F.col("cell") == "twin"
    numbered = rows.withColumns({"_n": F.row_number().over(order), "_first": F.first("file").over(order), "_m": F.row_number().over(same), "_have": F.first("file").over(same)})
    reasons = F.array(
        F.when(live & (F.col("_n") > 1), F.concat(F.lit("live row of "), key, F.lit(" already in "), "_first")),
        F.when(twin & (F.col("_m") > 1), F.concat(F.lit("twin "), F.coalesce("mutation", F.lit("")), F.lit(" of "), key, F.lit(" already in "), "_have")),
        F.when(live & (F.col("result") == "RED"), F.lit("look at it: live data fails")),
        F.when(twin & (F.col("result") == "GREEN"), F.lit("look at it: a planted defect went unseen")),
    )
    return numbered.select("file", F.explode(F.array_compact(reasons)).alias("reason"))


def expected_cells(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(surface, lane, reason): cells that are not expected, are missing, or have other twins. ``expected``: surface, lane, twins (array)."""
    found = rows.groupBy("surface", "lane").agg(F.array_sort(F.collect_set(F.when(F.col("cell") == "twin", F.col("mutation")))).alias("found"))
    both = found.join(expected.select("surface", "lane", F.array_sort("twins").alias("want")), ["surface", "lane"], "full_outer")
    reason = F.when(F.col("want").isNull(), "nobody expects these rows").when(F.col("found").isNull(), "rows are missing").when(F.col("want") != F.col("found"), "other twins than expected")
    return both.select("surface", "lane", reason.alias("reason")).where("reason IS NOT NULL")


def credit(rows: DataFrame) -> DataFrame:
    """(surface, lane, status, live, twins, unfalsified) of rows (surface, lane, cell, result, checks map, expected map of the plant).

    UNEVALUABLE if any row is; CLAIMABLE with a live row, a twin, and every live check above zero in a twin
    that is RED as planted; PARTIAL otherwise, naming the live checks that none has shown.
    """
    same = lambda a, b: F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    planted = (F.col("cell") == "twin") & (F.col("result") == "RED") & F.coalesce(same(F.col("checks"), F.col("expected")), F.lit(False))
    key = ["surface", "lane"]
    groups = rows.groupBy(*key).agg(F.max(F.when(F.col("cell") == "live", F.col("result"))).alias("live"), F.count_if(F.col("cell") == "twin").alias("twins"), F.max((F.col("result") == "UNEVALUABLE").cast("int")).alias("_out"))
    checks = rows.where("cell = 'live'").select(*key, F.explode("checks").alias("check", "n")).select(*key, "check").distinct()
    shown = rows.where(planted).select(*key, F.explode("checks").alias("check", "n")).where("n > 0").select(*key, "check").distinct()
    missing = checks.join(shown, [*key, "check"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_list("check")).alias("_missing"))
    names = F.when(F.col("_out") == 0, F.coalesce("_missing", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("_out") == 1, "UNEVALUABLE").when(F.col("live").isNotNull() & (F.col("twins") > 0) & (F.size("unfalsified") == 0), "CLAIMABLE").otherwise("PARTIAL")
    return groups.join(missing, key, "left").withColumn("unfalsified", names).select(*key, status.alias("status"), "live", "twins", "unfalsified")


def credit_again(rows: DataFrame, surfaces: DataFrame) -> DataFrame:
    """The derivation of ``credit`` in another way, by counts per check, for all of ``surfaces`` (surface, lane): those without a row are UNCLAIMED, those with two live rows DUPLICATE."""
    key = ["surface", "lane"]
    each = rows.select(*key, "cell", "result", "expected", F.explode("checks").alias("check", "n"), F.size("checks").alias("size"), "checks")
    as_planted = (F.size("expected") == F.col("size")) & F.forall(F.map_entries("checks"), lambda e: F.try_element_at("expected", e["key"]).eqNullSafe(e["value"]))
    proof = F.count_if((F.col("cell") == "twin") & (F.col("result") == "RED") & as_planted & (F.col("n") > 0))
    by_check = each.groupBy(*key, "check").agg(F.count_if(F.col("cell") == "live").alias("live"), proof.alias("proofs")).where("live > 0")
    open_ = by_check.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("proofs") == 0, F.col("check")))).alias("open"))
    counts = rows.groupBy(*key).agg(F.count_if(F.col("cell") == "live").alias("lives"), F.count_if(F.col("cell") == "twin").alias("twins"), F.count_if(F.col("result") == "UNEVALUABLE").alias("out"))
    all_ = surfaces.select(*key).distinct().join(counts, key, "left").join(open_, key, "left")
    none = F.array().cast("array<string>")
    open_checks = F.when(F.coalesce("out", F.lit(0)) == 0, F.coalesce("open", none)).otherwise(none)
    status = F.when(F.col("lives").isNull(), "UNCLAIMED").when(F.col("lives") > 1, "DUPLICATE").when(F.col("out") > 0, "UNEVALUABLE").when((F.col("lives") == 1) & (F.col("twins") > 0) & (F.size("unfalsified") == 0), "CLAIMABLE").otherwise("PARTIAL")
    return all_.withColumn("unfalsified", open_checks).select(*key, status.alias("status"), "unfalsified")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (surface, lane, in_a, in_b) where two derivations (surface, lane, status, unfalsified) differ, or one lacks a cell."""
    said = lambda df, n: df.select("surface", "lane", F.concat_ws(" ", "status", F.array_join(F.array_sort("unfalsified"), ",")).alias(n))
    return said(a, "in_a").join(said(b, "in_b"), ["surface", "lane"], "full_outer").where(~F.col("in_a").eqNullSafe(F.col("in_b")))
