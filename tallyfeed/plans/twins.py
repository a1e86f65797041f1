"""Planted defects: every check of the ledger must turn red where its defect is planted, exactly as planted, and nowhere else.

A twin is the same ledger with one defect. Live data and all twins are worlds of one
fold: a world's number takes the viewpoint's place, and an event goes through the fold
once, with a bit for each world that holds it, so that one job folds, prices and judges
all of them; a twin that changes no fold is made of the live world's rows behind it.
Every world is held against truths that are derived in another way: positions against the checkpointed fold over viewpoints
(``operators.book``), prices by ranking, terms as intervals.

- ``nodedupe``: fills that were absorbed or collide are applied (check applied_once)
- ``leak``: terms of the end at an earlier viewpoint (term_known)
- ``fill``: one more share in the last purchase of an instrument (position)
- ``price``: the latest price of an instrument + 1 (latest_price)
- ``silent_zero``: an unpriced position is worth 0 (silent_zero)
- ``stale``: an instrument carries the price of another one (latest_price)
- ``omission``: an unpriced position is not declared (undeclared)
- ``phantom``: a position that nobody has (position)
- ``drift``: a statement's cost basis + 4 (statement)

``checks_of`` gives a row per (surface, cell, mutation) with its checks, what they
examined and what was planted, for ``properties.emitted`` and ``verdict.credit``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators.asof import in_force
from ..operators.book import fold_at_viewpoints, known_events, term_intervals
from ..operators.events import has_key, told_by
from ..operators.fold import fold_views, positions
from ..operators.valuation import value
from ..store import materialize
from .properties import latest_prices_again
from .snapshot import shared_terms

#: Twins that are folded, and those made of the live world's rows. Surface: check that must turn red.
FOLDED, VALUED = ("live", "nodedupe", "leak", "fill"), ("price", "silent_zero", "stale", "omission", "phantom", "drift")
SURFACE = {"nodedupe": "dedupe", "leak": "terms", "fill": "book", "phantom": "book", "price": "prices", "stale": "prices", "silent_zero": "unpriced", "omission": "unpriced", "drift": "statement"}
CHECKS = {"dedupe": ("applied_once",), "terms": ("term_known",), "book": ("position",), "prices": ("latest_price",), "unpriced": ("silent_zero", "undeclared"), "statement": ("statement",)}


def _chosen(df: DataFrame, *order) -> DataFrame:
    """The least row of (instrument): what a twin is planted in; one row, or none if the table is empty."""
    return df.orderBy(*order, "instrument").limit(1)


def worlds(tables: dict[str, DataFrame], viewpoint: int) -> dict[str, DataFrame]:
    """Of typed event tables, at a viewpoint: fills, valued (a row per world and position), terms, prices, and the truths."""
    spark = tables["fills"].sparkSession
    key, named = told_by(tables["fills"])[0], has_key(tables["fills"]).alias("named")
    fills, actions = materialize(E.classify_fills(tables["fills"]), "fills"), materialize(E.classify_actions(tables["actions"]), "actions")
    points, end = E.viewpoints(spark, [viewpoint]), E.viewpoints(spark, [(1 << 62)])
    known = known_events(fills, actions, tables["amendments"])
    seen = fills.where(F.col("seq") <= viewpoint)
    number = {name: i for i, name in enumerate((*FOLDED, *VALUED))}
    none, world = F.lit(None).cast("bigint"), lambda name: F.lit(number[name]).cast("bigint").alias("viewpoint")

    bits = lambda *names: F.lit(sum(1 << number[n] for n in names)).cast("bigint")
    trade = lambda rows, held: rows.select(held.alias("views"), "instrument", "effective", "seq", F.col("side").alias("kind"), "qty", "price", none.alias("term"))
    right = materialize(E.resolve_amendments(actions, tables["amendments"], points)[0], "terms")
    leaked = materialize(E.resolve_amendments(actions, tables["amendments"], end)[0].where(F.col("seq") <= viewpoint), "leaked")
    applied = seen.where("status = 'applied'")
    # the last purchase of the instrument that comes last: nothing sells it afterwards
    bought = applied.groupBy("instrument").agg(F.max(F.struct("effective", "seq", "side")).alias("x")).where("x.side = 'buy'")
    target = materialize(_chosen(bought, F.desc("x")).select(F.col("x.seq").alias("more")), "target")
    of = F.when(F.col("status") != "applied", bits("nodedupe")).when(F.col("more").isNotNull(), bits("live", "nodedupe", "leak")).otherwise(bits(*FOLDED))
    events = trade(seen.where("status IN ('applied', 'absorbed', 'collision')").join(F.broadcast(target), F.col("seq") == F.col("more"), "left"), of)
    events = events.unionByName(trade(applied.join(F.broadcast(target), F.col("seq") == F.col("more")).withColumn("qty", F.col("qty") + 1), bits("fill")))
    acts = right.drop("viewpoint").withColumn("views", bits("live", "nodedupe", "fill")).unionByName(leaked.drop("viewpoint").withColumn("views", bits("leak")))
    folded = fold_views(events.unionByName(shared_terms(acts)), [number[n] for n in FOLDED])
    all_worlds = E.viewpoints(spark, [number[n] for n in FOLDED])
    prices = materialize(tables["prices"].where(F.col("seq") <= viewpoint), "prices")
    latest = E.latest_prices(prices.withColumn("viewpoint", F.lit(0).cast("bigint"))).drop("viewpoint")
    valued = materialize(value(positions(folded), latest.join(F.broadcast(all_worlds))), "valued")
    live = valued.where("viewpoint = 0").drop("viewpoint")
    priced, unpriced = live.where("reason IS NULL"), live.where("reason = 'no_price_in_prefix'")
    at = lambda chosen: F.broadcast(chosen.select(F.col("instrument").alias("here")))
    hit = F.col("here").isNotNull()

    def planted(name: str, chosen: DataFrame, **changes) -> DataFrame:
        rows = live.join(at(chosen), F.col("instrument") == F.col("here"), "left")
        return rows.select(world(name), *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in live.columns])

    first, lone = _chosen(priced), _chosen(unpriced)
    other = F.broadcast(_chosen(priced, F.desc("instrument")).select(F.col("price").alias("other_price"), F.col("price_seq").alias("other_seq")))
    stale = live.join(at(first), F.col("instrument") == F.col("here"), "left").join(other, hit, "left")
    carried = {"price": "other_price", "price_seq": "other_seq"}
    stale = stale.select(world("stale"), *[F.when(hit, F.col(carried[c])).otherwise(F.col(c)).alias(c) if c in carried else F.col(c) for c in live.columns])
    extra = spark.createDataFrame([("~phantom", 1, 1)], "instrument string, qty bigint, total_cost bigint").select(world("phantom"), "instrument", "qty", "total_cost", *[none.alias(c) for c in ("price", "price_seq", "unrealized")], F.lit("no_price_in_prefix").alias("reason"))
    rows = valued
    for more in (
        planted("price", first, price=F.col("price") + 1),
        planted("silent_zero", lone, unrealized=F.lit(0).cast("bigint"), reason=F.lit(None).cast("string")),
        stale,
        planted("omission", lone, reason=F.lit(None).cast("string")),
        live.select(world("phantom"), *live.columns).unionByName(extra),
        live.select(world("drift"), *live.columns),
    ):
        rows = rows.unionByName(more)
    names = spark.createDataFrame([(i, n) for n, i in number.items()], "viewpoint bigint, mutation string")
    told = lambda df: df.join(F.broadcast(names), "viewpoint").drop("viewpoint")
    statement = live.select("instrument", "qty", "total_cost")
    drifted = statement.join(at(first), F.col("instrument") == F.col("here"), "left").select("instrument", "qty", (F.col("total_cost") + F.when(hit, 4).otherwise(0)).alias("total_cost"))
    each = lambda name: F.lit(name).alias("mutation")
    # how often an identity is applied in the live world, and how often more without deduplication
    late = F.col("status").isin("absorbed", "collision")
    counts = seen.select(*key, named, "status").where("named").groupBy(*key).agg(F.count_if(F.col("status") == "applied").alias("a"), F.count_if(late).alias("b"))
    keys = counts.groupBy("a", "b").agg(F.count("*").alias("keys"))
    return {
        "keys": materialize(keys, "keys"),
        "applied": applied,
        "valued": materialize(told(rows), "worlds"),
        "terms": right.select(each("live"), "action_id", F.coalesce("ratio", "rate").alias("term")).unionByName(leaked.select(each("leak"), "action_id", F.coalesce("ratio", "rate").alias("term"))),
        "statement": statement.select(each("live"), "*").unionByName(drifted.select(each("drift"), "*")),
        "truth_book": materialize(positions(fold_at_viewpoints(known, points)).drop("viewpoint"), "truth"),
        "truth_prices": latest_prices_again(prices.withColumn("viewpoint", F.lit(0).cast("bigint"))).drop("viewpoint"),
        "truth_terms": in_force(points, term_intervals(actions, tables["amendments"]), "viewpoint").select("action_id", "term", "start"),
        "leaks": leaked.select("action_id", F.coalesce("ratio", "rate").alias("leaked")),
    }


def _count(rows: DataFrame, name: str, violation, key=("mutation",)) -> DataFrame:
    return rows.groupBy(*key).agg(F.count_if(F.coalesce(violation, F.lit(False))).alias("violations"), F.count("*").alias("evaluated")).select(*key, F.lit(name).alias("check"), "violations", "evaluated")


def examine(w: dict[str, DataFrame]) -> DataFrame:
    """mutation, check, violations, evaluated: every check in every world that has what it looks at."""
    out = None
    for name, n in (("live", F.col("a")), ("nodedupe", F.col("a") + F.col("b"))):
        rows = w["keys"].groupBy(F.lit(name).alias("mutation")).agg(F.coalesce(F.sum(F.when(n > 1, F.col("keys"))), F.lit(0)).alias("violations"), F.sum("keys").alias("evaluated"))
        rows = rows.select("mutation", F.lit("applied_once").alias("check"), "violations", "evaluated")
        out = out.unionByName(rows) if out else rows
    terms = w["terms"].join(w["truth_terms"].withColumnRenamed("term", "want"), "action_id", "left")
    out = out.unionByName(_count(terms, "term_known", ~F.col("term").eqNullSafe(F.col("want"))))
    # each instrument of the truth or of the world, in either
    valued = w["valued"]
    worlds_there = valued.select("mutation").distinct()
    truth = w["truth_book"].select("instrument", F.col("qty").alias("q"), F.col("total_cost").alias("c")).join(F.broadcast(worlds_there))
    book = valued.select("mutation", "instrument", "qty", "total_cost").join(truth, ["mutation", "instrument"], "full_outer")
    out = out.unionByName(_count(book, "position", ~(F.col("qty").eqNullSafe(F.col("q")) & F.col("total_cost").eqNullSafe(F.col("c")))))
    priced = valued.join(w["truth_prices"].select("instrument", F.col("price").alias("p"), F.col("price_seq").alias("s")), "instrument", "left")
    out = out.unionByName(_count(priced.where("price IS NOT NULL OR p IS NOT NULL"), "latest_price", ~(F.col("price").eqNullSafe(F.col("p")) & F.col("price_seq").eqNullSafe(F.col("s")))))
    unpriced = priced.where("p IS NULL")
    out = out.unionByName(_count(unpriced, "silent_zero", F.col("unrealized").isNotNull()))
    out = out.unionByName(_count(unpriced, "undeclared", F.col("unrealized").isNull() & F.col("reason").isNull()))
    told = w["statement"].join(w["truth_book"].select("instrument", F.col("qty").alias("q"), F.col("total_cost").alias("c")), "instrument", "full_outer")
    return out.unionByName(_count(told, "statement", ~(F.col("qty").eqNullSafe(F.col("q")) & F.col("total_cost").eqNullSafe(F.col("c")))))


def plants(w: dict[str, DataFrame]) -> DataFrame:
    """mutation, check, planted: how many violations each twin must show, counted from what was planted."""
    one = lambda name, check, df, n: df.agg(n.alias("planted")).select(F.lit(name).alias("mutation"), F.lit(check).alias("check"), "planted")
    live = w["valued"].where("mutation = 'live'")
    some = F.least(F.count("*"), F.lit(1))
    out = one("nodedupe", "applied_once", w["keys"].where("a > 0 AND b > 0"), F.coalesce(F.sum("keys"), F.lit(0)))
    out = out.unionByName(one("leak", "term_known", w["truth_terms"].join(w["leaks"], "action_id").where("term <> leaked"), F.count("*")))
    bought = w["applied"]
    out = out.unionByName(one("fill", "position", bought, some)).unionByName(one("phantom", "position", bought.where("false"), F.count("*") + 1))
    for name, check, rows in (("price", "latest_price", live.where("reason IS NULL")), ("stale", "latest_price", live.where("reason IS NULL")), ("silent_zero", "silent_zero", live.where("reason = 'no_price_in_prefix'")), ("omission", "undeclared", live.where("reason = 'no_price_in_prefix'")), ("drift", "statement", live.where("reason IS NULL"))):
        out = out.unionByName(one(name, check, rows, some))
    return out


def checks_of(tables: dict[str, DataFrame], viewpoint: int) -> DataFrame:
    """surface, lane, cell, mutation (null for live), result, checks, evaluated and expected (maps) of live data and all twins."""
    w = worlds(tables, viewpoint)
    spark = tables["fills"].sparkSession
    wanted = [(s, "live", None, c) for s, cs in CHECKS.items() for c in cs] + [(s, "twin", m, c) for m, s in SURFACE.items() for c in CHECKS[s]]
    rows = spark.createDataFrame(wanted, "surface string, cell string, mutation string, check string").withColumn("world", F.coalesce("mutation", F.lit("live")))
    found, planted = examine(w).withColumnRenamed("mutation", "world"), plants(w).withColumnRenamed("mutation", "world")
    each = rows.join(found, ["world", "check"], "left").join(planted, ["world", "check"], "left").na.fill(0, ["violations", "evaluated", "planted"])
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", c)))).alias({"violations": "checks", "planted": "expected"}.get(c, c))
    cells = each.groupBy("surface", "cell", "mutation").agg(entries("violations"), entries("evaluated"), entries("planted"))
    red = F.exists(F.map_values("checks"), lambda v: v > 0)
    none = F.exists(F.map_values("evaluated"), lambda v: v == 0)
    result = F.when(none, "UNEVALUABLE").when(red, "RED").otherwise("GREEN")
    return cells.select("surface", F.lit(1).cast("bigint").alias("lane"), "cell", "mutation", result.alias("result"), "checks", "evaluated", F.when(F.col("cell") == "twin", F.col("expected")).alias("expected"))
