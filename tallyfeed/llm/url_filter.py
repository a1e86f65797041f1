"""URL verdicts from host rules and a list of canonical URLs.

A canonical URL is host and path: the host after the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z in lower case, and what follows up to ``?`` or ``#``.
A null URL, or one without ``://``, has neither. A rule (host, path, verdict)
fits its host and all subdomains if the path starts with the rule's; of the
fitting rules the longest wins (the longer host, on ties).

Where no rule fits, the list decides: listed canonical URLs are blocked, others
allowed. A blocked Bloom filter of the list, sized from its count up to a fixed
largest size, lets possible hits
through to an exact hash join with the list; all other rows skip the join. The
join is on the canonical URL against distinct listed ones, so a frequent URL or
host makes a skewed probe side only, which adaptive execution splits.

Rules are a parameter, at most ``MAX_RULES``. Repeated rows each get their
verdict; an empty list allows all, an empty table gives no rows; input columns named like an output column (in
any case) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import blocks_for, build, probe
from .common import Plain, materialize

MAX_RULES = 1000
_SPLIT = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, keep: list[str] | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; ``listed`` has canonical URLs in its one column."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; put single URLs in the list")
    plain, new = Plain(pages), ["host", "path", "rule", "verdict"]
    kept, address = plain.kept(keep, new), F.col(plain[url])
    host, path = F.col("host"), F.col("path")
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, ruled = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    listed = materialize(Plain(listed).df.select(F.col("in_0").cast("string").alias("listed")).where("listed IS NOT NULL AND listed <> ''").distinct(), "listed")
    table = build(listed.select(F.xxhash64("listed")), blocks_for(listed.count()))
    rows = plain.df.select(*kept, host_of(address).alias("host"), path_of(address).alias("path"))
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"), F.concat("host", "path").alias("canonical")).withColumn("hash", F.when(F.col("ruled").isNull(), F.xxhash64("canonical")))
    rows = probe(rows, table, "hash", "maybe")
    sure = rows.where("NOT maybe").select(*kept, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    maybe = rows.where("maybe").join(listed, F.col("canonical") == F.col("listed"), "left")
    found = sure.unionByName(maybe.select(*kept, "host", "path", "rule", F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")))
    return plain.restore(found, new, keep)
