"""Leaf differences of many JSON documents: flattened through Variant, a level of all documents at a time.

A document's nodes are its values by path; an object's children are its keys' values,
anything else (also a list) is a leaf. A level takes the objects of the one before it
apart, so that there are as many rounds as the deepest document has levels, whatever
the number of documents. Numbers compare as Variant reads them (1.0 is 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize

ABSENT = "<absent>"


def nodes(documents: DataFrame, id: str = "id", doc: str = "doc") -> DataFrame:
    """id, path (array of keys), leaf (boolean), text (canonical JSON of the value): every node of JSON texts; the root's path is empty.

    A text that is null or no JSON has no nodes. An empty object is a node without leaves.
    """
    level = documents.select(F.col(id).alias("id"), F.array().cast("array<string>").alias("path"), F.try_parse_json(doc).alias("v")).where("v IS NOT NULL")
    out = None
    while True:
        level = materialize(level.select("id", "path", F.schema_of_variant("v").startswith("OBJECT").alias("object"), F.to_json("v").alias("text"), "v"), "nodes")
        found = level.select("id", "path", (~F.col("object")).alias("leaf"), "text")
        out = found if out is None else out.unionByName(found)
        objects = level.where("object")
        if objects.isEmpty():
            return out
        children = objects.select("id", "path", F.explode(F.col("v").cast("map<string,variant>")).alias("key", "v"))
        level = children.select("id", F.array_append("path", F.col("key")).alias("path"), "v")


def count_leaves(documents: DataFrame, id: str = "id", doc: str = "doc") -> DataFrame:
    """id, leaves: of each document that has nodes."""
    return nodes(documents, id, doc).groupBy("id").agg(F.count_if("leaf").alias("leaves"))


def leaf_differences(golden: DataFrame, documents: DataFrame, id: str = "id", doc: str = "doc") -> DataFrame:
    """id, path (dotted), want, got: golden's leaves that the document of their id does not reproduce.

    What only the document has is ignored; where it has an object for a leaf, got is the whole object; what it lacks is ``<absent>``.
    """
    want = nodes(golden, id, doc).where("leaf").select("id", "path", F.col("text").alias("want"))
    got = nodes(documents, id, doc).select("id", "path", F.col("text").alias("got"))
    both = want.join(got, ["id", "path"], "left").withColumn("got", F.coalesce("got", F.lit(ABSENT)))
    return both.where("want <> got").select("id", F.array_join("path", ".").alias("path"), "want", "got")
