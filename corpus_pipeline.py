"""From raw documents to packed token windows: quality, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, whatever other columns these hold: operators see
them under names of their own. ``run`` writes each stage's result as Parquet to
the shared folder and reads it back as the next one's docs. Empty tables, nulls
and repeated rows are handled as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfeed.llm.common import Plain, materialize, read_table
from tallyfeed.llm.decontaminate import decontaminate
from tallyfeed.llm.near_dedup import near_duplicates
from tallyfeed.llm.packing import pack
from tallyfeed.llm.pii import find_pii
from tallyfeed.llm.quality import score_quality
from tallyfeed.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    plain = Plain(docs)
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias(plain["doc_id"]), "quality")
    return plain.restore(score_quality(plain.df, labels, text=plain["text"], doc_id=plain["doc_id"]).where("predicted = 1"), [])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one of the smallest doc_id.

    Repeated rows and rows without an id are members like others; rows without words stay.
    """
    plain = Plain(docs)
    # rows are told apart by a key of their own; written once, so that it stays
    rows = materialize(plain.df.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    classes = near_duplicates(rows, k=5, threshold=(80, 100), keep=["row", plain["doc_id"]], text=plain["text"], doc_id="row")
    first = F.min(F.struct(F.col(plain["doc_id"]).isNull().alias("none"), F.col(plain["doc_id"]).alias("id"), "row"))
    stay = classes.groupBy("component_id").agg(first.alias("x")).select("x.row")
    return plain.restore(rows.join(stay, "row", "left_semi"), [])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    plain = Plain(docs)
    return plain.restore(decontaminate(plain.df, read_table(spark, sf_dir, "benchmark"), text=plain["text"]).where("NOT contaminated"), [])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows the text."""
    plain = Plain(docs)
    text = plain["text"]
    found = find_pii(plain.df, text=text, redact=True).withColumn(text, F.when(F.col(text).isNotNull(), F.col("redacted")))
    if "n_chars" in docs.columns:
        n_chars = plain["n_chars"]
        found = found.withColumn(n_chars, F.length(text).cast(docs.schema["n_chars"].dataType))
    return plain.restore(found, [])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 token ids."""
    there = {c.lower() for c in docs.columns}
    return pack(docs, tokenizer_path(), keep=[c for c in ("doc_id", "source") if c in there])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
#: Classifier scores, tokens and model-chosen spans are beyond SQL; tests/llm/test_pipeline.py holds the stages against what each must do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
