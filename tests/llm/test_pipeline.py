"""The pipeline's stages on a small corpus whose right outcome is known."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tallyfeed.llm.common import materialize

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    item, copied = text(40), text(200).split()
    good = [text(rng.randint(60, 200)) for _ in range(200)]
    junk = [" ".join(w.upper() + "!!" for w in text(60).split()) for _ in range(100)]
    near = [" ".join(copied), " ".join(copied), " ".join([*copied[:50], "changed", *copied[51:]])]
    tainted, private = text(30) + " " + item, text(60) + " mail a.b@mail.example.com now " + text(20)
    texts = [*good, *junk, *near, tainted, private]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name], docs = {r["doc_id"] for r in out.collect()}, out
        if name == "pii":
            assert "a.b@mail" not in (cleaned := next(r["text"] for r in out.collect() if r["doc_id"] == 304)) and "<EMAIL>" in cleaned
            final = {r["doc_id"]: r["text"] for r in out.collect()}
    accepted = kept["quality"]
    assert len(accepted & set(range(200))) >= 195 and len(accepted & set(range(200, 300))) <= 5 and {300, 301, 302, 303, 304} <= accepted
    assert kept["near_dedup"] == accepted - {301, 302}
    assert kept["decontamination"] == kept["near_dedup"] - {303} == kept["pii"] == kept["packing"]
    from .test_operators import ids_of

    pieces = docs.collect()
    for doc_id, t in final.items():
        own = sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"])
        assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == ids_of(t).tolist()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_and_empty_tables(spark, tmp_path, name, stage):
    rows = [(None, None, None, None, None, "x"), (1, None, "en", "s", None, "x"), (2, "", None, "s", 0, "x"), (3, "a b c", "en", "s", 5, "x"), (3, "a b c", "en", "s", 5, "x"), (None, "a b c", "en", "s", 5, "x"), (None, "a b c", "en", "s", 5, "x"), (None, "d e", "en", "s", 3, "x"), (None, "d e", "en", "s", 3, "x")]
    clashes = ["Kept", "SCORE", "_t", "_id", "a.b", "N_Words", "predicted", "contaminated", "spans", "component_id", "row", "in_0"]
    docs = spark.createDataFrame([(*r[:5], *map(str, range(len(clashes)))) for r in rows], DOCS + "".join(f", `{c}` string" for c in clashes))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    assert sum(name != "packing" or r["start"] == 0 for r in got) == {"quality": 0, "near_dedup": 5}.get(name, 9)  # of 'a b c' and 'd e' one row each; rows without words stay
    if name == "packing":
        assert {r["source"] for r in got} == {None, "s"}
    else:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r[5 + i] == str(i) for r in got for i in range(len(clashes)))
    if name == "near_dedup":
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "d e"), (1, ""), (2, ""), (3, "a b c")]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
