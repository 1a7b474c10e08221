"""The stages one after the other, each on what the one before has kept."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from bargainry.llm import exact_dedup, mixing, near_dedup, toxicity

from .test_operators import SCHEMA, corpus, labelled


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    rows = [r[:5] for r in corpus()]
    bad = [(1000 + i, t, "en", "c", len(t)) for i, (t, _) in enumerate(labelled(200, 9))]
    spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(g > 0)) for i, (_, g) in enumerate(labelled(200, 9)) if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    clean = {r.doc_id for r in docs.collect() if model.severity(r.text)[1] == 0}
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(stage(spark, after[-1], sf).cache())
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in after]
    assert all(df.columns == docs.columns for df in after[:5])
    assert set(ids[1]) == clean and set(range(0, 200, 3)) <= set(ids[1])
    assert ids[2] == sorted(r.doc_id for r in exact_dedup.decide(after[1], keep="largest").where("kept").collect())
    assert ids[3] == sorted(r.doc_id for r in near_dedup.classes(after[2]).where("kept").collect())
    want = [r.doc_id for r in mixing.mix(after[3]).where("size > 0").collect() for _ in range(int(r.taken / r["size"] + 0.5))]
    assert ids[4] == sorted(want) and ids[5] == ids[4]
    assert after[5].where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == ids[5]


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, sf).count() == 0, name
