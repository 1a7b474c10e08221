"""What the fit of toxicity reads."""

import corpus_pipeline
import pytest

from bargainry.llm import queries, toxicity

from .test_operators import labelled


def tables(spark, rows, more=()):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + list(more), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(g > 0)) for i, (_, g) in enumerate(rows)], "doc_id long, toxic int")


def test_fit_agrees_with_texts_in_memory(spark):
    rows = labelled(300, 4)
    model, plain = toxicity.fit(*tables(spark, rows), "toxic"), toxicity.fit_rows([t for t, _ in rows], [int(g > 0) for _, g in rows])
    assert max(abs(model.severity(t)[0] - plain.severity(t)[0]) for t, _ in rows) < 0.02
    assert [model.severity(t)[1] for t, _ in rows] == [plain.severity(t)[1] for t, _ in rows]


def test_fit_reads_one_row_of_an_id(spark):
    rows = labelled(300, 4)
    once = toxicity.fit(*tables(spark, rows), "toxic")
    assert toxicity.fit(*tables(spark, rows, [(0, rows[0][0])] * 500), "toxic") == once
    assert toxicity.fit(*tables(spark, rows, [(0, rows[0][0] + " more")] * 500), "toxic") == once


def test_labels_without_a_document_take_no_place(spark):
    rows = labelled(300, 4)
    docs, labels = tables(spark, rows)
    more = labels.unionByName(spark.range(10_000, 40_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    assert toxicity.fit(docs, more, "toxic", sample=200) == toxicity.fit(docs, labels, "toxic", sample=200)


def test_all_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tables(spark, labelled(20, 4))[1].write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert queries.op8_toxicity(spark, str(tmp_path)).count() == 0


def test_documents_without_labels_are_an_error(spark):
    docs, labels = tables(spark, labelled(20, 4))
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels.where("doc_id < 0"), "toxic")
