"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last keep the
columns of ``documents``.  Toxic documents go, then all but one of equal texts, then all but
one of each class of near-duplicates; the mixture repeats or leaves out documents so that
sources come near their targets; the last stage turns texts into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bargainry.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from bargainry.llm.common import materialize, unused
from bargainry.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones of these, gives grade 0.

    Null and empty texts score by the thresholds alone; null ids are scored, but not fitted on;
    repeated rows get the same grade; whole texts are read, however long.  Labels without two
    grades keep every document, with a warning.  An empty table gives no rows.
    """
    severity, grade = unused("severity", docs), unused("grade", docs)
    model = toxicity.fit_or_none(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    return toxicity.score(docs, model, severity=severity, grade=grade).where(F.col(grade) == 0).drop(severity, grade)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest id.

    A null text is an empty one; a null id stays only where no other has the text; of
    repeated rows one stays; all columns are kept, whatever their names.  Whole texts are
    compared, however long; an empty table gives no rows.
    """
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the smallest id.

    A null text is an empty one; texts without words are one class; null ids come last; of
    rows that tie one stays; all columns are kept, whatever their names.  Whole texts are
    compared, however long; an empty table gives no rows.
    """
    return near_dedup.deduplicate(docs, weighted=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources come near their targets, in the schedule's order.

    Documents without words go; a null source is a source; repeated rows share their copies
    evenly; rows without an id are documents like others; a text counts with all its words,
    however long; all columns are kept, whatever their names; an empty table gives no rows.
    """
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, decoded (what the ids stand for) and n_tokens, a row per row.

    A null text has no ids; texts of any length are encoded whole; rows without an id keep
    none, repeated rows stay; further columns go; an empty table gives no rows.
    """
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), back="decoded")
    return out.drop("text").withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL has no words for the fitted model, the signatures and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
