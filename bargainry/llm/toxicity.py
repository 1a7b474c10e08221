"""Toxicity by cumulative-link ordinal regression.

A grade y out of 0..K-1 follows P(y > k) = sigmoid(w.x - t_k) with one weight vector w for
all of the ordered thresholds t_0 < t_1 < ...; x marks the words and stems of a text
(1 if it occurs).
The weights are sparse (an L1 penalty, by coordinate descent), so a few words carry
the score.  A text's expected severity is the sum over k of P(y > k).

The fit uses at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, and of
these the first that have up to ``OCCURRENCES`` words and stems together (the row that passes
the bound is the last); of these, the words and stems that ``LEAST`` texts or more hold.  Texts
become words in tasks, words are counted there, and the driver gets the numbers of the texts
that hold a word, 4 bytes an occurrence.  Grades are whatever integers the labels have; two
grades give one threshold.  Scoring reads every whole text.

Defined results: a null or empty text scores by the thresholds alone; labels that are null
or without a document are ignored and take no place in the sample, as are repeated labels of
one id after the largest grade; of documents that share an id the fit reads the smallest text;
labels with fewer than two grades end the fit with ``OneGrade``, unless there are no documents:
then the model is empty.  The empty model gives severity and grade 0.  Texts of any length are
scored whole, 1000 at a time; all columns of the documents are kept by ``score``, but for those
that the new ones are named like, which they replace.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import map_batches, materialize

SAMPLE = 8_000
OCCURRENCES = 8_000_000
STEMS = (4, 5, 6, 7)
LEAST = 3
L1 = 2.0
_TOKEN = regex.compile(r"\w+")


def tokens(text: str | None) -> set[str]:
    """The words of the text, and the first letters of its longer words (a stem, with a hyphen)."""
    words = set(_TOKEN.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in STEMS))


class OneGrade(ValueError):
    """The labels do not tell two grades apart."""


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def severity(self, text: str | None) -> tuple[float, int]:
        """Expected severity, and the number of thresholds passed with a chance of one half or more."""
        known = self.weights.keys() & tokens(text)
        score = sum(self.weights[w] for w in sorted(known))
        chances = [1 / (1 + np.exp(-np.clip(score - t, -500, 500))) for t in self.thresholds]
        return float(sum(chances)), sum(int(c >= 0.5) for c in chances)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _descend(row: np.ndarray, edges: np.ndarray, grades: list[int], l1: float, rounds: int) -> tuple[np.ndarray, list[float]]:
    """A weight for each token and the thresholds; token j is in the texts ``row[edges[j]:edges[j + 1]]``."""
    levels, n = sorted(set(grades)), len(edges) - 1
    if len(levels) < 2:
        raise OneGrade("ordinal regression needs two grades or more")
    above = np.searchsorted(levels, grades)[:, None] > np.arange(len(levels) - 1)[None, :]
    rate = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    w, t, s = np.zeros(n), np.log((1 - rate) / rate), np.zeros(len(grades))
    for _ in range(rounds):
        moved = 0.0
        pull = (_sigmoid(s[:, None] - t) - above).sum(1)
        gradient = np.add.reduceat(pull[row], edges[:-1]) if n else w
        for j in np.flatnonzero((w != 0) | (np.abs(gradient) > l1)).tolist():
            holders = row[edges[j] : edges[j + 1]]
            chance = _sigmoid(s[holders, None] - t)
            slope, bend = (chance - above[holders]).sum(), (chance * (1 - chance)).sum() + 1e-3
            goal = bend * w[j] - slope
            step = np.clip(np.sign(goal) * max(abs(goal) - l1, 0) / bend - w[j], -2, 2)
            w[j] += step
            s[holders] += step
            moved = max(moved, abs(step))
        for _ in range(5):
            chance = _sigmoid(s[:, None] - t)
            t = np.maximum.accumulate(t + np.clip((chance - above).sum(0) / ((chance * (1 - chance)).sum(0) + 1e-3), -1, 1))
        if moved < 1e-3:
            break
    return w, [float(x) for x in t]


def fit_rows(texts: list[str | None], grades: list[int], l1: float = L1, rounds: int = 40, least: int = LEAST) -> Model:
    """Coordinate descent on texts in memory; their number has to be bounded by the caller.

    Words are visited in the order of their hashes.
    """
    holders: dict[str, list[int]] = {}
    for n, text in enumerate(texts):
        for word in tokens(text):
            holders.setdefault(word, []).append(n)
    names = sorted((w for w, rows in holders.items() if len(rows) >= least), key=lambda w: np.uint64(xxhash.xxh64_intdigest(w, 42)).astype(np.int64))
    row = np.concatenate([np.empty(0, np.int32), *(np.array(holders[w], np.int32) for w in names)])
    w, t = _descend(row, np.cumsum([0] + [len(holders[x]) for x in names]), grades, l1, rounds)
    return Model({names[j]: float(w[j]) for j in np.flatnonzero(w)}, t)


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 100):
            part = batch.slice(first, 100)
            words = pa.array([sorted(tokens(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("grade"), words], ["id", "grade", "words"])


def fit(docs: DataFrame, labels: DataFrame, grade: str, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, l1: float = L1) -> Model:
    """Fit on at most ``sample`` labelled documents, in the order of a hash of the id."""
    graded = labels.where(F.col(grade).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(grade)).cast("int").alias("grade"))
    body = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    graded = graded.join(body.select("id").distinct(), "id", "left_semi")
    chosen = graded.withColumn("h", F.xxhash64("id", F.lit("fit"))).orderBy("h", "id").limit(sample).select("id", "grade")
    found = body.join(F.broadcast(chosen), "id").groupBy("id", "grade").agg(F.min("text").alias("text"))  # ``sample`` labels at most
    schema = T.StructType([found.schema["id"], found.schema["grade"], T.StructField("words", T.ArrayType(T.StringType()))])
    rows = materialize(map_batches(found, _tokenized, schema))
    order = Window.orderBy(F.xxhash64("id", F.lit("fit")), "id")  # ``sample`` rows at most
    before = F.coalesce(F.sum(F.size("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.select("id", "grade", before.alias("before"), (F.row_number().over(order) - 1).alias("row")).where(F.col("before") < OCCURRENCES)
    grades = [r["grade"] for r in numbered.orderBy("row").collect()]
    if not grades and docs.isEmpty():
        return Model({}, [])
    if len(set(grades)) < 2:
        raise OneGrade("ordinal regression needs two grades or more")
    held = rows.join(F.broadcast(numbered.select("id", "row")), "id").select("row", F.explode("words").alias("word"))
    # a group has a number for each text of the sample at most
    posts = held.groupBy(F.xxhash64("word").alias("h")).agg(F.sort_array(F.collect_list("row")).alias("rows")).where(F.size("rows") >= LEAST)
    got = posts.orderBy("h").toArrow()
    names, texts = got.column("h").to_numpy(), got.column("rows").combine_chunks()
    edges = np.concatenate([[0], np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    w, t = _descend(texts.flatten().to_numpy(zero_copy_only=False), edges, grades, l1, 40)
    weights = {int(names[j]): float(w[j]) for j in np.flatnonzero(w)}
    heavy = rows.select(F.explode("words").alias("word")).withColumn("h", F.xxhash64("word"))
    known = docs.sparkSession.createDataFrame([(h,) for h in weights], "h long")
    return Model({r["word"]: weights[r["h"]] for r in heavy.join(F.broadcast(known), "h").distinct().collect()}, t)


def fit_or_none(docs: DataFrame, labels: DataFrame, grade: str, **options) -> Model:
    """``fit``; with a warning, the empty model (grade 0 for all) where the labels have fewer than two grades."""
    try:
        return fit(docs, labels, grade, **options)
    except OneGrade:
        warnings.warn("no two grades among the labels: every text gets grade 0", stacklevel=2)
        return Model({}, [])


def score(docs: DataFrame, model: Model, text: str = "text", severity: str = "severity", grade: str = "grade") -> DataFrame:
    """Adds the expected severity and the grade of every whole text."""
    docs = docs.drop(severity, grade)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                rated = [model.severity(t) for t in batch.column(text).to_pylist()]
                new = [pa.array([r[0] for r in rated], pa.float64()), pa.array([r[1] for r in rated], pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, severity, grade])

    schema = T.StructType([*docs.schema.fields, T.StructField(severity, T.DoubleType()), T.StructField(grade, T.IntegerType())])
    return map_batches(docs, rate, schema)
