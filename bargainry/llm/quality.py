"""Quality scores by Bradley-Terry pairwise ranking.

A text is described by the shape of its writing (``SHAPE``) and by its words: the square root
of the share of its words, in lower case, that fall in each of ``BINS`` hash bins.  From pairs
of a better and a worse text, weights w are learned by logistic loss on the difference of
their features: P(a beats b) = sigmoid(w.(x_a - x_b)), with a larger penalty on the words'
weights than on the shape's.  The raw score w.x is then cut at the quantile that
leaves as large a share of the labelled texts below as were labelled worse, and the score
is sigmoid(w.x - cut), so 0.5 is the cut.

The fit uses every labelled row.  Their features, about 1 kB a row, are dealt to blocks of
some ``BLOCK`` rows by a hash of the id, and pairs are drawn in a block: each row of its larger
class meets ``TURNS`` of the other.  A Newton step sums slopes and bends over all blocks on
Spark; mean, scale and the cut are those of all rows.  Scoring reads every whole text.

Defined results: a null text is an empty text, which has all features 0 and the score that
follows; labels that are null or without a document are ignored, repeated labels of one id
count by the smallest; labels of one class only, or none at all, give all texts 0.5; a null
id is held out from nothing (``held_out`` is false) and never fitted on; texts of any length
are scored whole; empty documents give no rows; all columns of the documents are kept by
``score``, but for one that the new column is named like, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, map_batches, materialize, numbered, task_count

#: Labelled rows of a block, and how often a row of its larger class is paired.
BLOCK, TURNS = 1024, 2
#: Pairs that ``fit_rows`` draws.
PAIRS = 30_000
SHAPE = (
    "words", "mean_length", "distinct", "repeats", "short", "shouted", "capitals", "digits", "marks", "exclaimed", "bars", "stops", "lines", "copied_lines",
)
BINS = 256
WIDTH = len(SHAPE) + BINS
#: Penalties on the weights of the shape and of the words.
L2, L2_WORDS = 1e-3, 1e-2
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = True


class Bins(dict):
    """Word to its bin; emptied when it has grown to ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) % BINS
        return value


def shape(text: str, words: list[str]) -> list[float]:
    n, letters = len(words), sum(map(len, words))
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x]
    shares = [
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(len(w) < 4 for w in words) / n,
        sum(w.isupper() for w in words) / n,
        int(counts[65:91].sum()) / letters,
        int(counts[48:58].sum()) / letters,
        int(counts[_MARKS].sum()) / letters,
        int(counts[33]) / n,
        int(counts[124]) / n,
        int(counts[46]) / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    return [float(np.log1p(n)), letters / n, *(float(np.sqrt(x)) for x in shares)]


def features(texts: list[str | None], bins: Bins) -> np.ndarray:
    """A row for each text."""
    out = np.zeros((len(texts), len(SHAPE) + BINS), np.float32)
    for row, text in zip(out, texts, strict=True):
        if text and (words := text.split()):
            row[: len(SHAPE)] = shape(text, words)
            row[len(SHAPE) :] = np.sqrt(np.bincount(np.fromiter(map(bins.__getitem__, words), np.int64, len(words)), minlength=BINS) / len(words))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """A row's sum is its own: a matrix product would add up a row by its place among the others."""
        return ((rows - self.mean) / self.scale * self.weights).sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.cut, -500, 500)))


def _bends(gap: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over pairs, whose features differ by ``gap``, of the loss's descent and second derivatives."""
    lost = 1 / (1 + np.exp(np.clip(gap @ weights, -500, 500)))
    bent = gap * np.sqrt(lost * (1 - lost)).astype(np.float32)[:, None]
    return lost @ gap, bent.T @ bent


def fit_rows(rows: np.ndarray, better: np.ndarray, pairs: int = PAIRS, steps: int = 20) -> Model:
    """Newton steps on the mean loss of drawn pairs; the draw is the same each time."""
    width = rows.shape[1]
    if not len(rows):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = rows.mean(0, dtype=np.float64), rows.std(0, dtype=np.float64) + 1e-6
    x, good, bad = ((rows - mean) / scale).astype(np.float32), np.flatnonzero(better), np.flatnonzero(~better)
    weights, l2 = np.zeros(width), np.where(np.arange(width) < len(SHAPE), L2, L2_WORDS)
    if len(good) and len(bad):
        draw = np.random.default_rng(0)
        first, second = draw.choice(good, pairs), draw.choice(bad, pairs)
        for _ in range(steps):
            slope, bend = l2 * weights, np.diag(l2)
            for at in range(0, pairs, 4096):
                down, bent = _bends(x[first[at : at + 4096]] - x[second[at : at + 4096]], weights)
                slope, bend = slope - down / pairs, bend + bent / pairs
            step = np.linalg.solve(bend, slope)
            weights -= step
            if np.abs(step).max() < 1e-3:
                break
    ranked, worse = np.sort(x @ weights), int((~better).sum())
    cut = (ranked[worse - 1] + ranked[worse]) / 2 if 0 < worse < len(ranked) else 0.0
    return Model(mean, scale, weights, float(cut))


def _featured(text: str, out: str):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins()
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                rows = features(batch.column(text).to_pylist(), bins)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, out])

    return describe


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of block, id and text to a row for each block; of an id's rows the first."""
    held: list[tuple] = []
    for batch in batches:
        flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH)
        for block, id_, better, x in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "better")), flat, strict=True):
            if held and held[-1][0] != block:
                yield _block(held)
                held = []
            if not held or held[-1][1] != id_:
                held.append((block, id_, better, x.copy()))
    if held:
        yield _block(held)


def _block(held: list[tuple]) -> pa.RecordBatch:
    rows, better = np.array([h[3] for h in held], np.float32), np.array([h[2] for h in held], np.uint8)
    return pa.RecordBatch.from_pydict({"block": pa.array([held[0][0]], pa.int64()), "better": [better.tobytes()], "rows": [rows.tobytes()]})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The number of a block, which of its rows are better, and its features."""
    for batch in batches:
        for block, better, rows in zip(*(batch.column(c) for c in ("block", "better", "rows")), strict=True):
            yield block.as_py(), np.frombuffer(better.as_py(), np.uint8) > 0, np.frombuffer(rows.as_py(), np.float32).reshape(-1, WIDTH)


def _summed(blocks: DataFrame, length: int, of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of an array of ``length`` numbers; Spark adds up those of the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for block in _blocks(batches):
            total += of(*block)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(length, dtype=np.int32)), "n": pa.array(total)})

    found = map_batches(blocks, add, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(length)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _fitted(blocks: DataFrame, steps: int = 20) -> Model:
    upper = np.triu_indices(WIDTH)
    rows, better, sums, squares = np.split(_summed(blocks, 2 + 2 * WIDTH, lambda _, b, x: np.concatenate([[len(b), b.sum()], x.sum(0, dtype=np.float64), np.square(x, dtype=np.float64).sum(0)])), [1, 2, 2 + WIDTH])
    n, worse = int(rows[0]), int(rows[0] - better[0])
    if not n:
        return fit_rows(np.zeros((0, WIDTH)), np.zeros(0, bool))
    mean = sums / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-6
    weights, l2 = np.zeros(WIDTH), np.where(np.arange(WIDTH) < len(SHAPE), L2, L2_WORDS)
    if not 0 < worse < n:
        return Model(mean, scale, weights, 0.0)

    def paired(block: int, better: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        good, bad = np.flatnonzero(better), np.flatnonzero(~better)
        if not len(good) or not len(bad):
            return np.zeros(1 + WIDTH + len(upper[0]))
        x, most, draw = ((rows - mean) / scale).astype(np.float32), max(len(good), len(bad)), np.random.default_rng(block)
        turns = [(np.resize(draw.permutation(good), most), np.resize(draw.permutation(bad), most)) for _ in range(TURNS)]
        first, second = (np.concatenate(side) for side in zip(*turns, strict=True))
        down, bent = _bends(x[first] - x[second], weights)
        return np.concatenate([[len(first)], down, bent[upper]])

    for _ in range(steps):
        pairs, down, bent = np.split(_summed(blocks, 1 + WIDTH + len(upper[0]), lambda *block, w=weights: paired(*block, w)), [1, 1 + WIDTH])
        bend = np.zeros((WIDTH, WIDTH))
        bend[upper] = bent / max(pairs[0], 1)
        bend = bend + np.triu(bend, 1).T + np.diag(l2)
        step = np.linalg.solve(bend, l2 * weights - down / max(pairs[0], 1))
        weights = weights - step
        if np.abs(step).max() < 1e-3:
            break
    model = Model(mean, scale, weights, 0.0)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _blocks(batches):
            yield pa.RecordBatch.from_pydict({"raw": pa.array(model.raw(rows))})

    ranked = numbered(map_batches(blocks, rate, "raw double"), "raw", "place").where(F.col("place").isin(worse - 1, worse))
    model.cut = float(np.mean([r.raw for r in ranked.select("raw").collect()]))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Fit on every labelled document."""
    marked = materialize(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.min(label) > 0).alias("better")))
    body = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    n = marked.count()
    tasks = task_count(docs.sparkSession)
    block = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(-(-n // BLOCK) or 1)).alias("block")
    described = lambda rows: map_batches(rows, _featured("text", "x"), T.StructType([*rows.schema.fields, *T.StructType.fromDDL("x array<float>").fields])).withColumn("text", F.xxhash64("text"))
    # many labels are met by the features, which are narrower than the texts
    found = described(body.join(F.broadcast(marked), "id")) if n <= BROADCAST_ROWS else described(body).join(marked, "id")
    dealt = found.select(block, "id", "better", "text", "x").repartition(tasks, "block").sortWithinPartitions("block", "id", "text")
    return _fitted(materialize(map_batches(dealt.drop("text"), _packed, "block long, better binary, rows binary")))


def held_out(key: Column) -> Column:
    """A third of the ids, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    docs = docs.drop(out)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins()
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                rated = model.scores(features(batch.column(text).to_pylist(), bins))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rated)], [*batch.schema.names, out])

    return map_batches(docs, rate, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
