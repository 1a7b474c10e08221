"""Clashing names, labels that say nothing, many sources, long texts; fits against their conditions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bargainry.llm import bpe, exact_dedup, mixing, near_dedup, quality, queries, sharding, toxicity

from .test_operators import docs, empty, labelled, near_classes, rows_of, words_of  # noqa: F401

NAMES = "id _id node digest body source_key copies rows slot round turn stays region rack __id __node __part __n kept size keep run score severity grade ids decoded".split()


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["one two three", "One two three", None, "", "one two three four five six seven", "x y z", "x y z", "a b"]
    rows = [(i // 2 * 2 if i > 5 else i, t, "s", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, near_dedup.deduplicate, mixing.sample], ids=["exact", "near", "mixing"])
def test_all_columns_are_kept(clashing, stage):
    out = stage(clashing)
    assert out.columns == clashing.columns
    whole = set(rows_of(clashing))
    got = rows_of(out)
    assert got and set(got) <= whole


def test_new_columns_replace_old_ones(clashing):
    for df, new in (
        (quality.score(clashing, quality.fit_rows(np.zeros((0, 14 + quality.BINS)), np.zeros(0, bool))), {"score": 0.5}),
        (toxicity.score(clashing, toxicity.Model({}, [])), {"severity": 0.0, "grade": 0}),
        (bpe.decode(bpe.encode(clashing, queries.tokenizer_path()), queries.tokenizer_path()), {}),
    ):
        assert sorted(df.columns) == sorted(clashing.columns) and df.count() == clashing.count()
        row = df.first()
        assert all(row[k] == v for k, v in new.items())
    assert sharding.descend(clashing, "doc_id", sharding.tree(24), "shard").columns == [*clashing.columns, "shard"]


def test_encode_and_decode_in_one_pass(docs):  # noqa: F811
    path = queries.tokenizer_path()
    once, twice = bpe.encode(docs, path, back="decoded"), bpe.decode(bpe.encode(docs, path), path)
    assert once.columns == twice.columns and rows_of(once) == rows_of(twice)


def test_quality_without_labels(docs, spark):  # noqa: F811
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert {r.score for r in out.collect()} == {0.5}
    assert docs.where("doc_id is null").select(quality.held_out(F.col("doc_id")).alias("h")).first().h is False


def test_quality_is_the_same_at_every_place():
    rng = np.random.default_rng(3)
    rows = rng.random((400, 14 + quality.BINS)).astype(np.float32)
    model = quality.fit_rows(rows, rng.random(400) < 0.5, pairs=500, steps=3)
    one = quality.features(["One text, that is scored at every place. " * 9], quality.Bins())
    found = {s for n in range(1, 1001) for s in model.scores(np.repeat(one, n, axis=0)).tolist()}
    assert len(found) == 1
    mixed = np.concatenate([rows, one, rows[:77], one, one])
    assert {model.scores(mixed)[i] for i in (400, 478, 479)} == found


def test_quality_fit_is_a_minimum():
    """The fitted weights have no slope, by the loss written out pair by pair; scores follow from them."""
    rng = random.Random(3)
    texts, better = [], []
    for i in range(200):
        words = [rng.choice("abcdefgh") * 3 for _ in range(30)]
        good = rng.random() < 0.7
        texts.append(" ".join(w.upper() if not good and rng.random() < 0.4 else w for w in words))
        better.append(good if i % 10 else not good)
    rows, better = quality.features(texts, quality.Bins()), np.array(better)
    model = quality.fit_rows(rows, better, pairs=2000)
    x = (rows - model.mean) / model.scale
    draw = np.random.default_rng(0)
    first, second = draw.choice(np.flatnonzero(better), 2000), draw.choice(np.flatnonzero(~better), 2000)
    l2 = [quality.L2] * len(quality.SHAPE) + [quality.L2_WORDS] * quality.BINS

    def loss(w):
        pairs = sum(math.log1p(math.exp(-float((x[a] - x[b]) @ w))) for a, b in zip(first[:400], second[:400], strict=True)) / 400
        return pairs + sum(p * v * v / 2 for p, v in zip(l2, w, strict=True))

    model = quality.fit_rows(rows, better, pairs=2000)
    margins = (x[first] - x[second]) @ model.weights
    slope = np.array(l2) * model.weights - (x[first] - x[second]).T @ (1 / (1 + np.exp(margins))) / 2000
    assert np.abs(slope).max() < 1e-3 and loss(model.weights) < loss(np.zeros(len(l2)))
    got = model.scores(rows)
    assert got == pytest.approx([1 / (1 + math.exp(-(float(r @ model.weights) - model.cut))) for r in x])
    assert abs((got < 0.5).sum() - (~better).sum()) <= 1


def test_quality_features_by_hand():
    text = "Buy NOW now!!\nThe 2 | cats sat. sat.\nThe 2 | cats sat. sat.\n"
    words = text.split()
    n, letters = len(words), sum(len(w) for w in words)
    lines = [x for x in text.split("\n") if x]
    share = {
        "distinct": len(set(words)) / n, "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "short": sum(len(w) < 4 for w in words) / n,
        "shouted": 1 / n, "capitals": len(re.findall("[A-Z]", text)) / letters, "digits": 2 / letters, "marks": 0, "exclaimed": 2 / n, "bars": 2 / n,
        "stops": 4 / n, "lines": 3 / n, "copied_lines": 1 / 3,
    }
    want = {"words": math.log1p(n), "mean_length": letters / n} | {k: math.sqrt(v) for k, v in share.items()}
    (row,) = quality.features([text], quality.Bins())
    assert len(lines) == 3 and row[: len(quality.SHAPE)] == pytest.approx([want[k] for k in quality.SHAPE], rel=1e-5)
    assert (row[len(quality.SHAPE) :] ** 2).sum() == pytest.approx(1, rel=1e-5)


def test_toxicity_fit_meets_the_conditions_of_its_minimum():
    """Slopes of the penalised loss, written out text by text."""
    rows = labelled(300, 12)
    model = toxicity.fit_rows(*zip(*rows, strict=True), rounds=400)
    holders = Counter(w for t, _ in rows for w in toxicity.tokens(t))
    slopes, shift = Counter(), [0.0] * len(model.thresholds)
    for text, grade in rows:
        score = sum(model.weights.get(w, 0) for w in toxicity.tokens(text))
        wrong = [1 / (1 + math.exp(t - score)) - (grade > k) for k, t in enumerate(model.thresholds)]
        for w in toxicity.tokens(text):
            slopes[w] += sum(wrong)
        shift = [a + b for a, b in zip(shift, wrong, strict=True)]
    assert max(map(abs, shift)) < 0.2
    for w, n in holders.items():
        if n >= toxicity.LEAST:
            v = model.weights.get(w, 0.0)
            assert abs(slopes[w] + math.copysign(toxicity.L1, v)) < 0.1 if v else abs(slopes[w]) < toxicity.L1 + 0.1


def test_toxicity_severity_by_hand(spark):
    model = toxicity.Model({"bad": 2.0, "awfu-": 1.5}, [1.0, 3.0])
    texts = ["bad BAD day", "awfully bad", "fine", None, ""]
    got = [(r.severity, r.grade) for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    for (severity, grade), score in zip(got, [2.0, 3.5, 0, 0, 0], strict=True):
        chances = [1 / (1 + math.exp(t - score)) for t in (1.0, 3.0)]
        assert severity == pytest.approx(sum(chances)) and grade == sum(c >= 0.5 for c in chances)


def test_toxicity_bound_on_words(spark, monkeypatch):
    rows = labelled(300, 4)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0)) for i, (_, g) in enumerate(rows)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "OCCURRENCES", 20_000)
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", F.lit("fit")), "doc_id").collect()]
    held = np.cumsum([0] + [len(toxicity.tokens(rows[i][0])) for i in order])
    chosen = [rows[i] for i, before in zip(order, held, strict=False) if before < 20_000]
    want = toxicity.fit_rows([t for t, _ in chosen], [int(g > 0) for _, g in chosen])
    got = toxicity.fit(df, labels, "toxic")
    assert 20 < len(chosen) < 300 and got.weights == pytest.approx(want.weights, abs=1e-9) and got.thresholds == pytest.approx(want.thresholds)


def test_one_grade_keeps_every_document(spark, tmp_path):
    import corpus_pipeline

    rows = spark.createDataFrame([(i, f"text {i}", "en", "a", 6) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.warns(UserWarning):
        assert rows_of(corpus_pipeline.drop_toxic(spark, rows, str(tmp_path))) == rows_of(rows)
    with pytest.warns(UserWarning):
        assert {(r.severity, r.grade) for r in queries.op8_toxicity(spark, str(tmp_path)).collect()} == {(0.0, 0)}


def test_near_dedup_weighted(docs, spark):  # noqa: F811
    lines = ["a b c d e f g h i j\n" * n for n in (1, 2, 3, 10, 11, 12, 13)] + [" ".join(f"w{i % 30}" for i in range(n)) for n in (60, 66, 90, 100)]
    rows = [(i, t) for i, t in enumerate(lines)] + [(100 + (r.doc_id or 0), r.text) for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()]
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), weighted=True)
    assert rows_of(got.select("doc_id", "class_id", "class_size")) == near_classes(rows, weighted=True)
    assert near_classes(rows, weighted=True) != near_classes(rows)


def test_many_sources(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), f"s{rng.randrange(150)}") for i in range(900)] + [(5000, None, "empty"), (5001, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words_of(t))
    order = [*sorted(s for s in size if s is not None), None]
    goal = mixing.targets({i: size[s] for i, s in enumerate(order)}, {i: (3, 1, 2)[i % 3] for i in range(len(order))}, 1.5, 2)
    taken = Counter()
    source = {i: s for i, _, s in rows}
    got = mixing.mix(df, block=16).collect()
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (size[s], pytest.approx(goal[order.index(s)]))
        taken[s] += r.taken
        assert (r.first_slot is None) == (r.taken == 0)
    assert all(taken[s] == math.floor(goal[i] + 1e-9) for i, s in enumerate(order))


def test_mixture_is_in_the_order_of_the_schedule(docs):  # noqa: F811
    plain = docs.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"])
    slot = {r.doc_id: r.first_slot for r in mixing.mix(plain).collect()}
    first = []
    for r in mixing.sample(plain).select("doc_id", F.spark_partition_id().alias("p")).collect():
        if r.doc_id not in first:
            first.append(r.doc_id)
    places = [slot[i] for i in first]
    assert len(places) > 10 and places == sorted(places)


def test_long_texts(spark):
    """A text of 600,000 words beside a short one."""
    long = " ".join(f"w{i % 9973}" for i in range(600_000))
    df = spark.createDataFrame([(1, long, "a"), (2, "short text", "a"), (3, long, "a")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.keep_id) for r in exact_dedup.decide(df).orderBy("doc_id").collect()] == [(1, 1), (2, 2), (3, 1)]
    assert [(r.doc_id, r.class_id) for r in near_dedup.classes(df, weighted=True).orderBy("doc_id").collect()] == [(1, 1), (2, 2), (3, 1)]
    assert {r.doc_id: r["size"] for r in sharding.assign(df, sharding.tree(24)).collect()} == {1: len(long) + 8, 2: 18, 3: len(long) + 8}
    rated = {r.doc_id: r.score for r in quality.score(df, quality.fit_rows(np.zeros((0, 14 + quality.BINS)), np.zeros(0, bool))).collect()}
    assert rated[1] == rated[3] == 0.5
    assert {r.doc_id: r.grade for r in toxicity.score(df, toxicity.Model({"w9972": 5.0}, [1.0])).collect()} == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("few", [500_000, 10])
def test_quality_is_fitted_on_every_labelled_row(spark, monkeypatch, few):
    """Mean, scale and cut are those of all labelled rows, in any number of blocks; of an id's texts one counts."""
    monkeypatch.setattr(quality, "BLOCK", 16)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", few)
    texts = [f"Plain words in a row number {i} of many." if i % 3 else f"BUY NOW!!! ${i} | $$$ | click {i}" for i in range(90)]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.features(texts, quality.Bins())
    assert np.allclose(model.mean, rows.mean(0, dtype=np.float64)) and np.allclose(model.scale, rows.std(0, dtype=np.float64) + 1e-6, atol=1e-6)
    raw = np.sort(model.raw(rows))
    assert model.cut == pytest.approx((raw[29] + raw[30]) / 2)
    assert ((model.scores(rows) >= 0.5) == [i % 3 > 0 for i in range(90)]).all()
