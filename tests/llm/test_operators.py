"""Each operator against a brute-force version, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from bargainry.llm import bpe, chat, common, exact_dedup, fingerprint, mixing, near_dedup, quality, queries, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long, node string"
WORDS = [f"w{i}" for i in range(40)]


def corpus(seed=1, rows=60):
    """Texts with copies, near copies, case variants, nulls, empty ones, shared passages and a long one."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))
    passage, base = text(20), text(120)
    out = [None, "", "", "One", "ONE", "Äpfel", "äpfel", passage, " \t\n ", text(4), "a b c d e", "a b c d e"]
    for i in range(rows):
        words = base.split()
        words[rng.randrange(120)] = "changed"
        out.append([text(rng.randrange(5, 80)), " ".join(words), text(10) + "\n" + passage + " " + text(5), base, base.upper()][i % 5])
    out.append(text(3000))
    return [(i * 3, t, "en", [None, "b", "a", "a"][i % 4], len(t or ""), "x", i, "y") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[20], rows[20], (None, "no id", "en", "a", 5, "x", 1, "y"), (None, rows[20][1], "en", "a", 5, "x", 1, "y")], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, docs):
    """A folder of tables for the queries; ids are whole and unique here."""
    d = str(tmp_path_factory.mktemp("sf"))
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    plain.write.parquet(f"{d}/documents.parquet")
    return d


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# 1 fingerprints


def test_fingerprint_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_fingerprint(spark, sf).collect()}
    order = sorted(docs, reverse=True)
    assert set(got) == set(docs)
    for here, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = docs[here], docs[following]
        n = len(text) // 3
        new = text[: len(text) - n] + other[:n]
        own = fingerprint.fingerprint(text.encode())
        assert got[here].n_chars == len(text) and got[here].edited_sha256 == sha(new)
        assert got[here].fingerprint == own and got[here].edited_fingerprint == fingerprint.fingerprint(new.encode())
        assert got[here].near_edited == fingerprint.likeness(own, fingerprint.fingerprint(new.encode()))
        assert got[here].near_next == fingerprint.likeness(own, got[following].fingerprint)


def test_fingerprint_likeness():
    rng = random.Random(3)
    make = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(400))
    near, far = [], []
    for _ in range(30):
        a, b = make(), make()
        prints = [fingerprint.fingerprint(x.encode()) for x in (a, fingerprint.edited(a, b), b)]
        near.append(fingerprint.likeness(*prints[:2]))
        far.append(fingerprint.likeness(prints[0], prints[2]))
    assert min(near) > 0.4 and max(far) < 0.25
    assert fingerprint.likeness(fingerprint.fingerprint(b""), fingerprint.fingerprint(b"")) == 1.0
    assert 0 <= fingerprint.likeness(fingerprint.fingerprint(b"a" * 100000), fingerprint.fingerprint(b"ab" * 9)) <= 1


def test_fingerprint_common_is_lcs():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fingerprint._common(a, b) == table[-1][-1]


def test_fingerprint_awkward(spark, docs, empty):
    out = fingerprint.compare_edits(docs)
    assert out.count() == docs.count() and fingerprint.compare_edits(empty).count() == 0
    one = docs.where("doc_id = 9")
    assert fingerprint.compare_edits(one).first().near_next == 1.0


# 2 sharding


def unit(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed)
    return ((seed >> 11) + 0.5) * 2.0**-53


def descend(key, leaves):
    def draw(level, weights):
        return min((-math.log(unit(key, f"{level}/{c}")) / w, c) for c, w in weights.items())[1]

    def weights(rows, node):
        out = defaultdict(float)
        for x in rows:
            out[getattr(x, node)] += x.weight
        return out

    region = draw("region", weights(leaves, "region"))
    rack = draw("rack", weights([x for x in leaves if x.region == region], "rack"))
    return draw("shard", weights([x for x in leaves if x.rack == rack], "shard"))


def test_sharding_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_sharding(spark, sf).collect()
    slots = defaultdict(list)
    for r in got:
        body = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.shard == descend(r.doc_id, sharding.tree(24)) and r.grown_shard == descend(r.doc_id, sharding.tree(25))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append((r.slot, unit(r.doc_id, "slot")))
    assert len(got) == len(docs)
    for s in slots.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s))) and [h for _, h in sorted(s)] == sorted(h for _, h in s)


def test_sharding_shares_and_movement(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    count = Counter(r.shard for r in sharding.descend(docs, "doc_id", sharding.tree(24), "shard").select("shard").collect())
    assert len(count) == 24 and max(count.values()) < 1.25 * 20000 / 24 and min(count.values()) > 0.78 * 20000 / 24
    for n in (24, 25, 30):
        moved = sharding.descend(sharding.descend(docs, "doc_id", sharding.tree(n), "a"), "doc_id", sharding.tree(n + 1), "b").where("a != b")
        assert {r.b for r in moved.select("b").distinct().collect()} == {n}
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in sharding.tree(24)]
    moved = sharding.descend(sharding.descend(docs, "doc_id", sharding.tree(24), "a"), "doc_id", heavier, "b").where("a != b").collect()
    region = {x.shard: x.region for x in heavier}
    assert moved and all(region[r.b] == region[5] for r in moved)


def test_sharding_awkward(spark, docs, empty):
    out = sharding.assign(docs, sharding.tree(24))
    assert out.count() == docs.count() and sharding.assign(empty, sharding.tree(24)).count() == 0
    assert all([s for s in sorted(g)] == list(range(len(g))) for g in (x.s for x in out.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect()))


# 3 exact dedup


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def decided(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keeper = keep(known) if known else None
        seen = False
        for i in ids:
            out.append((i, keeper, len(ids), i == keeper and not seen, sha(t)))
            seen = seen or i == keeper
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["largest", "smallest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, name, weak):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    digest = (lambda c: F.pmod(F.crc32(F.encode(c, "UTF-8")), F.lit(5)).cast("string")) if weak else exact_dedup.sha256
    got = exact_dedup.decide(docs, keep=name, digest=digest)
    want = decided(rows, max if name == "largest" else min)
    assert rows_of(got.drop("digest")) == sorted((w[:4] for w in want), key=repr)
    if not weak:
        assert rows_of(got) == want


def test_exact_dedup_stage(docs, empty):
    kept = exact_dedup.deduplicate(docs, keep="largest")
    assert kept.columns == docs.columns
    want = [w[0] for w in decided([(r.doc_id, r.text) for r in docs.collect()], max) if w[3]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert exact_dedup.deduplicate(empty).count() == 0 and exact_dedup.decide(empty).count() == 0


def test_exact_dedup_index(docs):
    runs = exact_dedup.flush(docs, "doc_id", "text")
    level1 = exact_dedup.compact(runs)
    (row,) = exact_dedup.find(level1, [sha("one"), "absent"]).collect()
    assert row.asDict() == {"digest": sha("one"), "keep": 9, "size": 2}
    assert exact_dedup.find(runs, [sha("one")]).count() == 2
    footers = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in level1.inputFiles()]
    assert sum(f.num_rows for f in footers) == level1.count()


def test_exact_dedup_shuffled_when_large(docs, monkeypatch):
    want = rows_of(exact_dedup.deduplicate(docs).select("doc_id", "text"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows_of(exact_dedup.deduplicate(docs).select("doc_id", "text")) == want


# 4 mixing


def test_targets():
    assert mixing.targets({"a": 100, "b": 100}, {"a": 1, "b": 1}, 1.5, 2) == {"a": 150, "b": 150}
    got = mixing.targets({"a": 10, "b": 100, "c": 1000}, {"a": 3, "b": 1, "c": 2}, 1.5, 2)
    assert got["a"] == 20 and got["b"] == 200 and got["c"] == pytest.approx(1665 - 220)
    assert mixing.targets({}, {}, 1.5, 2) == {} and mixing.targets({"a": 0}, {"a": 3}, 1.5, 2) == {"a": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_lattice_is_a_permutation(n):
    a, inverse = mixing.lattice(n)
    points = [i * a % n for i in range(n)]
    assert sorted(points) == list(range(n)) and all(p * inverse % n == i for i, p in enumerate(points))


def test_schedule_is_even(spark):
    plan = [{"source": s, "slots": n} for s, n in (("a", 300), ("b", 100), ("c", 0), ("d", 200))]
    rows = mixing.schedule(spark, plan, 8).collect()
    assert sorted(r.slot for r in rows) == list(range(600))
    order = {r.slot: r.source for r in rows}
    for upto in range(50, 600, 50):
        seen = Counter(order[i] for i in range(upto))
        assert abs(seen["a"] - upto / 2) < 6 and abs(seen["b"] - upto / 6) < 6
    for s in "abd":
        own = sorted((r.slot, r.rank) for r in rows if r.source == s)
        assert [r for _, r in own] == list(range(len(own)))


@pytest.mark.parametrize("block", [7, 256])
def test_mixing(docs, block):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mix(docs, block=block).collect()
    size = {s: sum(len(words_of(t)) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in size if s is not None)) + [None]
    goal = mixing.targets({str(i): size[s] for i, s in enumerate(order)}, {str(i): [3, 1, 2][i % 3] for i in range(len(order))}, 1.5, 2)
    by_target = {goal[str(i)]: s for i, s in enumerate(order)}
    assert sorted((r.doc_id, r["size"]) for r in got if r.doc_id is not None) == sorted((i, len(words_of(t))) for i, t, _ in rows if i is not None)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[by_target[r.target]] and 0 <= r.taken <= 2 * r["size"]
        taken[r.target] += r.taken
    assert all(total == math.floor(target) for target, total in taken.items())
    assert rows_of(mixing.mix(docs, block=block)) == sorted(map(tuple, got), key=repr)


def test_mixing_takes_a_stretch_of_each_source(spark, docs):
    """What the schedule takes is the source's shuffled words from the start on, in rounds."""
    sized = mixing._sized(docs, "doc_id", "text", "source").collect()
    taken = defaultdict(list)
    for r in mixing._taken(common.materialize(mixing._sized(docs, "doc_id", "text", "source")), 1.5, 2.0, (3, 1, 2), 16).collect():
        taken[(r.id, r.source, r.body)].append(r.taken)
    hashes = {tuple(r): h for r, h in zip(sized, [x[0] for x in spark.createDataFrame(sized, "id long, source string, size long, body long").select(common.unit_hash(F.col("id"), F.col("body"), F.lit("mix"))).collect()], strict=True)}
    for s in {r.source for r in sized}:
        own = sorted((r for r in sized if r.source == s and r["size"]), key=lambda r: (hashes[tuple(r)], r.id if r.id is not None else -1, r.body))
        total, got = sum(r["size"] for r in own), sum(sum(taken[(r.id, r.source, r.body)]) for r in {(r.id, r.source, r.body): r for r in own}.values())
        rounds, rest, start = *divmod(got, total), 0
        for r in own:
            want = rounds * r["size"] + max(0, min(start + r["size"], rest) - start)
            assert want in taken[(r.id, r.source, r.body)]
            start += r["size"]


def test_mixing_stage(docs, empty):
    out = mixing.sample(docs)
    assert out.columns == docs.columns and mixing.sample(empty).count() == 0 and mixing.mix(empty).count() == 0
    wanted, counts = Counter(), Counter(r.doc_id for r in out.collect())
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id] += math.floor(r.taken / r["size"] + 0.5) if r["size"] else 0
    assert {k: v for k, v in wanted.items() if v} == dict(counts)


# 5 chat


TALK = [
    (1, 0, "system", "be <s> kind"), (1, 1, "user", "a\\b</s>[INST]"), (1, 2, "assistant", None), (2, 5, "user", "\\l\\\\p <|user|>\n"), (2, 6, "assistant", "</s>\n<|x|>\n"),
    (3, None, None, "lone"), (4, 1, "assistant", "x"), (4, 1, "assistant", "x"), (4, 0, "user", ""), (None, 1, "user", "no conversation"), (5, 1, "a|>\nb", "role"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.linear(rows)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, role, text in TALK:
        want[c].append((t is None, t or 0, role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in sorted(want[r["conv"]])]
        bodies = [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss_spans]
        assert len(bodies) == sum(t.loss for t in r.turns)
        inner = r.formatted.replace(chat.BEGIN, "", 1)
        assert inner.count("</s>") == len(r.turns) and inner.count("<|") == len(r.turns) and "[INST]" not in inner


def test_chat_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 5, 1.0), (2, 1, 9, 0.0), (2, 2, 1, 0.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0), (3, 3, None, 0.0)]
    nodes = spark.createDataFrame(rows, "conv long, node long, parent long, score double")
    got = defaultdict(list)
    for r in chat.paths(nodes, top=2).orderBy("c", "branch", "depth").collect():
        got[(r.c, r.branch)].append(r.node)
    # means: 1-2-4 has 10/3, 1-3-5-6 has 7/4; the parent 9 is missing; 1 and 2 of the third answer each other
    assert got == {("1", 1): [1, 2, 4], ("1", 2): [1, 3, 5, 6], ("2", 1): [1, 2], ("3", 1): [3]}


def test_chat_deep_thread(spark):
    n = 300
    rows = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat.format_paths(chat.linear(rows)).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [t.text for t in out.turns] == [str(i) for i in range(n)]
    assert chat.format_paths(chat.linear(rows.where("false"))).count() == 0


# 6 bpe


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    extra = ["ΑΣ ΣΑΣ", "<|startoftext|>Hi<|endoftext|> there", "it's I'LL 's", "é ﬁ İstanbul", "日本語 1234 ½", "\x1c\x1d a\x85b c", "\U0001f642\U0001f642!!", "aaaa aaa ababab" * 40, "<|endoftext|><|endoftext|>", "x" * 3000, None]
    more = spark.createDataFrame([(1000 + i, t, "en", "a", 1, "x", 1, "y") for i, t in enumerate(extra)], SCHEMA)
    rows = bpe.decode(bpe.encode(docs.unionByName(more), path), path)
    assert rows.columns == [*docs.columns, "ids", "decoded"]
    for r in rows.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(empty, path), path).count() == 0


def test_bpe_long_words_and_rows():
    """Words on both sides of the length from which a heap orders the merges; a task holds about half a megabyte of texts at once, not 500 rows."""
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_path(), random.Random(5)
    library = Tokenizer.from_file(path)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = [" ".join(word(n, letters) for n in (1, 2, 7, 30, 63, 64, 65, 66, 200)) for letters in ("ab", "aé", "etaoinshr", "!?.", "日本語x", "e'st1") for _ in range(5)]
    texts += [" ".join(f"{word(6, 'etaoinshr')}" for _ in range(20_000)), None, ""] * 20
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    parts = list(bpe._encoder(path, "text", "ids", "back")(iter([batch])))
    rows = [row for part in parts for row in part.to_pylist()]
    assert [r["text"] for r in rows] == texts and len(parts) > 1
    assert max(part.num_rows for part in parts) < len(texts) and all(part.column("text").nbytes < 2_000_000 or part.num_rows == 1 for part in parts)
    for r in rows[:40]:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["back"] == library.decode(ids, skip_special_tokens=False)


# 7 substring dedup


def removed(rows, width):
    owner = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            owner[k] = min(owner.get(k, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w = words_of(t)
        cover = [False] * len(w)
        for p in range(len(w) - width + 1):
            if owner[tuple(w[p : p + width])] < (math.inf if i is None else i):
                cover[p : p + width] = [True] * width
        out.append((i, len(w), sum(cover), " ".join(x for x, c in zip(w, cover, strict=True) if not c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [5, 13])
@pytest.mark.parametrize("shard_bytes", [300, 10**7])
def test_substring_dedup(docs, width, shard_bytes, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard_bytes)
    got = substring_dedup.remove_repeats(docs, width=width)
    assert rows_of(got) == removed([(r.doc_id, r.text) for r in docs.collect()], width)


def test_substring_dedup_periodic(spark, empty):
    rows = [(1, "a b " * 30), (2, "b a " * 20), (3, "a " * 40), (4, "a " * 13), (5, "x " * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(df)) == removed(rows, 13)
    assert substring_dedup.remove_repeats(empty).count() == 0


# 8 toxicity


def labelled(n, seed, grades=4):
    """Texts whose grade follows the number of bad words."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rng.choice([0, 0, 0, *range(1, grades)])
        words = [rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(rng.randrange(20, 80))]
        for bad in rng.sample(["scoundrel", "knave", "wretchish", "blackguard", "villain"], g):
            words.insert(rng.randrange(len(words)), bad)
        rows.append((" ".join(words), g))
    return rows


def test_toxicity_grades():
    model = toxicity.fit_rows(*zip(*labelled(1500, 1), strict=True))
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    found = [(model.severity(t), g) for t, g in labelled(400, 2)]
    assert np.mean([s[1] == g for s, g in found]) > 0.95
    means = [np.mean([s[0] for s, g in found if g == k]) for k in range(4)]
    assert means == sorted(means) and means[0] < 0.2 and means[3] > 2.5


def test_toxicity_held_out(spark, empty):
    rows = [(i, t, g > 0) for i, (t, g) in enumerate(labelled(900, 3))]
    docs = spark.createDataFrame([(i, t, "g") for i, t, _ in rows] + [(5000, None, "g"), (5001, "", "g")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows if i % 3] + [(1, 0), (2, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, model, severity="s", grade="k").collect()}
    test = [(got[i].k > 0) == g for i, _, g in rows if i % 3 == 0]
    assert np.mean(test) > 0.97 and got[5000].k == 0 and got[5001].s == got[5000].s
    assert toxicity.score(empty, model, severity="s", grade="k").count() == 0
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels.where("toxic = 1"), "toxic")


# 9 near dedup


def jaccard(a, b, weighted=False):
    def grams(t):
        w = (t or "").split()
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    x, y = grams(a), grams(b)
    if not weighted:
        x, y = Counter(set(x)), Counter(set(y))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def near_classes(rows, weighted=False):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (words_of(rows[i][1]) and words_of(rows[j][1]) and jaccard(rows[i][1], rows[j][1], weighted) >= 0.8):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((rows[i][0], least(groups[find(i)]), len(groups[find(i)])) for i in range(len(rows))), key=repr)


def edits(seed, families=6, size=12):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        words = [f"{rng.choice(WORDS)}{rng.randrange(99)}f{f}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(999)}"
            out.append(" ".join(own))
            if rng.random() < 0.5:
                words = own
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_chains(spark, seed):
    rows = [(i, t) for i, t in enumerate(edits(seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.classes(df).select("doc_id", "class_id", "class_size")) == near_classes(rows)


def test_near_dedup_awkward(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.classes(docs)
    assert rows_of(got.select("doc_id", "class_id", "class_size")) == near_classes(rows)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in got.where("kept").collect()), key=repr)
    assert near_dedup.classes(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_dart_minhash_estimates(share):
    rng = np.random.default_rng(4)
    k, est = 200, []
    for n in (8, 100, 3000):
        both = rng.integers(0, 2**63, max(1, round(n * share)), dtype=np.uint64)
        rest = n - len(both)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, rest // 2 + i, dtype=np.uint64)]) for i in (0, rest % 2))
        one, two = near_dedup.signatures([np.unique(a), np.unique(b)], k)
        alone = near_dedup.signatures([np.unique(a)], k)[0]
        assert (one == alone).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est.append(abs((one == two).mean() - true))
    assert max(est) < 4 * math.sqrt(share * (1 - share) / k) + 0.02


def test_dart_minhash_weights():
    grams = np.array([1, 1, 1, 2, 3], np.uint64)
    assert len(near_dedup.elements(grams, True)) == 5 and len(near_dedup.elements(grams, False)) == 3
    more = np.array([1, 1, 2, 3], np.uint64)
    assert len(np.intersect1d(near_dedup.elements(grams, True), near_dedup.elements(more, True))) == 4


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame([(struct.pack(">q", a), struct.pack(">q", b)) for a, b in edges], "a binary, b binary")
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {struct.unpack(">q", r.node)[0]: struct.unpack(">q", r.label)[0] for r in near_dedup.components(df).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# 10 quality


def test_quality_held_out(spark, empty):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        words = [rng.choice(WORDS) + rng.choice("abc") for _ in range(rng.randrange(10, 90))]
        bad = rng.random() < 0.2
        if bad:
            words = [[w.upper() + "!!" for w in words], [w + "%%%" for w in words], " | ".join(words).split(), words[:3] * 20][i % 4]
        rows.append((i, " ".join(words), int(not bad)))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in rows] + [(5000, None, 1.0), (5001, "", 1.0)], "doc_id long, text string, x double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    test = [(got[i] >= 0.5) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(test) > 200 and np.mean(test) > 0.97 and got[5000] == got[5001] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(empty, model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()} == {0.5}


# shared


def test_running_before(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.random(), rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, at double, w long")
    got = common.running_before(df, ["g"], F.col("at"), [F.col("at")], F.col("w"), 7, "before").collect()
    for r in got:
        assert r.before == sum(w for g, at, w in rows if g == r.g and at < r.at)


def test_queries_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
