"""The trie against one of dictionaries; the loser tree against a sort."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bargainry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, conv string, part int, n long"


def brute(convs):
    """Nodes of {conv: [(role, text), ...]}."""
    members = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        own = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += own
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    """{conv: turns} in the order that the operator states."""
    convs = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 1, 2) for r in rows], SCHEMA)


def conversations(seed):
    """Shared starts, copies, turns of a number twice or of none, nulls, a long conversation, repeated rows, a very long text."""
    rng = random.Random(seed)
    rows = []
    for c in range(140):
        if c % 13 == 5:
            continue
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"{'same start' if rng.random() < 0.7 else rng.randrange(3)} {t}"))
    for c in range(200, 260):  # copies
        rows += [(c, t, "user", f"copied {t}") for t in range(5)]
    for c in (400, 401, 402):  # long ones, two of which are alike up to near their ends
        rows += [(c, t, "user", f"of many {t if c < 402 or t < 17 else -t}") for t in range(40 + c - 400)]
    rows += [(300, None, None, "no number"), (300, 1, "user", None), (300, 1, "assistant", ""), (300, None, "user", ""), (301, 5, "", "x"), (301, 5, "", "x"), (302, 5, "user", "a b\tc\n d " * 3000)]
    rows += [(None, 0, "user", "of nobody"), (None, 1, "user", "of nobody"), (320, 0, "user", "x"), (-3, 0, "user", "below"), (-3, 1, "user", "zero")]
    rows += [(c, 0, "user", f"alone {c}") for c in range(421, 440)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("segment", "ranges"), [(64, 1), (64, 9), (3, 6), (1, 2), (4, 40)])
def test_trie(spark, segment, ranges):
    rows = conversations(segment)
    got = prefix_trie.trie(*prefix_trie.turns(table(spark, rows)), segment=segment, ranges=ranges)
    assert got.dtypes == [(c, "bigint") for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ordered(rows))


@pytest.mark.parametrize(("segment", "ranges"), [(64, None), (2, 5)])
def test_rebuilt(spark, segment, ranges):
    rows = [r for r in conversations(7) if r[0] is None or r[0] >= 0]
    conv = F.col("conv")
    turns = prefix_trie.with_heads(*prefix_trie.turns(table(spark, rows)), conv - conv % 20, F.crc32(conv.cast("string")) % 4, most=3)
    got = prefix_trie.trie(*turns, segment=segment, ranges=ranges)
    convs = rebuilt(ordered(rows))
    assert [] in convs.values()  # turnless ones
    assert sorted(map(tuple, got.collect()), key=str) == brute(convs)


def test_none_and_only_turnless(spark):
    assert prefix_trie.trie(*prefix_trie.turns(table(spark, []))).count() == 0
    assert prefix_trie.trie(*prefix_trie.turns(table(spark, [(None, 1, "user", "x")]))).count() == 0
    lengths = spark.createDataFrame([(5, 0), (12, 0)], "conv long, n_turns long")
    none = spark.createDataFrame([], "conv long, depth long, key binary, words long")
    assert list(map(tuple, prefix_trie.trie(none, lengths).collect())) == brute({5: [], 12: []})


def test_loser_tree():
    rng = random.Random(0)
    for k in range(9):
        keys = list({b"".join(bytes([rng.randrange(3)]) * 32 for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 90))})
        deal = [[x for x in keys if zlib.crc32(x) % max(1, k) == i] for i in range(k)]
        runs = []
        for own in deal:
            order, steps = prefix_trie.run_of(own)
            runs.append(([own[i] for i in order], steps))
        got = list(prefix_trie.merge(runs))
        want = sorted(keys) if k else []
        assert [runs[r][0][i] for r, i, _ in got] == want
        assert [n for _, _, n in got] == [0, *(prefix_trie.shared(a, b) for a, b in zip(want, want[1:], strict=False))][: len(want)]


def test_the_loser_tree_compares_each_shared_turn_once(monkeypatch):
    keys = [b"\1" * 32 * 50 + i.to_bytes(32, "big") for i in range(256)]
    runs = [(own, prefix_trie.run_of(own)[1]) for own in (keys[i::8] for i in range(8))]
    looked, plain = [], prefix_trie.shared
    monkeypatch.setattr(prefix_trie, "shared", lambda a, b, at=0: (looked.append((n := plain(a, b, at)) - at), n)[1])
    assert len(list(prefix_trie.merge(runs))) == 256
    assert sum(looked) <= 7 * 51  # what the first keys of the runs share; after that, LCPs say it
