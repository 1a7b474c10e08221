"""The automata of substring dedup decide what goes, also where hashes of windows collide."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from bargainry.llm import substring_dedup
from bargainry.llm.words import WordHashes, split

from .test_operators import corpus, removed

WIDTH = 13


def in_process(rows, shards):
    """Steps 2 and 3 as Spark runs them, all seeds recurring."""
    tables, found = [], []
    for n in range(shards):
        own = [(i, t or "") for i, t in rows if i % shards == n]
        docs = pa.table({"key": [i for i, _ in own], "id": [i for i, _ in own], "text": [t for _, t in own], "shard": [n] * len(own)})
        pairs = {(s, i) for i, t in own for s in substring_dedup._seed_of(WordHashes().of(split(t.encode())), WIDTH).view(np.int64).tolist()}
        seeds = pa.table({"seed": pa.array([s for s, _ in pairs], pa.int64()), "id": pa.array([i for _, i in pairs], pa.int64()), "copy": pa.array([False] * len(pairs), pa.bool_())})
        tables.append(docs)
        found.append(substring_dedup._confirm(WIDTH)(docs, seeds).to_pandas())
    windows = pd.concat(found)
    packed = windows.packed.to_numpy(np.int64)
    windows["check"], windows["at"], windows["more"] = (packed >> 32).astype(np.int32), (packed & 0xFFFFFFFF) >> 1, (packed & 1) == 1
    windows["owner"] = windows.groupby(["window", "check"])["low"].transform("min")
    wanted = windows[(windows.owner < windows.low) | windows.more]
    out = []
    for n, docs in enumerate(tables):
        own = wanted[wanted.low % shards == n]
        told = pa.table({"low": own.low.to_numpy(np.int64), "at": own["at"].to_numpy(np.int32), "check": own.check.to_numpy(np.int32), "owner": own.owner.to_numpy(np.int64)})
        out += [tuple(r.values()) for r in substring_dedup._remove(WIDTH)(docs, told).to_pylist()]
    return sorted(out, key=repr)


def rows():
    texts = [t for _, t, *_ in corpus(4)]
    long = " ".join(t for t in texts if t)
    return [(i, t) for i, t in enumerate([*texts, long + " tail", "head " + long])]


@pytest.mark.parametrize("shards", [1, 3])
def test_in_process_as_by_brute_force(shards):
    assert in_process(rows(), shards) == removed(rows(), WIDTH)


def test_window_hashes_of_four_bits(monkeypatch):
    both = substring_dedup._windows

    def weak(hashes, width):
        window, check = both(hashes, width)
        return window & np.uint64(15), check

    monkeypatch.setattr(substring_dedup, "_windows", weak)
    assert in_process(rows(), 3) == removed(rows(), WIDTH)


@pytest.mark.parametrize("answer", ["nothing", "anything"])
def test_another_automaton_gives_another_result(monkeypatch, answer):
    class Dummy:
        def iter(self, words):
            return iter([]) if answer == "nothing" else ((e, 0) for e in range((WIDTH + 1) // 2 - 1, len(words)))

        def make_automaton(self):
            pass

    phrases = substring_dedup._phrases
    monkeypatch.setattr(substring_dedup, "_phrases", lambda *a: (Dummy(), phrases(*a)[1]))
    assert in_process(rows(), 3) != removed(rows(), WIDTH)


def test_long_and_repetitive_texts():
    plain = [(1, "a b c d e f g h " * 5000), (2, "x " * 40_000), (3, "y " + "a b c d e f g h " * 300), (4, "x " * 14), (5, "word " * 12)]
    assert in_process(plain, 2) == removed(plain, WIDTH)
