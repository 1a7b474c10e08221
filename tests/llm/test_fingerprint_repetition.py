"""Fingerprints of texts that repeat a line."""

import random

import pytest

from pyspark.sql import functions as F

from bargainry.llm.fingerprint import PIECES, _neighbours, compare_edits, edited, fingerprint, likeness


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


LINES = ["The same line again and again, to the end.\n", "All rights reserved 2024.\n", "ab", "a"]


@pytest.mark.parametrize("line", LINES)
def test_pieces_cover_the_text_evenly(line):
    text = line * (80_000 // len(line))
    other = text[: len(text) // 10] + prose(14_000, 1)[: len(text) * 9 // 10]
    assert len(fingerprint(text.encode()).split(":")[1]) <= 4 * PIECES
    assert likeness(fingerprint(text.encode()), fingerprint(other.encode())) < 0.3


@pytest.mark.parametrize("line", LINES)
def test_two_thirds_are_shared(line):
    text = line * (80_000 // len(line))
    new = edited(text, prose(14_000, 2))
    assert 0.5 < likeness(fingerprint(text.encode()), fingerprint(new.encode())) < 0.8


def plain(text):
    """The fingerprint by loops over positions."""
    if not text:
        return "1::"
    factors, low = (0x01000193, 0x85EBCA6B, 0xC2B2AE35), 2**32
    hashes = []
    for i in range(len(text)):
        out = 0
        for k in range(min(8, i + 1)):
            term = text[i - k] + 1
            for bit, factor in enumerate(factors):
                if k >> bit & 1:
                    term *= factor
            out += term
        out %= low
        out = (out ^ out >> 15) * 0x9E3779B1 % low
        hashes.append(out ^ out >> 13)
    block = 1
    while block * 64 < len(text):
        block *= 2
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(size):
        said, start, piece = "", 0, 0
        for i, h in enumerate(hashes):
            piece = (piece + (h * h + h) * 0xD6E8FEB86659FD93) % 2**64
            long = i - start + 1
            if i == len(hashes) - 1 or (long >= max(1, size // 2) and h < low // size) or long == 4 * size:
                two = piece * 0xD6E8FEB86659FD93 % 2**64 >> 52
                said, start, piece = said + digits[two >> 6] + digits[two & 63], i + 1, 0
        return said

    return f"{block}:{signature(block)}:{signature(2 * block)}"


@pytest.mark.parametrize("text", ["", "a", "ab", "é" * 40, "a" * 300, "ab" * 700, prose(300, 3), LINES[0] * 60 + prose(100, 4), "\0" * 65])
def test_fingerprint_by_loops(text):
    assert fingerprint(text.encode()) == plain(text.encode())


@pytest.mark.parametrize("n", [3, 7, 20, 64, 65, 200, 900, 5000])
def test_an_end_depends_on_what_is_before(n):
    rng = random.Random(n)
    for _ in range(20):
        text = "".join(rng.choice("abc ") for _ in range(n))
        cut = len(text) - len(text) // 3
        other = text[:cut] + "".join(rng.choice("xyz\n") for _ in range(n - cut))
        fine, changed = (fingerprint(x.encode()).split(":") for x in (text, other))
        assert fine[0] == changed[0]
        shared = next((i for i, (a, b) in enumerate(zip(fine[1], changed[1], strict=False)) if a != b), 0)
        assert shared >= 2 * (cut / (4 * int(fine[0]) + 8)) // 2 * 2 - 2


def test_blocks_of_hot_ids(spark):
    """A third of the rows without an id, a third of one id: in descending order all the same, and in many blocks."""
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else i % 97, f"text {i} " + prose(6, i)) for i in range(240)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = [(r.block, r.id) for r in _neighbours(df, "doc_id", "text").where("not copy").collect()]
    assert len({b for b, i in placed if i is None}) > 2 and len({b for b, i in placed if i == 50}) > 1
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))]
    got = {r.fingerprint: r.edited for r in compare_edits(df).collect()}
    assert len(got) == len(rows)
    for here, following in zip(order, order[1:] + order[:1], strict=True):
        assert got[fingerprint(here.encode())] == edited(here, following)
