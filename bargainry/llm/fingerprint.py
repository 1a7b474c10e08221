"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of 8 bytes runs over the UTF-8 text; where it falls below 2**32 / block size a
piece ends, if it is half a block long, and a piece of four blocks ends anyway.  So in
repetitive texts too, where no hash or every hash is low, an end depends on the bytes since
the last one only.  Each piece gives two characters of the signature, from a hash of all its
windows.  The block size is the smallest power of two times ``SMALLEST`` of which ``PIECES``
hold the text, and the fingerprint holds the signatures at that size and at twice it:

    <block size>:<signature>:<signature at twice the block size>

Two fingerprints are compared at a block size that both have, by edit distance (pieces
inserted and deleted), as 1 - distance / (pieces of both); without such a size they are 0.

Defined results: a null text is an empty text; equal texts have equal fingerprints and
likeness 1; empty tables give no rows; repeated rows have a row each; null ids come last
in the descending order of ids, ties of ids go by text; further columns are ignored.
Whole texts are read, however long: a signature has at most 2 * ``PIECES`` pieces, and a task
holds one text's hashes at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, task_count, text_or_empty

SMALLEST = 1
PIECES = 64
#: Fixed value: the digits of base 64, in natural order.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TRIGGER, _PIECE = np.uint32(0x9E3779B1), np.uint64(0xD6E8FEB86659FD93)


def _windows(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 8 bytes up to each position."""
    out = data.astype(np.uint32) + np.uint32(1)
    for step, factor in ((1, 0x01000193), (2, 0x85EBCA6B), (4, 0xC2B2AE35)):
        nearer = out.copy()
        nearer[step:] += out[:-step] * np.uint32(factor)
        out = nearer
    out ^= out >> np.uint32(15)
    out *= _TRIGGER
    return out ^ (out >> np.uint32(13))


def _signature(sums: np.ndarray, ends: np.ndarray) -> str:
    """Two digits for each piece."""
    pieces = np.diff(sums[ends], prepend=np.uint64(0)) * _PIECE >> np.uint64(52)
    return "".join(DIGITS[p >> 6] + DIGITS[p & 63] for p in pieces.tolist())


def _ends(windows: np.ndarray, block: int) -> np.ndarray:
    """Where pieces end at a block size: at the first trigger that is half a block or more after the last end, but four blocks after it at the latest."""
    triggers = np.flatnonzero(windows <= np.uint32(2**32 // block - 1))
    ends, last, size = [], -1, len(windows)
    while True:
        at = int(np.searchsorted(triggers, last + max(1, block // 2)))
        end = min(int(triggers[at]) if at < len(triggers) else size, last + 4 * block)
        if end >= size - 1:
            return np.array([*ends, size - 1])
        ends.append(end)
        last = end


def fingerprint(text: bytes) -> str:
    if not text:
        return f"{SMALLEST}::"
    windows = _windows(np.frombuffer(text, np.uint8))
    block = SMALLEST
    while block * PIECES < len(text):
        block *= 2
    spread = windows.astype(np.uint64)
    sums = np.cumsum((spread * spread + spread) * _PIECE)
    return f"{block}:{_signature(sums, _ends(windows, block))}:{_signature(sums, _ends(windows, 2 * block))}"


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in words of bits."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    left = full
    for x in b:
        hit = left & places.get(x, 0)
        left = (left + hit | left - hit) & full
    return len(a) - left.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    return 2 * _common(x, y) / (len(x) + len(y)) if x and y else 0.0


def likeness(a: str, b: str) -> float:
    """From 0 (nothing in common, or no block size in common) to 1 (equal)."""
    if a == b:
        return 1.0
    (size_a, fine_a, coarse_a), (size_b, fine_b, coarse_b) = a.split(":"), b.split(":")
    if size_a == size_b:
        return max(_alike(fine_a, fine_b), _alike(coarse_a, coarse_b) if coarse_a and coarse_b else 0.0)
    if int(size_a) == 2 * int(size_b):
        return _alike(fine_a, coarse_b)
    if 2 * int(size_a) == int(size_b):
        return _alike(coarse_a, fine_b)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of consecutive ids, sorted descending, each followed by the next block's first row.

    The bounds of the blocks and their first ids (one per block, at most four times as many
    blocks as tasks) go through the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(F.col(text)).alias("text"))
    blocks = task_count(spark)
    shares = [i / blocks for i in range(1, blocks)]
    found = plain.agg(F.percentile_approx("id", F.array(*map(F.lit, shares))) if shares else F.lit(None)).first()[0] or []
    hot = {v: n for v, n in Counter(found).items() if n > 1}  # ids that more than a block's share of the rows have
    bounds = sorted({*found, *(v - 1 for v in hot)})
    block = F.lit(0)
    if bounds:
        # the number of bounds below the id, by halving
        def halve(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(F.col("id") > bounds[mid], halve(mid + 1, high)).otherwise(halve(low, mid))

        block = halve(0, len(bounds))
    # block 0 comes first in descending order; null ids are in a block of their own, the last
    block = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - block)
    # rows of a hot id, and those without one, are dealt to blocks by the hashes that order them
    parts = F.when(F.col("id").isNull(), F.lit(blocks))
    for v, n in hot.items():
        parts = parts.when(F.col("id") == v, F.lit(n + 1))
    parts = parts.otherwise(F.lit(1))
    part = F.least(F.floor((F.xxhash64("text").cast("double") + 2.0**63) / 2.0**64 * parts), parts - 1)
    block = (block * (blocks + 1) + part).cast("int")
    keyed = plain.withColumn("block", block)
    order = F.struct(F.coalesce(-F.col("id"), F.lit(2**63 - 1)), F.xxhash64("text"))
    firsts = keyed.groupBy("block").agg(F.min(order).alias("o")).select("block", "o.*").orderBy("block").collect()
    heads: dict[tuple, list[int]] = {}
    for here, following in zip(firsts, firsts[1:] + firsts[:1], strict=True):
        heads.setdefault(tuple(following)[1:], []).append(here["block"])
    lead = spark.createDataFrame([(k[0], k[1], b) for k, b in heads.items()] or [(0, 0, [])], "o long, h long, before array<int>")
    marked = keyed.withColumn("o", F.coalesce(-F.col("id"), F.lit(2**63 - 1))).withColumn("h", F.xxhash64("text"))
    marked = marked.join(F.broadcast(lead), ["o", "h"], "left")  # a row per block
    own = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("copy")))
    copies = F.transform(F.coalesce("before", F.array().cast("array<int>")), lambda b: F.struct(b.alias("block"), F.lit(True).alias("copy")))
    placed = marked.select("id", "text", "o", "h", F.explode(F.concat(own, copies)).alias("p")).select("p.block", "p.copy", "o", "h", "id", "text")
    return placed.repartition("block").sortWithinPartitions("block", "copy", "o", "h").select("block", "copy", "id", "text")


_SCHEMA = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before, done, size = None, [], 0
    for batch in batches:
        for block, copy, key, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            block, copy, key, text = block.as_py(), copy.as_py(), key.as_py(), text.as_py()
            if copy and before and (before[0] != block or before[4]):
                continue  # a further row that ties with the block's successor
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if before and before[0] == block and not before[4]:
                _, old_key, old_text, old_print, _ = before
                new = edited(old_text, text)
                new_print = fingerprint(new.encode("utf-8", "surrogatepass"))
                done.append((old_key, len(old_text), new, old_print, new_print, likeness(old_print, new_print), likeness(old_print, own)))
                size += len(new)
            before = (block, key, text, own, copy)
            if size > 4_000_000 or len(done) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done, size = [], 0
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and the likeness to that and the next."""
    out = map_batches(_neighbours(docs, key, text), _compare, _SCHEMA)
    return out.withColumnRenamed("id", key)
