"""Substring deduplication by repeated-phrase automata.

A window is ``width`` consecutive words of one document.  A word goes if a window covers it
whose words also start in a document with a smaller id; windows are judged on the input.

1. Seeds.  Of the runs of ``SEED`` words inside a window, the one with the smallest hash is
   the window's seed.  Equal windows have equal seeds, and there is a seed for about every
   fifth word.  A task first looks for seeds that its own batch of documents shares: those
   are settled there, and one row stands for all of them.  The rest meet in one shuffle by
   seed; a seed with two rows or more recurs.
2. Confirmation.  Documents are dealt to shards.  A shard names its windows with recurring
   seeds by 96 bits of two hashes and sends a row for each: the smallest id among its
   documents that have it, the place there, and whether others of them have it too.  The
   smallest id over all shards owns the window.  Documents whose whole text a smaller id has
   too take no part: all of their windows are owned by others.
3. Automata.  A shard gets the places of the windows that it has to remove somewhere: those
   that some document of its own holds and a smaller id owns.  It reads the words there;
   windows that stand side by side make a phrase.  A phrase is cut into pieces of
   (width + 1) / 2 words, so that each of its windows holds a whole piece, and the pieces are
   compiled into one Aho-Corasick automaton.  All documents of the shard stream through it,
   but for the whole copies.  Where it reports a piece, the words around it are compared with
   those around the pieces of the phrases, all windows at once or else one by one.  Nothing
   else finds an occurrence.

In a shard, windows are the same only if their words are.  Between shards they are the same
if 96 bits are: with 10^13 windows some 10^-3 pairs of different windows can be expected to
share them.  Of such a pair in two shards, the window of the larger id would go as well; in
one shard, one of the two would not be looked for.  What a shard holds is bounded by
``SHARD_BYTES`` of text (or one document); the number of shards follows the size of the input.  A window that is in every shard meets in one
task with a row of 24 bytes a shard, which Spark spills.

Defined results: a null text has no words; a null id comes after all ids, so its windows go
if any id holds them and it owns none over an id; rows that share an id do not count as
smaller than each other; texts of any length are read whole, and a shard grows to the longest
one; empty tables give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, map_batches, materialize, semi_by_size, text_or_empty
from .words import WordHashes, runs, sliding, split

WIDTH = 13
SEED = 5
SHARD_BYTES = 4_000_000
#: Documents whose shared seeds are settled in their task, in number and in bytes.
SETTLED, SETTLED_BYTES = 10_000, 32_000_000
_LAST = 2**63 - 1
#: The base of the second hash.
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def _arrays(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy() for n in names]


def _seed_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The seed of each window: the least hash among its runs of ``SEED`` words, or the one of a narrow window."""
    size = min(SEED, width)
    grams = runs(hashes, size)
    return sliding(grams, width - size + 1) if len(grams) > width - size else grams[:0]


def _seeds(width: int):
    """Rows (seed, id, settled); see step 1."""

    def settle(found: list[np.ndarray], ids: list[int]) -> Iterator[pa.RecordBatch]:
        seed = np.concatenate([*found, np.empty(0, np.uint64)])
        owner = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
        order = np.argsort(seed, kind="stable")
        seed, owner = seed[order], owner[order]
        first = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
        shared = ~first
        shared[:-1] |= ~first[1:]
        out_seed = np.concatenate([seed[first], seed[shared]]).view(np.int64)
        out_id = np.concatenate([owner[first], owner[shared]])
        settled = np.repeat([False, True], [first.sum(), shared.sum()])
        for at in range(0, len(out_seed), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(out_seed[part]), pa.array(out_id[part]), pa.array(settled[part])], ["seed", "id", "settled"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        found, ids, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found.append(np.unique(_seed_of(words.of(split(text)), width)))
                ids.append(i)
                size += len(text)
                if len(ids) >= SETTLED or size >= SETTLED_BYTES:
                    yield from settle(found, ids)
                    found, ids, size = [], [], 0
        yield from settle(found, ids)

    return find


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (settled, seed): the settled ones, and those whose seed has company."""
    held: tuple[int, int] | None = None  # the last row, not told yet
    told = False  # whether its seed has had company
    for batch in batches:
        seed, owner, settled = _arrays(batch, "seed", "id", "settled")
        keep = settled.copy()
        same = (seed[1:] == seed[:-1]) & ~settled[1:] & ~settled[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        out_seed, out_id = [], []
        if held is not None and len(seed):
            if not settled[0] and seed[0] == held[0]:
                keep[0] = True
                told = True
            if told:
                out_seed.append(held[0])
                out_id.append(held[1])
            held = None
        if len(seed) and not settled[-1]:
            held, told = (int(seed[-1]), int(owner[-1])), bool(keep[-1])
            keep[-1] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.array(out_seed, np.int64), seed[keep]])), pa.array(np.concatenate([np.array(out_id, np.int64), owner[keep]]))], ["seed", "id"]
        )
    if held is not None and told:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], ["seed", "id"])


def _windows(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, of 64 and of 32 bits."""
    return runs(hashes, width), (runs(hashes, width, _CHECK) >> np.uint64(32)).astype(np.uint32)


def _confirm(width: int):
    """(window, low, packed) for the windows of a shard's documents with recurring seeds; ``packed`` has check, at and more."""

    def windows(docs: pa.Table, seeds: pa.Table) -> pa.Table:
        words, parts = WordHashes(), []
        seed, owner, copy = _arrays(seeds, "seed", "id", "copy")
        copies = set(zip(owner[copy].tolist(), seed[copy].tolist(), strict=True))
        seed, owner = seed[~copy], owner[~copy]
        order = np.argsort(owner, kind="stable")
        seed, owner = seed[order].view(np.uint64), owner[order]
        if docs.num_rows and len(seed):
            docs = docs.sort_by("id")  # so that a stable sort by window leaves the ids in order
            for i, text in zip(docs.column("id").to_pylist(), docs.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                low, high = np.searchsorted(owner, i, "left"), np.searchsorted(owner, i, "right")
                if low == high or (copies and (i, _text_hash(text)) in copies):
                    continue
                hashes = words.of(split(text))
                hit = np.flatnonzero(np.isin(_seed_of(hashes, width), seed[low:high]))
                window, check = _windows(hashes, width)
                parts.append((window[hit], check[hit], np.full(len(hit), i, np.int64), hit.astype(np.int64)))
        kinds = (np.uint64, np.uint32, np.int64, np.int64)
        window, check, ids, at = (np.concatenate([*(p[n] for p in parts), np.empty(0, kind)]) for n, kind in enumerate(kinds))
        order = np.argsort(window, kind="stable")
        window, check, ids, at = window[order], check[order], ids[order], at[order]
        # windows that share 64 bits may part a run of equal ones; each part then has a row
        same = (window[1:] == window[:-1]) & (check[1:] == check[:-1])
        first = np.flatnonzero(np.append(True, ~same)[: len(window)])
        last = np.flatnonzero(np.append(~same, True)[: len(window)])
        give_back()
        packed = (check[first].astype(np.int64) << 32) | (at[first] << 1) | (ids[last] > ids[first])
        return pa.table({"window": window[first].view(np.int64), "low": ids[first], "packed": packed})

    return windows


class Piece:
    """The windows around one piece of the phrases.

    ``spans`` has, by the number of words before the piece and the length, the words of whole
    spans and the owners of their windows; ``windows`` has the owner of each single window.
    """

    def __init__(self) -> None:
        self.spans: dict[tuple[int, int], dict[tuple, tuple[int, ...]]] = {}
        self.windows: dict[tuple, int] | None = None

    def add(self, before: int, words: tuple, owners: tuple[int, ...]) -> None:
        found = self.spans.setdefault((before, len(words)), {})
        known = found.get(words)
        found[words] = owners if known is None else tuple(map(min, known, owners))

    def owner(self, window: tuple, default: int) -> int:
        if self.windows is None:
            self.windows = {}
            width = len(window)
            for found in self.spans.values():
                for words, owners in found.items():
                    for n, who in enumerate(owners):
                        key = words[n : n + width]
                        self.windows[key] = min(who, self.windows.get(key, who))
        return self.windows.get(window, default)


def _phrases(parted: list[list[bytes]], ids: list[int], wanted: pa.Table, width: int, numbers: dict[bytes, int]):
    """The automaton of pieces, and the windows around each piece."""
    piece = (width + 1) // 2
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    pieces: list[Piece] = []
    low, at, check, owner = _arrays(wanted, "low", "at", "check", "owner")
    order = np.lexsort((at, low))
    low, at, check, owner = low[order], at[order], check[order].view(np.uint32), owner[order]
    hashes = WordHashes()
    repeated = {i for i, n in Counter(ids).items() if n > 1}
    for words, i in zip(parted, ids, strict=True):
        begin, end = np.searchsorted(low, i, "left"), np.searchsorted(low, i, "right")
        if begin == end:
            continue
        places, owners = at[begin:end], owner[begin:end]
        if i in repeated:  # the places are those of one of the rows that share the id
            known = _windows(hashes.of(words), width)[1]
            fits = places < len(known)
            fits[fits] = known[places[fits]] == check[begin:end][fits]
            places, owners = places[fits], owners[fits]
            if not len(places):
                continue
        breaks = np.flatnonzero(np.diff(places) != 1) + 1
        for stretch, owned in zip(np.split(places, breaks), np.split(owners, breaks), strict=True):
            start, count, owned = int(stretch[0]), len(stretch), owned.tolist()
            phrase = tuple([numbers.setdefault(w, len(numbers) + 1) for w in words[start : start + count + width - 1]])
            # window s holds the piece that begins at the next multiple of its length
            for cut in range(0, count + piece - 1, piece):
                first, last = max(0, cut - piece + 1), min(cut, count - 1)
                key = phrase[cut : cut + piece]
                n = automaton.get(key, len(pieces))
                if n == len(pieces):
                    automaton.add_word(key, n)
                    pieces.append(Piece())
                pieces[n].add(cut - first, phrase[first : last + width], tuple(owned[first : last + 1]))
    return automaton, pieces


def _hits(automaton, pieces: list[Piece], told: tuple, i: int, width: int) -> list[int]:
    """Where the windows begin that a smaller id owns."""
    piece, last, starts = (width + 1) // 2, len(told) - width, []
    for end, n in automaton.iter(told):
        begin = end - piece + 1
        least, most = max(0, end - width + 1), min(begin, last)
        around = pieces[n]
        for (before, length), found in around.spans.items():
            s = begin - before
            if s >= 0 and (owners := found.get(told[s : s + length])):
                starts += [s + k for k, who in enumerate(owners) if who < i]
                if s <= least and s + len(owners) > most:
                    break
        else:
            starts += [s for s in range(least, most + 1) if around.owner(told[s : s + width], i) < i]
    return starts


def _text_hash(text: bytes) -> int:
    """As Spark's xxhash64 of a text."""
    value = xxhash.xxh64_intdigest(text, 42)
    return value - (1 << 64) if value >> 63 else value


def _remove(width: int):
    """Step 3 for one shard."""

    def remove(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        ids = docs.column("id").to_pylist()
        texts = docs.column("text").cast(pa.large_binary()).to_pylist()
        whole = wanted.filter(pc.less(wanted.column("at"), 0))
        copies = set(zip(whole.column("low").to_pylist(), whole.column("owner").to_pylist(), strict=True))
        parted = [split(t) for t in texts]
        copied = [bool(copies) and (i, _text_hash(t)) in copies for i, t in zip(ids, texts, strict=True)]
        del texts
        numbers: dict[bytes, int] = {}
        automaton, pieces = _phrases(parted, ids, wanted.filter(pc.greater_equal(wanted.column("at"), 0)), width, numbers)
        if pieces:
            automaton.make_automaton()
        kept, removed, number = [], [], numbers.get
        for i, words, copy in zip(ids, parted, copied, strict=True):
            gone = 0
            if len(words) >= width and copy:
                gone, words = len(words), []
            elif len(words) >= width and pieces:
                starts = _hits(automaton, pieces, tuple([number(w, 0) for w in words]), i, width)
                if starts:
                    places = np.unique(np.array(starts))
                    edges = np.zeros(len(words) + 1, np.int64)
                    edges[places] += 1
                    edges[places + width] -= 1
                    stay = np.cumsum(edges[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = list(compress(words, stay.tolist()))
            kept.append(b" ".join(words))
            removed.append(gone)
        give_back()
        return pa.table(
            {
                "key": docs.column("key"),
                "n_words": pa.array([len(w) for w in parted], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
            }
        )

    return remove


def _whole_copies(plain: DataFrame) -> DataFrame:
    """(id, h): rows whose text a smaller id has too, with a hash of the text."""
    rows = plain.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("h"))
    firsts = materialize(rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    return semi_by_size(rows, firsts, ["digest"], "inner").where("id > first").select("id", "h").distinct()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key``, n_words, n_removed, kept (the words that stay, joined by spaces)."""
    plain = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), text_or_empty(F.col(text)).alias("text")
    )
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    seeds = map_batches(plain.select("id", "text"), _seeds(width), "seed long, id long, settled boolean")
    meeting = F.when(F.col("settled"), F.xxhash64("id", "seed")).otherwise(F.col("seed"))
    recurring = map_batches(seeds.repartition(meeting).sortWithinPartitions("settled", "seed"), _recurring, "seed long, id long")
    sharded = plain.withColumn("shard", shard)
    grouped = sharded.groupBy("shard")
    copies = materialize(_whole_copies(plain)).withColumn("shard", shard)
    asked = recurring.select(shard.alias("shard"), "seed", "id", F.lit(False).alias("copy")).unionByName(copies.select("shard", F.col("h").alias("seed"), "id", F.lit(True).alias("copy")))
    windows = grouped.cogroup(asked.groupBy("shard")).applyInArrow(_confirm(width), "window long, low long, packed long")
    check = F.shiftright("packed", 32).cast("int")
    owner = F.min("low").over(Window.partitionBy("window", check))
    wanted = windows.withColumn("owner", owner).where((F.col("owner") < F.col("low")) | (F.col("packed").bitwiseAND(F.lit(1)) == 1))
    at = F.shiftright(F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    wanted = wanted.select(F.pmod(F.xxhash64("low"), F.lit(shards)).cast("int").alias("shard"), "low", at.alias("at"), check.alias("check"), "owner")
    wanted = wanted.unionByName(copies.select("shard", F.col("id").alias("low"), F.lit(-1).alias("at"), F.lit(0).alias("check"), F.col("h").alias("owner")))
    out = grouped.cogroup(wanted.groupBy("shard")).applyInArrow(_remove(width), "key long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)
