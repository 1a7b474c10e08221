"""MinHash near-deduplication with DartMinHash signatures.

A text is the set of its runs of ``shingle`` words (all of its words if there are fewer), or
with ``weighted=True`` the multiset.  Every element owns a region, as wide as its weight, on
which darts fall at hashed places and ranks, one per unit of rank and weight on average.
Darts are thrown up to the rank at which all coordinates are expected to be hit; each dart
hits one coordinate, and a coordinate keeps the dart of least rank.  A signature takes time
for its darts and elements, not for their product.  Where a coordinate was not hit, the
throwing goes on.

Signatures are cut into bands.  Texts that share a band are candidates, and a candidate is
a link if its exact similarity is ``threshold`` or more.  Equal texts are one node from the
start.  A band's group is not expanded into pairs:

1. each node is compared with one hub (the node of a group that shares most with others),
   the one it shares most bands with;
2. then with the other hubs of its groups that are in another component by then;
3. in groups that still span components, all pairs that reach the threshold are found by
   prefix filtering: elements are ordered from rare to frequent, and two sets can only reach
   it if the first few elements of both (how few follows from their sizes) have one in
   common that leaves room for the rest.  Only pairs of two components are looked at.

Links between components are so found for all candidates, while copies of one original,
however many, cost a row each.  With the default 40 bands of 5, a pair at 0.8 shares no
band with a chance of 1.3e-7.

Defined results: a null text is an empty text; texts without words are alike (one class);
null ids come after all others; repeated rows share their class; texts of any length are
sketched and compared whole; an empty table gives no rows; further columns are kept by
``deduplicate``, whatever their names, and ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, semi_by_size, text_or_empty, unused
from .words import WordHashes, mixed, runs, split

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
#: Sizes of sets are sorted into classes this factor apart for the prefix filter.
SIZE_CLASS = 1.05
_STEP, _COORDINATE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFF)


def shingles(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of words, repeats included."""
    own = hashes.of(words)
    return runs(own, min(size, len(words))) if words else own


def elements(grams: np.ndarray, weighted: bool) -> np.ndarray:
    """Distinct elements; if weighted, the n-th occurrence is an element of its own.

    Whole weights make a region of unit squares, so each square can throw its own darts.
    """
    distinct, counts = np.unique(grams, return_counts=True)
    if not weighted or not len(distinct) or counts.max() == 1:
        return distinct
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(distinct, counts) + nth.astype(np.uint64) * _COORDINATE)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """DartMinHash of each (not empty) set: an array of sets by k."""
    sizes = np.array([len(s) for s in sets])
    which = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets)
    reach = k * (np.log(k) + 4) / sizes  # up to this rank
    best = np.full(len(sets) * k, np.iinfo(np.uint64).max, np.uint64)
    dart = mixed(element + _STEP)
    rank = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    live = np.arange(len(element))
    while True:
        live = live[rank[live] < reach[which[live]]]
        while len(live):
            hit = dart[live]
            at = which[live] * k + (mixed(hit ^ _COORDINATE) % np.uint64(k)).astype(np.int64)
            # positive doubles order as their bits do; the low bits tell darts apart
            np.minimum.at(best, at, (rank[live].view(np.uint64) & ~_LOW) | (hit & _LOW))
            following = mixed(hit + _STEP)
            dart[live] = following
            rank[live] += -np.log(((following >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = live[rank[live] < reach[which[live]]]
        missed = (best.reshape(-1, k) == np.iinfo(np.uint64).max).any(1)
        if not missed.any():
            return best.reshape(-1, k)
        reach[missed] *= 2
        live = np.flatnonzero(missed[which])


def _banded(shingle: int, bands: int, rows: int, weighted: bool):
    """Rows (node, bands) of a batch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        powers = np.power(_STEP, np.arange(1, rows + 1, dtype=np.uint64))
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                nodes = batch.column("node").to_pylist()
                sets = [elements(shingles(split(t), words, shingle), weighted) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                full = sorted((n for n in range(len(sets)) if len(sets[n])), key=lambda n: len(sets[n]))
                at = 0
                while at < len(full):  # texts of like size together, some 100,000 elements at a time
                    upto, held = at, 0
                    while upto < len(full) and (upto == at or held + len(sets[full[upto]]) <= 100_000 and upto - at < 500):
                        held += len(sets[full[upto]])
                        upto += 1
                    part = full[at:upto]
                    parts = signatures([sets[n] for n in part], bands * rows).reshape(len(part), bands, rows)
                    keys = mixed((parts * powers).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _COORDINATE)
                    flat = pa.array(np.ascontiguousarray(keys).view(np.int64).reshape(-1))
                    offsets = pa.array(np.arange(len(part) + 1) * bands, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[n] for n in part]), pa.ListArray.from_arrays(offsets, flat)], ["node", "bands"])
                    at = upto

    return sketch


def _sets(shingle: int, weighted: bool):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                sets = [elements(shingles(split(t), words, shingle), weighted) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                ends = pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32())
                flat = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, flat)], ["node", "grams"])

    return describe


def node_of(text: Column) -> Column:
    """The same for equal texts: 128 bits of a digest."""
    return F.unhex(F.substring(F.sha2(text_or_empty(text), 256), 1, 32))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a, b): the least node of its component.

    Large-star and small-star steps in turn until the edges stay the same.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # the edges are distinct, so their number and the sum of their hashes tell a change
        sums = [df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() for df in (edges, after)]
        if sums[0] == sums[1]:
            break
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


class _Links:
    """Compares candidates and keeps the components that their links make."""

    def __init__(self, docs: DataFrame, text: str, shingle: int, weighted: bool, threshold: float):
        self.docs = docs.select(node_of(F.col(text)).alias("node"), text_or_empty(F.col(text)).alias("text"))
        self.shingle, self.weighted, self.threshold = shingle, weighted, threshold
        self.labels: DataFrame | None = None
        self.found: DataFrame | None = None
        self.grams: DataFrame | None = None

    def gather(self, nodes: DataFrame) -> None:
        """The sets of the nodes that are candidates at all."""
        texts = semi_by_size(self.docs, nodes, ["node"]).dropDuplicates(["node"])
        self.grams = materialize(map_batches(texts, _sets(self.shingle, self.weighted), "node binary, grams array<long>"))

    def label(self, df: DataFrame, node: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(node))
        named = self.labels.select(F.col("node").alias(node), F.col("label").alias("__label"))
        return df.join(named, node, "left").withColumn(out, F.coalesce("__label", node)).drop("__label")

    def compare(self, pairs: DataFrame) -> None:
        """Takes (a, b), unordered, repeats allowed."""
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        a = self.grams.select(F.col("node").alias("a"), F.col("grams").alias("x"))
        b = self.grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        # sizes alone rule out what could not reach the threshold
        fits = F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * (self.threshold - 1e-9)
        shared = F.size(F.array_intersect("x", "y"))
        alike = shared / (F.size("x") + F.size("y") - shared) >= self.threshold
        links = materialize(pairs.join(a, "a").join(b, "b").where(fits).where(alike).select("a", "b"))
        self.found = links if self.found is None else self.found.unionByName(links)
        ends = self.label(self.label(links, "a", "p"), "b", "q").select(F.col("p").alias("a"), F.col("q").alias("b"))
        joined = components(ends)
        if self.labels is None:
            self.labels = joined.unionByName(joined.select(F.col("label").alias("node"), "label")).distinct()
        else:
            renamed = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
            old = self.labels.join(renamed, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            self.labels = old.unionByName(joined).unionByName(joined.select(F.col("label").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
        self.labels = materialize(self.labels)


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of what may reach the threshold among sets (node, part, grams) of different parts."""
    share = threshold / (1 + threshold)
    tokens = sets.select("node", "part", F.size("grams").alias("n"), F.explode("grams").alias("t"))
    rarity = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ordered = tokens.join(rarity, "t").groupBy("node").agg(F.first("part").alias("part"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))
    ordered = materialize(ordered)

    def prefix(df: DataFrame, least_overlap: Column) -> DataFrame:
        length = (F.col("n") - F.ceil(least_overlap - 1e-6) + 1).cast("int")
        rows = df.select("node", "part", "n", "class", F.posexplode(F.slice("o", 1, F.greatest(length, F.lit(0)))).alias("at", "x"))
        return rows.where("x.f > 1").select("class", "x.t", "node", "part", "n", "at")  # an element of one set joins nothing

    class_of = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_CLASS))).cast("int")
    smaller = prefix(ordered.withColumn("class", class_of(F.col("n"))), 2 * share * F.col("n"))
    spread = F.explode(F.sequence(class_of(F.ceil(threshold * F.col("n") - 1e-6)), class_of(F.col("n")))).alias("class")
    larger = prefix(ordered.select("*", spread), share * (F.col("n") + F.pow(F.lit(SIZE_CLASS), F.col("class"))))
    larger = larger.select("class", "t", *[F.col(c).alias(f"{c}2") for c in ("node", "part", "n", "at")])
    room = 1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) - 1
    fits = (F.col("n") <= F.col("n2")) & (F.col("part") != F.col("part2")) & (room >= F.ceil(share * (F.col("n") + F.col("n2")) - 1e-6))
    return smaller.join(larger, (smaller["class"] == larger["class"]) & (smaller["t"] == larger["t"]) & fits).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def links(
    docs: DataFrame,
    text: str = "text",
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    weighted: bool = False,
) -> DataFrame:
    """(node, label) of every node that has a link; nodes are digests of texts (``node_of``)."""
    plain = docs.select(node_of(F.col(text)).alias("node"), text_or_empty(F.col(text)).alias("text"))
    sketched = map_batches(plain, _banded(shingle, bands, rows, weighted), "node binary, bands array<long>")
    cells = materialize(sketched.groupBy("node").agg(F.first("bands").alias("bands"))).select("node", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(cells.join(shared, "key"))
    degrees = met.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = met.join(degrees, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("x")).select("key", F.col("x.node").alias("hub"))
    live = materialize(met.join(hubs, "key"))
    out = _Links(docs, text, shingle, weighted, threshold)
    out.gather(materialize(live.select("node").distinct()))
    pairs = materialize(live.where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n")))
    out.compare(pairs.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    rest = out.label(out.label(pairs, "node", "p"), "hub", "q").where("p != q")
    out.compare(rest.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    spanning = out.label(live.where("n > 2").select("key", "node"), "node", "part")  # a group of two has been compared
    open_keys = spanning.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
    left = materialize(spanning.join(open_keys, "key").select("node", "part").distinct())
    if not left.isEmpty():
        out.compare(similar_pairs(out.grams.join(left, "node"), threshold))
    return out.labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key``, class_id (the least id of the class), class_size, kept (one row of the class), node."""
    labels = links(docs, text, **options)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("id"), node_of(F.col(text)).alias("node"))
    rows = materialize(rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")))
    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # written first, so that both sides of the join are exchanges and Spark can split a large class
    heads = materialize(named.groupBy("label").agg(F.min(F.struct("id", "node")).alias("head"), F.sum("n").alias("class_size")))
    out = named.join(heads, "label").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    named_id = lambda c: F.when(c != 2**63 - 1, c)
    return out.select(
        named_id(F.col("id")).alias(key),
        named_id(F.col("head.id")).alias("class_id"),
        F.col("class_size").cast("long"),
        ((F.struct("id", "node") == F.col("head")) & (F.col("copy") == 1)).alias("kept"),
        "node",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the least id, with all its columns."""
    own = [unused("id", docs), unused("node", docs)]
    known = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    decided = classes(docs, key, text, **options).select(known.alias(own[0]), F.col("node").alias(own[1]), "kept")
    dropped = decided.groupBy(*own).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    dropped = materialize(dropped.where("not stays or rows > 1"))
    tagged = docs.withColumns({own[0]: known, own[1]: node_of(F.col(text))})
    out = semi_by_size(tagged, dropped.select(*own), own, "left_anti")
    repeated = materialize(dropped.where("stays").select(*own))
    if not repeated.isEmpty():
        out = out.unionByName(semi_by_size(tagged, repeated, own).dropDuplicates(own))
    return out.drop(*own)
