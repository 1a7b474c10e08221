"""The trie of conversations that begin alike, by mergesort with the lengths of shared prefixes.

A conversation is a sequence of turns, each a SHA-256 digest of its role and text, and is cut
into segments of ``SEGMENT`` turns, so that none is a long row; the segments that follow the
same turns have the same context, a digest of these.  Equal segments of a context are counted
first, so that copies meet as counts.  Spark deals contexts and segments to ranges of their
order; in a range, batches are sorted runs that carry, for each segment, how many turns it
shares with the one before (its LCP), and a loser tree merges the runs, comparing turns only
beyond what two runs are known to share.  The merged order is written.  It is then read once,
a stack holding the path that is open: where the LCP falls, nodes are finished and leave it.
What crosses ranges or goes on in later segments leaves with its key and is summed by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, map_batches, materialize, semi_by_size, task_count, text_or_empty

#: Bytes of a digest, turns of a segment, bytes of the segments of a range.
UNIT, SEGMENT, RANGE_BYTES = 32, 64, 32 << 20

#: The context of first segments, and thereby the key of the root.
START = bytes(UNIT)


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, part, depth, key, words) of each turn, depth counting from 1, and (conv, n_turns).

    The order is that of ``turn``, null first, and for equal ones that of the digests.  The
    rows are dealt to ranges of the order, so that a long conversation has many tasks.
    """
    role_, text_ = text_or_empty(F.col(role)), text_or_empty(F.col(text))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("key"),
        F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    parts = materialize(rows.repartitionByRange(task_count(df.sparkSession), "conv", *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = parts.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"))
    starts = materialize(starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    place = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    placed = parts.withColumn("place", place).join(starts.drop("n"), ["part", "conv"])
    lengths = materialize(starts.groupBy("conv").agg(F.sum("n").alias("n_turns")))
    return placed.select("conv", (F.col("start") + F.col("place")).alias("depth"), "key", "words"), lengths


def with_heads(rows: DataFrame, lengths: DataFrame, base: Column, h: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first ``h`` turns of conversation ``base`` (columns over ``conv``; h is at most ``most``) in place of its own.

    ``base`` may have fewer turns, or not exist; a conversation that has no more turns than h
    keeps none of its own.
    """
    rows = materialize(rows)
    plan = lengths.select("conv", "n_turns", base.alias("base"), h.alias("h"))
    found = lengths.select(F.col("conv").alias("base"), F.col("n_turns").alias("has"))
    plan = plan.join(found, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    plan = materialize(plan.drop("has"))
    heads = rows.where(F.col("depth") <= most).select(F.col("conv").alias("base"), "depth", "key", "words")
    borrowed = plan.join(heads, "base").where(F.col("depth") <= F.col("h")).select("conv", "depth", "key", "words")
    own = rows.join(plan, "conv").where(F.col("depth") > F.col("h")).select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "key", "words")
    return borrowed.unionByName(own), plan.select("conv", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))


def _segments(rows: DataFrame, lengths: DataFrame, segment: int) -> DataFrame:
    """conv, seg, context, key (context and turns), words (an array), last, long."""
    seg = F.floor((F.col("depth") - 1) / segment).cast("int")
    each = rows.groupBy("conv", seg.alias("seg")).agg(F.array_sort(F.collect_list(F.struct("depth", "key", "words"))).alias("turns"))  # at most ``segment``
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    each = each.select("conv", "seg", path.alias("path"), F.col("turns.words").alias("words"))
    each = each.join(lengths.where("n_turns > 0"), "conv")
    each = each.select("conv", "seg", "path", "words", (F.col("seg") == F.floor((F.col("n_turns") - 1) / segment)).alias("last"), (F.col("n_turns") > segment).alias("long"))
    each = materialize(each)
    start = F.unhex(F.lit(START.hex()))
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    lanes = [F.bit_xor(F.xxhash64(F.lit(i), "seg", F.sha2("path", 256))).over(before) for i in range(UNIT // 8)]
    context = F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in lanes]))
    later = each.where("long").withColumn("context", F.when(F.col("seg") == 0, start).otherwise(context))
    none = lengths.where("n_turns = 0").select("conv", F.lit(0).alias("seg"), F.lit(b"").alias("path"), F.array().cast("array<long>").alias("words"), F.lit(True).alias("last"), F.lit(False).alias("long"))
    first = each.where("not long").unionByName(none).withColumn("context", start)
    return materialize(first.unionByName(later).withColumn("key", F.concat("context", "path")).drop("path"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns two keys share, if they share ``at``."""
    most = min(len(a), len(b)) // UNIT
    while at < most and a[at * UNIT : at * UNIT + UNIT] == b[at * UNIT : at * UNIT + UNIT]:
        at += 1
    return at


def run_of(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """A sorted run: the order of the keys, and what each shares with the one before."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return order, [0, *(shared(keys[a], keys[b]) for a, b in zip(order, order[1:], strict=False))] if order else []


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, LCP with the key before) of all keys in order, by a loser tree over sorted keys and their LCPs.

    What stands at ``lcp`` is how many turns the run's next key shares with the key that went
    out last.  Of two runs the one that shares more is first; only if both share as much are
    turns compared, from there on.
    """
    if not runs:
        return
    width = 1 << (len(runs) - 1).bit_length()
    keys: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - len(runs))
    lcp, at, losers = [0] * width, [0] * width, [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """The winner and the loser, which then knows what it shares with the winner."""
        if keys[a] is None or keys[b] is None:
            return (b, a) if keys[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        same = shared(keys[a], keys[b], lcp[a])
        if keys[b][same * UNIT : same * UNIT + UNIT] < keys[a][same * UNIT : same * UNIT + UNIT]:
            a, b = b, a
        lcp[b] = same
        return a, b

    winners = [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if width > 1 else 0
    while keys[best] is not None:
        yield best, at[best], lcp[best]
        at[best] += 1
        own, steps = runs[best]
        keys[best], lcp[best] = (own[at[best]], steps[at[best]]) if at[best] < len(own) else (None, 0)
        node = (best + width) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1


_PATH = "key binary, seg int, words array<long>, n long, conv long, ended long, ends string"
_SORTED = f"part int, place long, lcp int, {_PATH}"


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range in order, with LCPs; the first of a range has none, as it doesn't see the range before."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    pieces, runs = [], []
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("key").to_pylist()
            order, steps = run_of(keys)
            pieces.append(batch.take(pa.array(order)))
            runs.append(([keys[i] for i in order], steps))
    if not runs:
        return
    starts = [0]
    for piece in pieces:
        starts.append(starts[-1] + piece.num_rows)
    whole = pa.Table.from_batches(pieces)
    place, some = 0, []
    for run, at, lcp in merge(runs):
        some.append((starts[run] + at, lcp))
        if len(some) == 1000:
            yield from _slice(whole, some, part, place)
            place, some = place + len(some), []
    yield from _slice(whole, some, part, place)


def _slice(whole: pa.Table, some: list[tuple[int, int]], part: int, place: int) -> Iterator[pa.RecordBatch]:
    if some:
        n = len(some)
        ahead = [pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), pa.array([s[1] for s in some], pa.int32())]
        rows = whole.take(pa.array([s[0] for s in some])).combine_chunks()
        yield pa.RecordBatch.from_arrays([*ahead, *(rows[c].combine_chunks() for c in rows.column_names)], ["part", "place", "lcp", *rows.column_names])


class Node:
    """A node on the open path: what is known of its subtree in this range."""

    __slots__ = ("children", "conv", "crosses", "deep", "ends", "leaves", "n", "pending", "saved", "words")

    def __init__(self, words: int, crosses: bool):
        self.n, self.conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.words, self.ends, self.crosses, self.deep, self.pending = words, None, crosses, False, []


_NODE = "key binary, seg int, unit int, conv long, n long, children long, leaves long, saved long, words long, ends string, crosses boolean, parent long, parent_key binary"
_NODE_ARROW = pa.schema(
    [("key", pa.binary()), ("seg", pa.int32()), ("unit", pa.int32())]
    + [(c, pa.int64()) for c in ("conv", "n", "children", "leaves", "saved", "words")]
    + [("ends", pa.string()), ("crosses", pa.bool_()), ("parent", pa.int64()), ("parent_key", pa.binary())]
)


class OpenPath:
    """Reads a range in order and gives its nodes as they are finished.

    Node u of the path is the prefix of u units of the key, the first being the context.
    A node that crosses the range's ends, goes on in later segments or is a context's top
    leaves with its key, to be summed; any other is whole.  A child learns the smallest member
    of its parent when that is finished, or gets its key, if it crosses.
    """

    def __init__(self):
        self.path: list[Node] = []
        self.key, self.seg, self.out = b"", 0, []

    def close(self, down_to: int, crossing: int = 0) -> None:
        """Finishes the nodes beyond ``down_to``; the range after shares the first ``crossing``."""
        while len(self.path) > down_to:
            unit, node = len(self.path), self.path.pop()
            node.crosses |= unit <= crossing
            if not node.crosses and unit > 1:
                node.saved += (node.n - 1) * node.words
            keyed = node.crosses or node.deep or unit == 1
            key = self.key[: unit * UNIT] if keyed else None
            values = [key, self.seg, unit, node.conv, node.n, node.children, node.leaves, node.saved, node.words, node.ends, node.crosses]
            for child in node.pending:
                self.out.append((*child, None, self.key[: unit * UNIT]) if node.crosses else (*child, node.conv, None))
            if unit == 1:
                self.out.append((*values, None, None))
                continue
            above = self.path[-1]
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
            above.leaves += node.leaves
            above.saved += node.saved
            above.deep |= node.deep
            if unit == 2:  # a top is summed by its key in any case
                self.out.append((*values, None, self.key[:UNIT]))
            else:
                above.pending.append(values)

    def add(self, row: dict, lcp: int, following: bytes | None, first: bool) -> None:
        """The next key in order, which shares ``lcp`` units with the one before; ``following`` comes after it."""
        self.close(lcp)
        self.key, self.seg = row["key"], row["seg"]
        for unit in range(len(self.path) + 1, len(self.key) // UNIT + 1):
            new = unit > lcp
            if new and self.path:
                self.path[-1].children += 1
            self.path.append(Node(row["words"][unit - 2] if unit > 1 else 0, crosses=first and not new))
        last = self.path[-1]
        last.n += row["n"]
        last.conv = row["conv"] if last.conv is None else min(last.conv, row["conv"])
        goes_on = row["ended"] < row["n"]
        last.deep |= goes_on
        if row["ended"]:
            last.ends = row["ends"]
        if not goes_on and not (following is not None and following.startswith(self.key)):
            last.leaves += 1

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _NODE_ARROW, strict=True)], schema=_NODE_ARROW)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of ranges, each with the last key before it (place -1) and the first after it (no words)."""
    path, row = OpenPath(), None
    for batch in batches:
        for new in batch.to_pylist():
            if new["place"] == -1:
                before = new["key"]
                continue
            if row is not None:
                lcp = shared(before, row["key"]) if first else row["lcp"]
                path.add(row, lcp, new["key"], first)
                first = False
            else:
                first = True
            if new["words"] is None:
                path.close(0, shared(row["key"], new["key"]))
                row = None
            else:
                row = new
        if path.out:
            yield path.take()


def _prefixes(key: str, more: list[Column]) -> list[Column]:
    return [F.explode(F.transform(F.sequence(F.lit(1), (F.length(key) / UNIT).cast("int")), lambda i: F.substring(F.col(key), F.lit(1), i * UNIT))).alias("key"), *more]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key and conv, the digest of each key's ids, joined by commas; an id at a time."""
    key = said = None
    for batch in batches:
        done = []
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if k == key:
                said.update(b",%d" % conv)
                continue
            if said:
                done.append((key, said.hexdigest()))
            key, said = k, hashlib.sha256(b"%d" % conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends"])
    if said:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([said.hexdigest()], pa.string())], ["key", "ends"])


def _paths(segs: DataFrame) -> DataFrame:
    """Different segments: key, seg, words, n members, smallest conv, how many end here, and the digest of their ids."""
    spark = segs.sparkSession
    ended = F.when(F.col("last"), F.col("conv"))
    paths = segs.groupBy("key").agg(
        F.min("seg").alias("seg"), F.any_value("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.count(ended).alias("ended"), F.min(ended).alias("one")
    )
    paths = materialize(paths)
    many = materialize(paths.where("ended > 1").select("key"))
    members = semi_by_size(segs.where("last").select("key", "conv"), many, ["key"])
    members = members.repartition(task_count(spark), "key").sortWithinPartitions("key", "conv")
    several = materialize(map_batches(members, _digests, "key binary, ends string"))
    paths = semi_by_size(paths, several, ["key"], "left")
    return paths.select("key", "seg", "words", "n", "conv", "ended", F.coalesce("ends", F.sha2(F.col("one").cast("string"), 256)).alias("ends"))


def _deeper(segs: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What later segments add to the nodes before them: key, leaves, saved, children; None if no conversation has any.

    Also, which node is before each context: context, key.

    A context's own sums count for its smallest member; the sums of what follows a context
    are then those of its members from there to their ends, each member's segments summed
    from the last one back.
    """
    long = segs.where("long").select("conv", "seg", "context", "key")
    if long.isEmpty():
        return None
    by_seg = Window.partitionBy("conv").orderBy("seg")
    long = long.withColumn("before", F.lag("key").over(by_seg)).where("seg > 0")
    own = tops.select(F.col("key").alias("context"), "conv", F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved"), "children")
    back = Window.partitionBy("conv").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    long = long.join(own, ["context", "conv"], "left")
    sums = [F.coalesce(F.sum(f"own_{c}").over(back), F.lit(0)).alias(c) for c in ("leaves", "saved")]
    long = long.select("context", "before", "children", *sums)
    below = materialize(long.groupBy("context").agg(F.any_value("before").alias("before"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("children").alias("children")))
    along = below.select(*_prefixes("before", [F.col("leaves"), F.col("saved"), F.lit(0).cast("long").alias("children")]))
    at = below.select(F.col("before").alias("key"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "children")
    more = along.unionByName(at).groupBy("key").agg(*[F.sum(c).alias(f"more_{c}") for c in ("leaves", "saved", "children")])
    return more, below.select("context", F.col("before").alias("key"))


def trie(rows: DataFrame, lengths: DataFrame, segment: int = SEGMENT, ranges: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    ``rows`` has conv, depth, key and words of each turn, ``lengths`` the n_turns of each
    conversation, 0 too, which is a member of the root only.  A node is a sequence of turns
    with which a conversation begins; its conv_id is the smallest of its members, and with the
    depth it names the node.  Repeated rows are turns like others.  Texts and conversations
    may be of any length; the digest of all ids that end at one node is made in one task, an
    id at a time.  No conversations give no nodes.
    """
    spark = rows.sparkSession
    segs = _segments(rows, lengths, segment)
    paths = materialize(_paths(segs))
    if ranges is None:
        size, n = paths.agg(F.sum(F.length("key") + 8 * F.size("words") + 100), F.count(F.lit(1))).first()
        ranges = max(min(task_count(spark), -(-n // 2000)), -(-(size or 0) // RANGE_BYTES), 1)
    in_order = materialize(map_batches(paths.repartitionByRange(ranges, "key"), _sort, _SORTED))
    by_part = Window.orderBy("part")  # a row per range
    edges = in_order.groupBy("part").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    empty = F.lit(b"")
    edges = edges.select("part", F.coalesce(F.lag("last").over(by_part), empty).alias("before"), F.coalesce(F.lead("first").over(by_part), empty).alias("after"))
    ends = F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.col("before").alias("key")), F.struct(F.lit(1 << 62).alias("place"), F.col("after").alias("key"))))
    edges = edges.select("part", ends.alias("end")).select("part", "end.place", "end.key")
    stream = in_order.unionByName(edges, allowMissingColumns=True).repartition(ranges, "part").sortWithinPartitions("part", "place")
    nodes = materialize(map_batches(stream, _nodes, _NODE))

    keyed = nodes.where("key is not null").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("conv").alias("conv"), *[F.max(c).alias(c) for c in ("seg", "unit", "words", "ends", "crosses", "parent", "parent_key")]
    )
    keyed = materialize(keyed)
    crossing = keyed.where("crosses and unit > 1").select(*_prefixes("key", [((F.col("n") - 1) * F.col("words")).alias("more")]))
    crossing = crossing.groupBy("key").agg(F.sum("more").alias("more"))
    keyed = materialize(keyed.join(crossing, "key", "left").withColumn("saved", F.col("saved") + F.coalesce("more", F.lit(0))).drop("more"))
    names = keyed.select(F.col("key").alias("parent_key"), F.col("conv").alias("found"))
    deeper = _deeper(segs, keyed.where("unit = 1 and seg > 0"))
    if deeper:
        more, before = deeper
        tops = before.join(keyed.select("key", F.col("conv").alias("found")), "key").select(F.col("context").alias("parent_key"), "found")
        names = keyed.where("unit > 1 or seg = 0").select(F.col("key").alias("parent_key"), F.col("conv").alias("found")).unionByName(tops)
        keyed = keyed.join(more, "key", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved", "children")})
    keyed = keyed.where("unit > 1 or seg = 0")
    kept = ["conv", "seg", "unit", "n", "children", "leaves", "saved", "ends", "parent", "parent_key"]
    every = nodes.where("key is null").select(*kept).unionByName(keyed.select(*kept))
    root = F.unhex(F.lit(START.hex()))
    smallest = keyed.where(F.col("key") == root).select("conv").first()  # one number
    every = every.withColumn("parent", F.when(F.col("parent_key") == root, F.lit(smallest[0] if smallest else None).cast("long")).otherwise(F.col("parent")))
    asking = F.col("parent").isNull() & F.col("parent_key").isNotNull()
    told = semi_by_size(every.where(asking), materialize(names), ["parent_key"], "left")
    every = every.where(~asking).withColumn("found", F.lit(None).cast("long")).unionByName(told)
    return every.select(
        F.col("conv").alias("conv_id"),
        (F.col("seg").cast("long") * segment + F.col("unit") - 1).alias("depth"),
        F.coalesce("parent", "found").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
