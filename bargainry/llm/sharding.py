"""Sharding by a hierarchical weighted hash tree.

Every node of the tree (region, rack, shard) draws ``-ln(u) / weight`` for a document,
where u in (0, 1) is a hash of its id and the node's name; the smallest draw among the
children of a node wins, and the document descends to it.  A child wins with a chance in
proportion to its weight.  A changed weight changes the draws of the nodes above it alone,
so a document moves only into (or out of) a subtree whose weight has changed.

A shard that is added beyond the planned ones gets a rack and a region of its own: the
other nodes keep their draws, so it takes documents only into itself (law ``key``).

Defined results: a null text has no bytes; a null id is an id like any other and goes to
one shard; repeated rows get slots of their own; texts of any length are measured whole; an
empty table gives no rows; further columns are kept by ``descend``, whatever their names, and
ignored by ``assign``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_before, task_count, text_or_empty, unit_hash, unused

REGIONS, RACKS, SHARDS = 2, 3, 4


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, regions: int = REGIONS, racks: int = RACKS, width: int = SHARDS) -> list[Leaf]:
    """Leaves 0 .. shards-1: the planned ones fill the regions in turn, later ones get a region each."""
    planned = regions * racks * width
    leaves = [Leaf(i // (racks * width), i // width, i) for i in range(min(shards, planned))]
    return leaves + [Leaf(regions + i - planned, regions * racks + i - planned, i) for i in range(planned, shards)]


def _draw(level: str, children: dict[int, float], key: Column) -> Column:
    """The child with the smallest draw; the smaller number if draws tie."""
    draws = [
        F.struct((-F.log(unit_hash(key, F.lit(f"{level}/{child}"))) / F.lit(float(weight))).alias("d"), F.lit(child).alias("c"))
        for child, weight in sorted(children.items())
        if weight > 0
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["c"]


def _weights(leaves: list[Leaf], node: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for leaf in leaves:
        out[getattr(leaf, node)] = out.get(getattr(leaf, node), 0.0) + leaf.weight
    return out


def _choose(chosen: Column, options: dict[int, Column]) -> Column:
    (first, column), *rest = sorted(options.items())
    out = F.when(chosen == first, column)
    for node, column in rest:
        out = out.when(chosen == node, column)
    return out


def descend(df: DataFrame, key: str, leaves: list[Leaf], out: str) -> DataFrame:
    """Adds ``out``, the shard that the document's draws lead to."""
    col, used = F.col(key), [leaf for leaf in leaves if leaf.weight > 0]
    racks = {r: _draw("rack", _weights([x for x in used if x.region == r], "rack"), col) for r in _weights(used, "region")}
    shards = {k: _draw("shard", _weights([x for x in used if x.rack == k], "shard"), col) for k in _weights(used, "rack")}
    region, rack = unused("region", df), unused("rack", df)
    return (
        df.withColumn(region, _draw("region", _weights(used, "region"), col))
        .withColumn(rack, _choose(F.col(region), racks))
        .withColumn(out, _choose(F.col(rack), shards).cast("int"))
        .drop(region, rack)
    )


def assign(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard, slot and, if ``grown`` is given, grown_shard.

    Slots number the rows of a shard from 0 along a hash of the key; a shard's rows are
    numbered in many ranges of that hash at once.
    """
    body = F.encode(text_or_empty(F.col(text)), "UTF-8")
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(text_or_empty(F.col(text))) + 8).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    rows = descend(rows, key, leaves, "shard")
    if grown is not None:
        rows = descend(rows, key, grown, "grown_shard")
    rows = rows.withColumn("__at", unit_hash(F.col(key), F.lit("slot")))
    order = [F.col(c).asc_nulls_first() for c in ("__at", key, "size", "text_crc32")]
    ranges = max(1, task_count(docs.sparkSession) // 4)
    return running_before(rows, ["shard"], F.col("__at"), order, F.lit(1), ranges, "slot").drop("__at")
