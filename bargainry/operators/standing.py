"""How each observed price stood among those observed before it.

Groups of at most a block of points, nearly all of them as a rule, are dealt out once, whole
rows, and counted each by one task in Arrow batches.  A larger group is spread over tasks:

Whole series at once: how many earlier prices were lower is a count over two orders, time and
price.  Different (time, price) pairs of a product are put in the order of time, within a time
from the highest price, so that of two pairs the one behind is later if it is dearer.  Blocks
of that order are counted in Arrow batches.  Between blocks, ranges are merged: of the halves
of each stretch of 2, 4, 8 ... blocks, the second asks how much of the first is cheaper, which
is a running sum along the price.  So n points of a product bring n log(n / block) rows to
sums that many tasks share, and no row meets another by a join on time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import percent
from .dedupe import few_or_many, saved
from .running import running_before, tasks
from .verify import HISTORY_LEAST

#: Pairs of a block, which a task holds at once.
BLOCK = 65_536


def _lower(start: np.ndarray, price: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each pair, how many points of its block's pairs before it have lower prices.

    ``start`` is the place of the first pair of a pair's block.  As between blocks: of the
    halves of each stretch of 2, 4, 8 ... pairs, the second asks how much of the first is cheaper.
    """
    lower, local = np.zeros(len(price), np.int64), np.arange(len(price)) - start
    by_price = np.lexsort((price, start))
    places, width = np.arange(len(price)), 1
    while len(price) and width <= local.max():
        stretch = start + local // (2 * width) * (2 * width)
        order = by_price[np.argsort(stretch[by_price], kind="stable")]
        first = local[order] // width % 2 == 0
        weight = np.where(first, n[order], 0)
        before = np.cumsum(weight) - weight
        turn = np.append(True, np.diff(stretch[order]) != 0)
        step = turn | np.append(True, np.diff(price[order]) != 0)
        since = lambda flags: before[np.maximum.accumulate(np.where(flags, places, 0))]
        lower[order[~first]] += (since(step) - since(turn))[~first]
        width *= 2
    return lower


def _starts(turns: np.ndarray) -> np.ndarray:
    """For each row, the place of the last one up to it that is a turn; the first row is one."""
    return np.maximum.accumulate(np.where(turns, np.arange(len(turns)), 0))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``lower``: of the pairs of the block that come before, the points at lower prices; a block's rows follow one another."""

    def counted(rows: pa.Table) -> pa.Table:
        price, n = (np.asarray(rows.column(c), np.int64) for c in ("price", "n"))
        start = _starts(np.append(True, _turns(rows, ("block", "group"))))
        return rows.append_column("lower", pa.array(_lower(start, price, n)))

    return _whole(batches, ("block", "group"), counted)


def _stood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds before, below and low to points in the order of group, time and falling price; a group's rows follow one another."""

    def counted(rows: pa.Table) -> pa.Table:
        price = np.asarray(rows.column("__price"), np.int64)
        turns = np.append(True, _turns(rows, ("__group",)))
        start, first = _starts(turns), _starts(turns | np.append(True, _turns(rows, ("__at",))))
        before, at = first - start, np.arange(len(price))
        low = pa.array(_least(price, start)[np.maximum(first - 1, 0)], mask=before == 0)
        # rows of one time come from the highest price, so that none of them is dearer than one before it
        below = _lower(start, price, np.ones(len(at), np.int64))
        for name, column in (("before", pa.array(before)), ("below", pa.array(below)), ("low", low)):
            rows = rows.append_column(name, column)
        return rows

    return _whole(batches, ("__group",), counted)


def _least(price: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row, the lowest price of its group's rows up to it: minima over 1, 2, 4 ... rows."""
    least, places, width = price.copy(), np.arange(len(price)), 1
    while len(price) and width <= (places - start).max():
        reach = places - start >= width
        least[reach] = np.minimum(least[reach], least[places[reach] - width])
        width *= 2
    return least


def _whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], counted: Callable[[pa.Table], pa.Table]) -> Iterator[pa.RecordBatch]:
    """``counted`` of the rows, in tables that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []

    for batch in batches:
        if not batch.num_rows:
            continue
        behind = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        turns = np.flatnonzero(_turns(pa.Table.from_batches([*behind, batch]).combine_chunks(), keys)) + 1 - len(behind)
        last = int(turns[-1]) if len(turns) else None
        if last is not None:  # blocks end in this batch
            held.append(batch.slice(0, last))
            yield from counted(pa.Table.from_batches(held).combine_chunks()).to_batches()
            held = []
        held.append(batch.slice(last or 0))
    if held:
        yield from counted(pa.Table.from_batches(held).combine_chunks()).to_batches()


def _turns(rows: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Whether a row has other keys than the one before it, from the second row on."""
    differs = np.zeros(rows.num_rows - 1, bool)
    for c in keys:
        column = rows.column(c).combine_chunks()
        differs |= np.asarray(pc.not_equal(column[1:], column[:-1]))
    return differs


def _large(placed: DataFrame) -> DataFrame:
    """Groups of more than one block, and how many times these can be paired: the bits of their last block's number."""
    last = placed.groupBy("group").agg(F.max("block").alias("last")).where("last > 0")
    return last.select("group", F.length(F.bin("last")).alias("levels"))


def standing(points: DataFrame, group: str = "product_key", at: str = "observed_at", price: str = "price", block: int = BLOCK) -> DataFrame:
    """The points with before (points of the group at earlier times), below (those of them at lower prices), low (their lowest price) and rank_pct.

    Only prices above 0 count.  rank_pct is the share of earlier prices that are lower, in per
    cent, once there are enough of them to say so.  Points of one time are no earlier ones of
    each other, and repeated rows stand alike.  A point without a group, a time or a price
    above 0 has nulls.  A group may hold any share of all points.
    """
    keys = ["__group", "__at", "__price"]
    rows = points.withColumns(dict(zip(keys, (F.col(group), F.col(at), F.col(price).cast("long")), strict=True)))
    counts = "__group is not null and __at is not null and __price > 0"
    sizes = rows.where(counts).groupBy("__group").agg(F.count(F.lit(1)).alias("__size"))
    large = saved(sizes.where(F.col("__size") > block).select("__group"))
    facts = StructType.fromDDL("before long, below long, low long").fields
    if large.isEmpty():
        small, rest = rows.where(counts), rows.where(f"({counts}) is not true").withColumns({f.name: F.lit(None).cast(f.dataType) for f in facts})
    else:
        large = few_or_many(large)
        small = rows.where(counts).join(large, "__group", "left_anti").select(*rows.columns)
        marked = rows.join(large.withColumn("__large", F.lit(True)), "__group", "left").where(f"__large or ({counts}) is not true").select(*rows.columns)
        rest = _spread(marked, counts, keys, block)
    dealt = small.repartition(tasks(points), "__group").sortWithinPartitions("__group", "__at", F.desc("__price"))
    out = dealt.mapInArrow(_stood, StructType([*dealt.schema.fields, *facts])).unionByName(rest)
    out = out.drop(*keys)
    return out.withColumn("rank_pct", F.when(F.col("before") >= HISTORY_LEAST, percent(F.col("below") / F.col("before"))))


def _spread(rows: DataFrame, counts: str, keys: list[str], block: int) -> DataFrame:
    """The rows with before, below and low of those that count; each group is dealt to many tasks."""
    pairs = rows.where(counts).select(F.col("__group").alias("group"), F.col("__at").alias("at"), F.col("__price").alias("price"))
    pairs = saved(pairs.groupBy("group", "at", "price").agg(F.count(F.lit(1)).alias("n")))

    times = pairs.groupBy("group", "at").agg(F.sum("n").alias("n"), F.min("price").alias("price"))
    times = running_before(times, ["group"], [F.col("at")], {"before": F.col("n")}, {"low": F.col("price")}).select("group", "at", "before", "low")

    placed = running_before(pairs, ["group"], [F.col("at"), F.col("price").desc()], {"place": F.lit(1)})
    placed = placed.withColumn("block", F.floor(F.col("place") / block))
    dealt = placed.repartition(tasks(rows), "group", "block").sortWithinPartitions("group", "block", "place")
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    placed = saved(dealt.mapInArrow(_inside, f"{shape}, lower long"))

    each = placed.join(_large(placed), "group").withColumn("level", F.explode(F.expr("sequence(0, levels - 1)")))
    each = each.withColumns({"stretch": F.expr("shiftright(block, level + 1)"), "second": F.expr("shiftright(block, level) & 1")})
    sums = each.groupBy("group", "level", "stretch", "price").agg(F.sum(F.when(F.col("second") == 0, F.col("n")).otherwise(0)).alias("n"), F.max("second").alias("asks"))
    sums = running_before(sums, ["group", "level", "stretch"], [F.col("price")], {"cheaper": F.col("n")}).where("asks = 1")
    asks = each.where("second = 1").select("group", "level", "stretch", "price", "at")
    between = asks.join(sums.select("group", "level", "stretch", "price", "cheaper"), ["group", "level", "stretch", "price"])
    between = between.groupBy("group", "at", "price").agg(F.sum("cheaper").alias("cheaper"))

    found = placed.select("group", "at", "price", "lower").join(between, ["group", "at", "price"], "left").join(times, ["group", "at"])
    found = found.select(*[F.col(c).alias(k) for c, k in zip(("group", "at", "price"), keys, strict=True)], "before", (F.col("lower") + F.coalesce("cheaper", F.lit(0))).alias("below"), "low")
    return rows.join(found, keys, "left")
