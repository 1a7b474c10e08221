"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: the sources share the budget by weight; a target stops at ``max_epochs`` times
   its source's size and the excess is shared again among the others.
2. Slots: a target of T words needs a slot for each block of ``block_words`` that it takes.
   All N slots are dealt by the golden-ratio lattice: slot i has the point
   (i * a mod N) / N with a near N / phi and prime to N, and the point's place among the
   cumulative slot counts of the sources gives its source.  Each source so gets exactly its
   number of slots, spread evenly over the schedule.
3. Ranks: the slots of a source are ranked along the schedule.
4. Blocks: the documents of a source are shuffled by a hash and laid end to end; the words
   are cut into blocks of ``block_words``.  The slot of rank r takes block r mod (number of
   blocks), so a second round begins when the first is over.

Any number of sources is planned on Spark: their order by ranges, their targets by rounds of
one aggregate each.  The driver gets sums only.

Defined results: a null text has no words; a null source is a source of its own, the last;
a document without words is taken 0 times; repeated rows are documents of their own; a text
of any length is one document over as many blocks as it needs; an empty table gives no rows;
further columns are ignored by ``mix`` and kept by ``sample``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, numbered, running_before, semi_by_size, task_count, text_or_empty, unit_hash, unused

BLOCK_WORDS = 256
_CHUNK = 65_536


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """Orders as code points do, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: dict[str, int], weights: dict[str, float], share: float, max_epochs: float) -> dict[str, float]:
    """Shares of ``share`` times all words by weight; none above ``max_epochs`` times its size.

    The plan of a few sources in memory, for users; ``plan_sources`` does the same on Spark.
    """
    budget, free = share * sum(sizes.values()), sorted(sizes)
    out: dict[str, float] = {}
    while free:
        total = sum(weights[s] for s in free)
        full = [s for s in free if total <= 0 or budget * weights[s] / total > max_epochs * sizes[s]]
        if not full:
            return out | {s: budget * weights[s] / total for s in free}
        out |= {s: float(max_epochs * sizes[s]) for s in full}
        budget -= sum(max_epochs * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def lattice(n: int) -> tuple[int, int]:
    """The multiplier near n / phi that is prime to n, and its inverse mod n."""
    if n <= 2:
        return 1, 1
    a = max(1, round(n * (math.sqrt(5) - 1) / 2))
    step = next(d for d in range(n) if math.gcd(a + d, n) == 1)
    return (a + step) % n or 1, pow(a + step, -1, n)


def schedule(spark, plan: DataFrame | list[dict], block: int) -> DataFrame:
    """A row per slot: source, slot (its place in the schedule), rank within the source.

    ``plan`` has source, slots and, as a table, place (the source's number from 0).
    """
    if not isinstance(plan, DataFrame):
        plan = spark.createDataFrame([(i, p["source"], p["slots"]) for i, p in enumerate(plan)], "place long, source string, slots long")
    n, sources = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    _, inverse = lattice(max(n, 1))
    firsts = running_before(plan.select("place", "source", "slots"), [], F.col("place") / F.lit(float(max(sources, 1))), [F.col("place")], F.col("slots"), task_count(spark), "first")
    firsts = firsts.where("slots > 0")
    chunks = firsts.select("source", "first", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(_CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition(task_count(spark), "source", "chunk")
    places = chunks.select("source", F.explode(F.sequence(F.col("first") + F.col("chunk"), F.col("first") + F.least(F.col("chunk") + _CHUNK, F.col("slots")) - 1)).alias("point"))
    slot = (F.col("point").cast("decimal(19,0)") * F.lit(inverse).cast("decimal(19,0)")) % F.lit(max(n, 1)).cast("decimal(19,0)")
    slots = places.select("source", slot.cast("long").alias("slot"))
    return running_before(slots, ["source"], F.col("slot") / F.lit(float(max(n, 1))), [F.col("slot")], F.lit(1), task_count(spark), "rank")


def plan_sources(sized: DataFrame, share: float, max_epochs: float, cycle: tuple[float, ...], block: int) -> DataFrame:
    """A row per source: place, source_size, target, take (whole words), slots.

    A source is full if its share of the level (words per weight) is above ``max_epochs`` times
    its size.  What the full ones leave raises the level, until no more are full.
    """
    totals = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    totals = materialize(totals.withColumn("weight", weight).withColumn("most", F.lit(float(max_epochs)) * F.col("source_size")))
    words, heavy = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    budget, full, stopped = share * words, F.lit(heavy <= 0), -1
    while heavy > 0:
        full = F.lit(budget) * F.col("weight") / F.lit(heavy) > F.col("most")
        count, spent, rest = totals.agg(F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if count == stopped:
            break
        budget, heavy, stopped = share * words - spent, rest, count
        full = F.lit(True)  # if no weight is left
    target = F.when(full, F.col("most")).otherwise(F.lit(budget) * F.col("weight") / F.lit(heavy or 1.0))
    plan = totals.withColumn("target", target).withColumn("take", F.floor("target"))
    blocks = lambda c: F.expr(f"({c} + {block - 1}) div {block}")
    slots = F.expr("take div source_size") * blocks("source_size") + blocks("take % source_size")
    return materialize(plan.select("place", "source", "source_size", "target", "take", F.when(F.col("source_size") > 0, slots).otherwise(0).alias("slots")))


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    body = F.xxhash64(text_or_empty(F.col(text)))
    return docs.select(F.col(key).alias("id"), source_key(F.col(source)).alias("source"), word_count(F.col(text)).alias("size"), body.alias("body"))


def _taken(sized: DataFrame, share: float, max_epochs: float, cycle: tuple[float, ...], block: int) -> DataFrame:
    spark = sized.sparkSession
    plan = plan_sources(sized, share, max_epochs, cycle, block)
    sized = semi_by_size(sized, plan.select("source", "source_size", "target"), ["source"], "inner")
    shuffled = unit_hash(F.col("id"), F.col("body"), F.lit("mix"))
    full = sized.where("size > 0").withColumn("at", shuffled)
    order = [F.col(c).asc_nulls_first() for c in ("at", "id", "body", "size")]
    laid = running_before(full, ["source"], F.col("at"), order, F.col("size"), task_count(spark), "start")
    # Rows that share id, text and source lie end to end; their start tells them apart.
    parts = laid.select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    slots = semi_by_size(schedule(spark, plan, block), plan.select("source", "source_size", "take"), ["source"], "inner")
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    slots = slots.select(
        "source",
        "slot",
        (F.col("rank") % blocks).alias("block"),
        # what is left of the target when this slot's turn comes, past the rounds that are over
        (F.col("take") - F.floor(F.col("rank") / blocks).cast("long") * F.col("source_size")).alias("left"),
    )
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, F.col("left"))
    taken = (
        parts.join(slots, ["source", "block"])
        .groupBy("source", "start")
        .agg(F.sum(F.greatest(high - low, F.lit(0))).alias("taken"), F.min(F.when(high > low, F.col("slot"))).alias("first_slot"))
    )
    rows = laid.join(taken, ["source", "start"], "left").select("id", "source", "body", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
    empty = sized.where("size = 0").select("id", "source", "body", "size", "source_size", "target", F.lit(0).alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return rows.unionByName(empty)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    cycle: tuple[float, ...] = (3, 1, 2),
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """``key``, size, source_size, target, taken and the place of the document's first slot, first_slot."""
    out = _taken(materialize(_sized(docs, key, text, source)), share, max_epochs, cycle, block)
    return out.select(
        F.col("id").alias(key), F.col("size").cast("long"), F.col("source_size").cast("long"), "target", F.col("taken").cast("long"), "first_slot"
    )


def sample(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    cycle: tuple[float, ...] = (3, 1, 2),
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """The mixture in whole documents: each occurs taken / size times, rounded (half up).

    The rows are in the order of the schedule: a document comes at its first slot, further
    copies follow a round of its source later each.
    """
    sized = materialize(_sized(docs, key, text, source))
    out = _taken(sized, share, max_epochs, cycle, block)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    own = [unused(c, docs) for c in ("id", "source_key", "body")]
    copied, rows, slot, round_, turn = (unused(c, docs) for c in ("copies", "rows", "slot", "round", "turn"))
    known = [F.coalesce(F.col("id").cast("string"), F.lit("null")).alias(own[0]), F.col("source").alias(own[1]), F.col("body").alias(own[2])]
    counts = out.groupBy(*known).agg(
        F.sum(copies).cast("int").alias(copied), F.count(F.lit(1)).cast("int").alias(rows), F.min("first_slot").alias(slot), F.max(F.try_divide("source_size", "target")).alias(round_)
    )
    counts = materialize(counts.where(F.col(copied) > 0))
    tagged = docs.withColumns(
        {
            own[0]: F.coalesce(F.col(key).cast("string"), F.lit("null")),
            own[1]: source_key(F.col(source)),
            own[2]: F.xxhash64(text_or_empty(F.col(text))),
        }
    )
    once = semi_by_size(tagged, counts.where(F.col(rows) == 1), own, "inner")
    many = counts.where(F.col(rows) > 1)
    if not many.isEmpty():
        # rows that are the same in key, source and text share their copies out evenly
        again = semi_by_size(tagged, many, own, "inner")
        again = again.withColumn(turn, F.row_number().over(Window.partitionBy(*own).orderBy(copied)))
        share_out = F.floor(F.col(copied) / F.col(rows)).cast("int") + (F.col(turn) <= F.col(copied) % F.col(rows)).cast("int")
        once = once.unionByName(again.withColumn(copied, share_out).drop(turn))
    n = counts.agg(F.coalesce(F.max(slot), F.lit(0))).first()[0] + 1
    placed = once.where(F.col(copied) > 0).withColumn(turn, F.explode(F.sequence(F.lit(0), F.col(copied) - 1)))
    placed = placed.withColumn(slot, F.col(slot) + F.col(turn) * F.col(round_) * F.lit(float(n)))
    ordered = placed.repartitionByRange(task_count(docs.sparkSession), slot).sortWithinPartitions(slot)
    return ordered.drop(*own, copied, rows, slot, round_, turn)
