"""Entity resolution: listings that share a canonical URL or a fingerprint are one deal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_url, fingerprint


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(root or tempfile.gettempdir() + '/bargainry-scratch').rstrip('/')}/bargainry/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that what follows starts from a table."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast only if a count has shown at most this many rows of it.
BROADCAST_ROWS = 500_000


def few_or_many(keys: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def clusters(memberships: DataFrame) -> DataFrame:
    """(id, cluster) from (id, key): ids with a key in common, over any number of steps.

    The cluster is its least id.  Least labels spread from keys to ids and back; both steps
    aggregate on the map side, so a frequent key moves one row per task.
    """
    members = saved(memberships.distinct())
    labels = members.groupBy("id").agg(F.min("id").alias("cluster"))
    while True:
        by_key = members.join(labels, "id").groupBy("key").agg(F.min("cluster").alias("cluster"))
        after = saved(members.join(by_key, "key").groupBy("id").agg(F.min("cluster").alias("cluster")))
        # a cluster's own label may have moved on
        jump = after.select(F.col("id").alias("cluster"), F.col("cluster").alias("to"))
        after = saved(after.join(jump, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster")))
        if after.join(labels.withColumnRenamed("cluster", "before"), "id").where("cluster != before").isEmpty():
            return after
        labels = after


def merge(deals: DataFrame) -> DataFrame:
    """One row per cluster: the row with both prices that was posted first, filled from the others."""
    complete = F.when(F.col("price_now").isNotNull() & F.col("price_was").isNotNull(), 0).otherwise(1)
    far = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    rank = F.struct(complete, F.coalesce("posted_at", far), F.col("id"))
    own = [c for c in deals.columns if c != "cluster"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank))
    sources = F.array_union(F.array("source"), F.coalesce("also_seen_on", F.array().cast("array<string>")))
    merged = {
        "posted_at": F.min("posted_at"),
        "description": F.min_by("description", F.when(F.col("description").isNotNull(), F.struct(-F.length("description"), F.col("id")))),
        "image_url": first("image_url"),
        "price_now": first("price_now"),
        "price_was": first("price_was"),
        "coupon_code": first("coupon_code"),
        "votes": F.sum("votes"),
        "also_seen_on": F.array_sort(F.array_distinct(F.flatten(F.collect_set(sources)))),
    }
    rows = deals.groupBy("cluster").agg(F.min_by(F.struct(*own), rank).alias("__p"), *[m.alias(f"__{c}") for c, m in merged.items() if c in own], F.count(F.lit(1)).alias("merged_rows"))
    return rows.select(*[(F.col(f"__{c}") if c in merged else F.col(f"__p.{c}")).alias(c) for c in own], "merged_rows")


def _alone(deals: DataFrame) -> DataFrame:
    """What ``merge`` makes of a row that is a cluster of its own."""
    sources = F.array_union(F.array("source"), F.coalesce("also_seen_on", F.array().cast("array<string>")))
    seen = {"also_seen_on": F.array_sort(sources)} if "also_seen_on" in deals.columns else {}
    return deals.withColumns(seen | {"merged_rows": F.lit(1).cast("long")})


def _met_again(rows: DataFrame, keys: Column) -> DataFrame | None:
    """The ids of all rows whose id or a key of theirs may be another row's too; None if there are none.

    Ids and keys are as wide as a row, so that numbers are counted in their place.  Equal ones
    have equal numbers; that few others may have the same is left to the caller to see.
    """
    marks = F.concat(F.array(F.xxhash64(F.lit("id"), "id")), F.transform(keys, lambda k: F.xxhash64(F.lit("key"), k)))
    twice = saved(rows.select(F.explode(marks).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"))
    if twice.isEmpty():
        return None
    return saved(rows.select("id", F.explode(marks).alias("mark")).join(few_or_many(twice), "mark", "left_semi").select("id").distinct())


def resolved(deals: DataFrame) -> tuple[DataFrame, bool]:
    """The merged deals as of ``dedupe``, and whether rows had to be dealt out for them."""
    print_ = fingerprint(F.col("merchant_id"), F.col("title"), F.col("price_now"))
    keys = F.array_compact(F.array(F.concat(F.lit("u:"), canonical_url("canonical_url")), F.concat(F.lit("f:"), print_)))
    keyed = deals.where(F.col("id").isNotNull() & (F.col("canonical_url").isNotNull() | print_.isNotNull()))
    known = deals.where("id is not null")
    again = _met_again(known, keys)
    if again is None:
        return _alone(keyed), False
    listed = saved(known.join(few_or_many(again), "id", "left_semi").select("id", F.posexplode_outer(keys).alias("pos", "key")))
    members = listed.where("key is not null").select("id", "key")
    shared = saved(members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("key"))
    linked = members.select("id", F.col("id").alias("cluster")).where(F.lit(False))
    if not shared.isEmpty():
        linked = clusters(members.join(few_or_many(shared), "key", "left_semi"))
    # each row of an id has one first or no key
    rows = listed.groupBy("id").agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n"), F.count("key").alias("keys"))
    again = rows.where("n > 1 and keys > 0").select("id").join(linked, "id", "left_anti")
    together = saved(linked.unionByName(again.withColumn("cluster", F.col("id"))))
    if together.isEmpty():
        return _alone(keyed), False
    together = few_or_many(together)
    alone = _alone(keyed.join(together, "id", "left_anti"))
    return alone.unionByName(merge(deals.join(together, "id"))), True


def dedupe(deals: DataFrame) -> DataFrame:
    """The merged deals, with the number of rows that each stands for.

    Only rows that share a key or an id with another are dealt out to be merged; most share none.
    """
    return resolved(deals)[0]
