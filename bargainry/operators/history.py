"""Price series, source runs and token usage."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def price_history(points: DataFrame, keys: DataFrame) -> DataFrame:
    """The points of the given product keys, by product and time."""
    return points.join(keys.select("product_key").distinct(), "product_key", "left_semi").orderBy("product_key", "observed_at", "id")


def change_only(points: DataFrame, key: str = "deal_id", stored: DataFrame | None = None) -> DataFrame:
    """The points whose price differs from the one before, in order of time and id.

    With ``stored`` points, the latest of each key comes before the new ones.
    """
    rows = points.withColumn("__new", F.lit(True))
    if stored is not None:
        last = stored.groupBy(key).agg(F.max_by(F.struct(*stored.columns), F.struct("observed_at", "id")).alias("x")).select("x.*")
        rows = rows.unionByName(last.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__new", "observed_at", "id")
    before = F.lag("price").over(order)
    return rows.withColumn("__before", before).where(F.col("__new") & ~F.col("price").eqNullSafe(F.col("__before"))).drop("__new", "__before")


def recorded(stored: DataFrame, new: DataFrame, key: str = "deal_id") -> DataFrame:
    """The stored points with the changes among the new ones, as of ``change_only``; both are dealt out by key once, for what follows too."""
    rows = stored.withColumn("__new", F.lit(False)).unionByName(new.select(*stored.columns).withColumn("__new", F.lit(True)))
    before = F.lag("price").over(Window.partitionBy(key).orderBy("__new", "observed_at", "id"))
    return rows.withColumn("__before", before).where(~F.col("__new") | ~F.col("price").eqNullSafe(F.col("__before"))).drop("__new", "__before")


def prune(points: DataFrame, cutoff: Column, key: str = "deal_id") -> DataFrame:
    """Points since the cutoff, and the newest of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc("observed_at"), F.desc("id"))
    return points.withColumn("__rank", F.row_number().over(newest)).where((F.col("observed_at") >= cutoff) | (F.col("__rank") == 1)).drop("__rank")


def chart(points: DataFrame, key: str) -> DataFrame:
    """low, high, last price, time of the first low, and whether the series is flat."""
    return points.groupBy(key).agg(
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.max_by("price", F.struct("observed_at", "id")).alias("last_price"),
        F.min(F.struct("price", "observed_at")).alias("__low"),
        F.count(F.lit(1)).alias("points"),
    ).select(key, "low", "high", "last_price", F.col("__low.observed_at").alias("low_at"), "points", (F.col("low") == F.col("high")).alias("flat"))


def source_health(runs: DataFrame) -> DataFrame:
    """The latest run of each source; all of them if several started at once."""
    latest = Window.partitionBy("source").orderBy(F.desc("started_at"))
    return runs.withColumn("__rank", F.rank().over(latest)).where("__rank = 1").drop("__rank").orderBy("source", "id")


def staleness(runs: DataFrame, now: datetime, most: timedelta) -> DataFrame:
    last = runs.agg(F.max(F.when(F.col("outcome") == "ok", F.col("started_at"))).alias("last_success"))
    cutoff = F.lit(now - most).cast("timestamp_ntz")
    return last.select("last_success", (F.col("last_success").isNull() | (F.col("last_success") < cutoff)).alias("stale"))


def usage_summary(usage: DataFrame, *by: str) -> DataFrame:
    read, fresh = F.sum("cache_read_tokens"), F.sum("input_tokens")
    return usage.groupBy(*by).agg(
        F.countDistinct("conversation_id").alias("conversations"),
        F.count(F.lit(1)).alias("turns"),
        fresh.alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.coalesce(F.try_divide(read, read + fresh), F.lit(0.0)).alias("cache_hit_ratio"),
    )


def cost_report(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cents by model; null where a model has no rate.  ``rates`` lists the models one by one."""
    cost = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate") + F.col("cache_read_tokens") * F.col("cache_rate")) / 1_000_000 * 100
    rows = usage.join(rates, "model", "left").withColumn("__cost", cost)
    out = rows.groupBy("model").agg(F.when(F.count("__cost") == F.count(F.lit(1)), F.sum("__cost")).alias("cents"), F.countDistinct("conversation_id").alias("conversations"))
    return out.withColumn("cents_per_conversation", F.try_divide("cents", "conversations"))
