"""Sums and minima of what comes before, in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedupe import saved


def tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def running_before(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column] | None = None, lows: dict[str, Column] | None = None) -> DataFrame:
    """Adds the sums (0 at first) and minima (null at first) over the rows of the group that come before.

    Rows are dealt to ranges of group and order, so that a large group has many tasks; a row
    per group and range gives each range its start.  Group columns are not null, and no two
    rows of a group are alike in the order.
    """
    sums, lows = sums or {}, lows or {}
    parts = saved(rows.repartitionByRange(tasks(rows), *group, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = parts.groupBy("__part", *group).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], *[F.min(c).alias(f"__{n}") for n, c in lows.items()])
    starts = totals.select("__part", *group, *[F.coalesce(F.sum(f"__{n}").over(earlier), zero).alias(f"__{n}") for n in sums], *[F.min(f"__{n}").over(earlier).alias(f"__{n}") for n in lows])
    out = parts.withColumns({n: F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()} | {n: F.min(c).over(inside) for n, c in lows.items()})
    out = out.join(starts, ["__part", *group])
    out = out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums} | {n: F.least(n, f"__{n}") for n in lows})
    return out.drop("__part", *[f"__{n}" for n in (*sums, *lows)])
