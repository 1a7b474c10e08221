"""Unions, first-wins unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_wins(paths: list[DataFrame], keys: list[str], path: str = "path") -> DataFrame:
    """One row per key, from the first path that has it; ``path`` tells which (from 1).

    An aggregation with partial results, so a frequent key costs each task one row.
    """
    rows = union_all([df.withColumn(path, F.lit(i)) for i, df in enumerate(paths, 1)])
    rest = [c for c in rows.columns if c not in (*keys, path)]
    best = rows.groupBy(*keys).agg(F.min(F.struct(path, *rest)).alias("__best"))
    return best.select(*keys, F.col(f"__best.{path}").alias(path), *[F.col(f"__best.{c}").alias(c) for c in rest])


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
