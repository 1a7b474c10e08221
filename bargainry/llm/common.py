"""Helpers shared by the operators: tables, scratch space and distributed prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side of a join is broadcast only if a count has shown at most this many rows of
#: fixed width; above it the same join is shuffled.
BROADCAST_ROWS = 500_000

#: Rows of an Arrow batch, in place of Spark's default.
ARROW_ROWS, _SPARKS_ROWS = 1000, "10000"

#: What separates words: space, tab, newline, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own where it names none and all is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return (root or f"{tempfile.gettempdir()}/bargainry-scratch").rstrip("/")


def materialize(df: DataFrame, *sort: str, bloom: str | None = None, folders: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.  The files
    have Bloom filters on the column ``bloom``, as large as their number of values asks for;
    each value of the column ``folders`` has files of its own.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/bargainry/{uuid.uuid4().hex}"
    writer = (df.sortWithinPartitions(*sort) if sort else df).write
    if folders:
        writer = writer.partitionBy(folders)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory to the system, as a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow in batches of ``ARROW_ROWS``, which bounds what a task holds of long texts at once.

    Spark has no such bound for a single operator.  The session's is set, to the same value
    by all operators, unless the user has set one.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == _SPARKS_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df.mapInArrow(run, schema)


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def semi_by_size(left: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", most: int | None = None) -> DataFrame:
    """A join with ``keys``, which are broadcast if they are few (``most`` rows), else shuffled.

    ``keys`` has to be a materialized table, as it is counted first.
    """
    most = BROADCAST_ROWS if most is None else most
    small = keys.limit(most + 1).count() <= most
    return left.join(F.broadcast(keys) if small else keys, on, how)


def running_before(
    df: DataFrame, group: list[str], position: Column, order: list[Column], weight: Column, buckets: int, out: str
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of the group that come before.

    ``position`` maps a row to [0, 1) and never decreases along ``order``.  A group is cut
    into ``buckets`` ranges of it, so that its rows are summed in many tasks, and the totals
    of the ranges (a row per group and range) give each range its start.
    """
    cut = F.least(F.floor(position * buckets), F.lit(buckets - 1)).cast("int")
    df = df.withColumn("__range", cut).withColumn("__weight", weight)
    within = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__inner", F.coalesce(F.sum("__weight").over(within), F.lit(0)))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*group, "__range")
        .agg(F.sum("__weight").alias("__total"))
        .withColumn("__start", F.coalesce(F.sum("__total").over(before), F.lit(0)))
        .select(*group, "__range", "__start")
    )
    return (
        rows.join(starts, [*group, "__range"])
        .withColumn(out, (F.col("__inner") + F.col("__start")).cast("long"))
        .drop("__range", "__weight", "__inner", "__start")
    )


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """Adds ``out``: the number of rows that come before in the order of ``by``, whose values differ.

    The rows are dealt to ranges of ``by``; a row per range gives each its start.
    """
    parts = materialize(df.repartitionByRange(task_count(df.sparkSession), by).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return parts.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn(out, F.col("__place") + F.col("__start")).drop("__part", "__place", "__start")


def unit_hash(*cols: Column) -> Column:
    """A hash of the columns as a double in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
