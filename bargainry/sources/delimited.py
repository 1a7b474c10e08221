"""Folders of delimited files, each with a delimiter, a byte order mark and a header of its own."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Different headers in one read at most, as each is a scan of its own.
MOST_SHAPES = 500


def headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of the files that have one; a row per file comes to the driver."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("n"))
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "n").alias("line"))  # of a file's first block, rows keep their order
    return [(unquote(r.file), r.line.lstrip("﻿")) for r in first.collect()]


def shape(line: str) -> tuple[str, tuple[str, ...]]:
    """The delimiter, a tab if the header has more tabs than commas, and the names of the columns: trimmed, in small letters."""
    delimiter = "\t" if line.count("\t") > line.count(",") else ","
    return delimiter, tuple(name.strip().lower() for name in next(csv.reader([line], delimiter=delimiter), []))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """file, and the columns of all headers by name (texts, null where a file or row has none), of all files below ``path``.

    Files are read by Spark, those of one shape together, each file in one task, as line
    breaks may be quoted.  Of columns with one name in a file the last counts, columns without
    a name are left out, and so are rows without anything in them.  A header is one line.
    """
    files: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for file, line in headers(spark, path):
        files.setdefault(shape(line), []).append(file)
    if len(files) > MOST_SHAPES:
        raise ValueError(f"{len(files)} different headers in {path}, more than {MOST_SHAPES}")
    out = None
    for (delimiter, names), own in sorted(files.items()):
        at = {name: i for i, name in enumerate(names) if name}
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        rows = spark.read.csv(sorted(own), schema=schema, sep=delimiter, header=True, quote='"', escape='"', multiLine=True)
        cells = [F.nullif(F.regexp_replace(f"c{i}", r"^\s+|\s+$", ""), F.lit("")).alias(name) for name, i in at.items()]
        part = rows.select(F.col("_metadata.file_path").alias("file"), *cells)
        part = part.where(F.coalesce(*[F.col(f"`{name}`") for name in at]).isNotNull()) if at else part.where("false")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "file string")
