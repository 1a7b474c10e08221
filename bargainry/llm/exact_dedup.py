"""Exact deduplication by a log-structured merge index, with DataFrame functions only.

* memtables: the documents are dealt to memtables by a hash of their id.  Each is flushed as a
  run in a folder of its own: files sorted by digest, with a row per digest and id.  A run has
  a filter besides, a bitmap of its digests' hashes, in buckets of 2^15 bits.
* probe: the digests of a run are looked up in the filters of the runs before it.  What no
  filter holds is new and passes; the rest may be hits.
* compaction: only the possible hits and the rows that they meet in earlier runs are merged,
  to a row per digest with the identifier that survives and the size of the group; all
  others pass as they are.  The merge aggregates each run before runs meet, so a group with a
  third of all rows costs a task one row for each run.
* hits: digests with more than one row receive byte verification; the smallest and the
  largest text of a digest (partial on the map side) have to be the same bytes.
  Where they differ, the digest is split by the texts themselves.
* ``find`` looks single digests up and reads only the row groups whose Bloom filters and
  bounds let them pass.

The index keeps the smallest identifier unless ``keep="largest"``.

Texts are equal when the same after lower-casing A-Z only.  Defined results: a null text
is an empty text; null ids come after all others and stay only in a group that has no
other; of repeated rows (same id and text) one stays; texts of any length are digested and
compared whole; an empty table gives no rows; further columns are kept by ``deduplicate``,
whatever their names, and ignored by ``decide``.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, semi_by_size, text_or_empty, unused

MEMTABLES = 16
#: A filter has so many bits for each digest of all runs, in buckets of 2^15 bits (4 kB).
FILTER_BITS = 16
_BUCKET_BITS = 1 << 15
#: Buckets of all filters that are broadcast at most: 32 MB.
_BROADCAST_BUCKETS = 8_000


def normalized(text: Column) -> Column:
    """Lower-cases A-Z only; plain lower() does the same, faster, on texts in ASCII."""
    text = text_or_empty(text)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def flush(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column] = sha256, memtables: int = MEMTABLES) -> DataFrame:
    """Level 0: the runs of all memtables, with columns digest, id, rows, run."""
    body = normalized(F.col(text))
    run = F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int")
    rows = docs.select(F.col(key).alias("id"), digest(body).alias("digest")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows"))
    return materialize(rows.withColumn("run", run), "run", "digest", bloom="digest", folders="run")


def probe(runs: DataFrame) -> DataFrame:
    """The digests of runs (digest, run) that the filters of earlier runs may hold, each once."""
    buckets = max(1, -(-runs.count() * FILTER_BITS // _BUCKET_BITS))
    h = F.xxhash64("digest")
    placed = runs.select("digest", "run", F.pmod(h, F.lit(buckets)).alias("bucket"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(_BUCKET_BITS)).alias("bit"))
    filters = placed.groupBy("run", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    earlier = Window.partitionBy("bucket").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run
    filters = materialize(filters.select("run", "bucket", F.bitmap_or_agg("bits").over(earlier).alias("bits")))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return semi_by_size(placed, filters, ["run", "bucket"], "inner", _BROADCAST_BUCKETS).where(held).select("digest").distinct()


def compact(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """Level 1: a row per digest with the identifier to keep and the number of rows."""
    survivor = F.max if keep == "largest" else F.min
    own = materialize(runs.groupBy("run", "digest").agg(survivor("id").alias("keep"), F.sum("rows").alias("size")))
    hits = materialize(probe(own))
    new = semi_by_size(own, hits, ["digest"], "left_anti").select("digest", "keep", "size")
    merged = semi_by_size(own, hits, ["digest"]).groupBy("digest").agg(survivor("keep").alias("keep"), F.sum("size").alias("size"))
    return materialize(new.unionByName(merged), "digest", bloom="digest")


def find(index: DataFrame, digests: list[str]) -> DataFrame:
    """The rows of a level of the index (``flush`` or ``compact``) with one of a few digests."""
    return index.where(F.col("digest").isin(digests))


def collisions(docs: DataFrame, text: str, level1: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Byte verification of the hits: the digests that stand for more than one text."""
    hits = materialize(level1.where("size > 1").select("digest"))
    body = normalized(F.col(text))
    texts = semi_by_size(docs.select(digest(body).alias("digest"), body.alias("body")), hits, ["digest"])
    spread = texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    return materialize(spread.where(F.col("least") != F.col("most")).select("digest"))


def decide(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """A row per document: ``key``, keep_id, group_size, kept, digest."""
    runs = flush(docs, key, text, digest)
    level1 = compact(runs, keep)
    clashing = collisions(docs, text, level1, digest)
    shared = materialize(level1.where("size > 1"))
    decided = semi_by_size(runs.select("digest", "id", "rows"), shared, ["digest"], "left")
    decided = decided.select("digest", "id", "rows", F.coalesce("keep", "id").alias("keep"), F.coalesce("size", "rows").alias("size"))
    if not clashing.isEmpty():
        body = normalized(F.col(text))
        split = (
            semi_by_size(docs.select(F.col(key).alias("id"), digest(body).alias("digest"), body.alias("body")), clashing, ["digest"])
            .groupBy("digest", "body", "id")
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        survivor = F.max("id") if keep == "largest" else F.min("id")
        texts = split.groupBy("digest", "body").agg(survivor.alias("keep"), F.sum("rows").alias("size"))
        exact = split.join(texts, ["digest", "body"]).select("digest", "id", "rows", "keep", "size")
        decided = semi_by_size(decided, clashing, ["digest"], "left_anti").unionByName(exact)
    copies = F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")
    return decided.select("*", copies).select(
        F.col("id").alias(key),
        F.col("keep").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns."""
    decided = decide(docs, key, text, keep)
    own = [unused("digest", docs), unused("id", docs)]
    known = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    dropped = decided.groupBy(F.col("digest").alias(own[0]), known.alias(own[1])).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    dropped = materialize(dropped.where("not stays or rows > 1"))
    tagged = docs.withColumns({own[0]: sha256(normalized(F.col(text))), own[1]: known})
    single = semi_by_size(tagged, dropped.select(*own), own, "left_anti")
    repeated = materialize(dropped.where("stays and rows > 1").select(*own))
    if not repeated.isEmpty():
        again = semi_by_size(tagged, repeated, own).dropDuplicates(own)
        single = single.unionByName(again)
    return single.drop(*own)
