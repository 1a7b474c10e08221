"""What a run shuffles and writes: whole rows once, and few columns to find out about them."""

import glob
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bargainry.operators import dedupe, history
from bargainry.schemas import RAW
from bargainry.streaming import ingest, store
from tests.test_store import listing


@pytest.fixture
def joined_by_sort(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def shuffles(df) -> list[str]:
    """The columns of each shuffle in the plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", df._jdf.queryExecution().explainString(mode))


def test_scratch_is_packed(spark):
    saved = dedupe.saved(spark.range(10))
    (name, *_) = [p for p in (f.replace("file://", "") for f in saved.inputFiles()) if pq.ParquetFile(p).metadata.num_rows]
    assert pq.ParquetFile(name).metadata.row_group(0).column(0).compression == "ZSTD"


def test_rows_that_stay_are_not_dealt_out(spark, tmp_path, monkeypatch):
    table = store.Table(str(tmp_path / "t"), ("k",), 3)
    table.write(spark.range(50_000).coalesce(2).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")), 0, {0, 1, 2}, dealt=True)
    old = table.read(spark, 0, placed=True)
    gone = old.where("v % 7 = 0 or v > 49000").select(*store.PLACE)
    want = [v for v in range(50_000) if v % 7 and v <= 49_000]
    left = store.Table.without(old, gone)
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.v for r in left.collect()) == want and left.columns == ["k", "v"]
    monkeypatch.setattr(store, "_BITMAPS", 0)
    assert sorted(r.v for r in store.Table.without(old, gone).collect()) == want
    none = table.read(spark, 0, set(), placed=True)
    assert none.columns == ["k", "v", *store.PLACE] and none.isEmpty()


def test_rows_are_written_where_they_are(spark, tmp_path):
    table = store.Table(str(tmp_path / "t"), ("k",), 2)
    table.write(spark.range(100).repartition(3).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")), 0, {0, 1}, dealt=True)
    assert len(glob.glob(f"{table.root}/data/version=0/bucket=*/*.parquet")) == 6
    assert sorted(r.v for r in table.read(spark).collect()) == list(range(100)) and os.path.isdir(f"{table.root}/manifest")


def test_points_are_dealt_out_once(spark, joined_by_sort):
    point = "id string, deal_id string, price long, observed_at timestamp_ntz"
    rows = [("1", "d", 10, "2024-01-01"), ("2", "d", 12, "2024-01-05"), ("5", "f", 3, "2024-01-01")]
    late = [("3", "d", 12, "2024-01-06"), ("4", "e", 7, "2024-01-03"), ("6", "f", 4, "2024-01-02"), ("7", "d", None, "2024-01-07"), ("8", "g", None, "2024-01-07")]
    made = lambda values: spark.createDataFrame(values, point.replace("timestamp_ntz", "string")).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
    stored, new = made(rows), made(late)
    want = stored.unionByName(history.change_only(new, stored=stored).select(*stored.columns))
    got = history.recorded(stored, new)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()) == ["1", "2", "4", "5", "6", "7"]
    kept = history.prune(got, F.lit("2024-01-03").cast("timestamp_ntz"))
    assert len(shuffles(kept)) == 1 and sorted(r.id for r in kept.collect()) == ["2", "4", "6", "7"]


def test_whole_rows_of_a_run_are_dealt_out_once(spark, joined_by_sort):
    """The second run: found deals meet their facts and the stored deals by number; ten columns in any other shuffle at most."""
    merchants = spark.createDataFrame([("m1", "x", "x.ca")], "id string, slug string, domain string")
    raw = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], RAW)
    now = lambda day: F.to_timestamp_ntz(F.lit(f"2024-01-0{day} 00:00:00"))
    first = ingest.run(raw(*[listing(str(i), "20") for i in range(20)]), merchants, None, None, now(1))
    deals, points = dedupe.saved(first.deals), dedupe.saved(first.points)
    found = ingest.find(raw(listing("3", "18"), listing("4", "20"), listing("new", "5")), merchants, deals, lambda ids: points, now(2))
    met = ingest.meet(found, deals)
    after, new = ingest.record(found, met, deals.where("source_id not in ('3', '4')"), now(2))
    wide = [columns for columns in shuffles(after) if columns.count(",") > 9]
    assert len(wide) == 1 and "description" in wide[0]
    known = {r.source_id: r for r in deals.collect()}
    rows = {r.source_id: r for r in after.collect()}
    assert len(rows) == 21 and after.count() == 21
    assert {(i, r.price_now, r.id == known[i].id if i in known else True, r.first_seen_at.day, r.last_seen_at.day) for i, r in rows.items() if i in ("3", "4", "new", "5")} == {("3", 1800, True, 1, 2), ("4", 2000, True, 1, 2), ("new", 500, True, 2, 2), ("5", 2000, True, 1, 1)}
    assert sorted(r.price for r in new.collect()) == [500, 1800]
    totals = ingest.counted(found, met).first()
    assert (totals.total_new, totals.total_updated, totals.total_found) == (1, 2, 3)
