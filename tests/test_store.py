"""Tables in buckets: what a version writes, replays, what is due, and what is forgotten."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bargainry.operators import mutations
from bargainry.schemas import RAW
from bargainry.streaming import ingest
from bargainry.streaming.store import Table

SCHEMA = "k string, v long, until timestamp_ntz"


@pytest.fixture
def table(spark, tmp_path):
    at = Table(str(tmp_path / "t"), ("k",), 8)
    at.write(rows(spark, *[(f"k{i}", i, None) for i in range(40)]), 0, set(range(8)))
    return at


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def files(at):
    return {os.path.relpath(os.path.join(d, f), at.root): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(at.root) for f in names if f.endswith(".parquet")}


def put(spark, at, n, *values):
    new = rows(spark, *values)
    touched = at.touched(new)
    at.write(mutations.upsert(at.read(spark, n - 1, touched), new, ["k"], []), n, touched, F.col("until"))
    return touched


def content(spark, at, version=None):
    return {r.k: r.v for r in at.read(spark, version).collect()}


def test_one_bucket_is_written(spark, table):
    before, old = files(table), content(spark, table)
    touched = put(spark, table, 1, ("k3", 100, None))
    after = files(table)
    assert len(touched) == 1 and {f for f in after if f not in before and f.startswith("data")} == {f for f in after if f.startswith(f"data/version=1/bucket={min(touched)}/")}
    assert all(after[f] == t for f, t in before.items())
    assert content(spark, table) == old | {"k3": 100} and content(spark, table, 0) == old


def test_a_replay_changes_nothing(spark, table):
    put(spark, table, 1, ("k3", 100, None), ("new", 1, None))
    once = content(spark, table)
    put(spark, table, 1, ("k3", 100, None), ("new", 1, None))
    assert content(spark, table) == once and len(once) == 41
    table.write(rows(spark), 2, set())
    assert content(spark, table) == once


def test_without_a_manifest_there_is_no_version(spark, table):
    old = content(spark, table)
    rows(spark, ("k1", -1, None)).withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.root}/data/version=1")
    assert table.latest(spark) == 0 and content(spark, table) == old
    put(spark, table, 1, ("k2", 7, None))
    assert content(spark, table) == old | {"k2": 7}


def test_emptied_buckets_and_due_ones(spark, table):
    one = put(spark, table, 1, ("k5", 5, datetime(2024, 1, 2)))
    assert table.due(spark, 1, datetime(2024, 1, 1)) == set() and table.due(spark, 1, datetime(2024, 1, 2)) == one
    left = {k: v for k, v in content(spark, table).items() if k not in {r.k for r in table.read(spark, 1, one).collect()}}
    table.write(rows(spark), 2, one)
    assert content(spark, table) == left and table.due(spark, 2, datetime(2025, 1, 1)) == set() and table.read(spark, 2, one).count() == 0


def test_rows_of_buckets_that_were_not_read(spark, table):
    with pytest.raises(ValueError, match="not read"):
        table.write(rows(spark, *[(f"k{i}", 0, None) for i in range(9)]), 1, {0})


def test_forgotten_versions(spark, table):
    for n in (1, 2, 3):
        put(spark, table, n, ("k3", n, None))
    now, count = content(spark, table), len(files(table))
    gone = table.forget(spark, before=3)
    assert gone == 3 + 3 and content(spark, table) == now and len(files(table)) < count
    assert table.forget(spark, before=3) == 0


def listing(id, price, **more):
    names = [f.split()[0] for f in RAW.split(", ")]
    return dict.fromkeys(names) | {"source": "s", "source_id": id, "title": f"Gadget q{id}w{id}", "url": f"https://x.ca/{id}", "merchant_domain": "x.ca", "price": price} | more


def test_batches_in_buckets(spark, tmp_path):
    """A price that changes, a new site, an expiry and absences; the second batch runs twice.  (The queries hold batches against whole runs.)"""
    merchants = spark.createDataFrame([("m1", "x", "x.ca")], "id string, slug string, domain string")
    batches = [
        [listing(str(i), "20") for i in range(12)] + [listing("e", "9", expires_at="2024-01-03T00:00:00Z")],
        [listing("3", "18"), listing("4", "20"), listing("new", "5", url="https://y.ca/n", merchant_domain="y.ca")],
    ]
    at = ingest.lake(str(tmp_path / "lake"), 32)
    seen = []
    for n, day in ((0, 1), (1, 2), (1, 2)):
        raw, now = spark.createDataFrame([tuple(r.values()) for r in batches[n]], RAW), F.to_timestamp_ntz(F.lit(f"2024-01-0{day} 00:00:00"))
        ingest.ingest(raw, at, merchants, n, now)
        seen.append(sorted((r.source_id, r.price_now, r.status) for r in at.deals.read(spark).collect()))
    assert seen[1] == seen[2] and dict((i, p) for i, p, _ in seen[2]) | {"3": 1800, "new": 500, "0": 2000} == dict((i, p) for i, p, _ in seen[2])
    assert sorted(r.price for r in at.points.read(spark).collect()) == sorted([2000] * 12 + [900, 1800, 500])
    assert {r.domain for r in at.merchants.read(spark).collect()} == {"x.ca", "y.ca"}
    assert at.runs.read(spark, 1).count() == 2 and at.totals.read(spark, 1).count() == 2
    versions = [r.at for r in at.deals.manifest(spark, 1)]
    assert 1 <= versions.count(1) <= 3  # three listings: all other buckets are those of version 0
    due = at.deals.due(spark, 1, datetime(2024, 1, 3))
    assert due == at.deals.touched(at.deals.read(spark).where("source_id = 'e'")) and len(at.deals.due(spark, 1, datetime(2024, 1, 6))) > 5
