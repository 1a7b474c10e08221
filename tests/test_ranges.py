"""Standing of prices, running sums and pairs of places against plain loops."""

import random
from datetime import datetime, timedelta
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bargainry.operators import nearby, running, standing

DAY = datetime(2024, 1, 1)


def test_running_before(spark):
    rng = random.Random(1)
    rows = [(g, t, rng.randrange(100)) for g, n in (("a", 600), ("b", 1), ("c", 40)) for t in rng.sample(range(2000), n)]
    got = running.running_before(spark.createDataFrame(rows, "g string, t int, v int"), ["g"], [F.col("t").desc()], {"s": F.col("v"), "n": F.lit(1)}, {"low": F.col("v")})
    for r in got.collect():
        before = [v for g, t, v in rows if g == r.g and t > r.t]
        assert (r.s, r.n, r.low) == (sum(before), len(before), min(before, default=None))
    assert running.running_before(spark.createDataFrame([], "g string, t int, v int"), ["g"], [F.col("t")], {"s": F.col("v")}).count() == 0


def series(seed):
    """A product with most points, one with one time, ties of time and price, repeated rows, points without a product, time or price."""
    rng = random.Random(seed)
    rows = [("big", DAY + timedelta(hours=rng.randrange(400)), rng.randrange(1, 90)) for _ in range(900)]
    rows += [(f"p{rng.randrange(60)}", DAY + timedelta(hours=rng.randrange(40)), rng.randrange(1, 9)) for _ in range(300)]
    rows += [("once", DAY, rng.randrange(1, 9)) for _ in range(60)] + [("flat", DAY + timedelta(hours=i), 5) for i in range(60)]
    rows += rows[:20] + [(None, DAY, 4), ("big", None, 4), ("big", DAY, None), ("big", DAY, 0), ("big", DAY, -3)]
    rng.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 7])
def test_standing(spark, block):
    rows = series(block)
    points = spark.createDataFrame([(*r, "x", 1) for r in rows], "id int, product_key string, observed_at timestamp, price long, n string, block int")
    got = {r.id: (r.before, r.below, r.low, r.rank_pct) for r in standing.standing(points, block=block).collect()}
    assert len(got) == len(rows)
    sound = [r for r in rows if r[1] is not None and r[2] is not None and (r[3] or 0) > 0]
    for id, key, at, price in rows:
        want = (None, None, None, None)
        if (id, key, at, price) in sound:
            earlier = [p for _, k, t, p in sound if k == key and t < at]
            below = sum(p < price for p in earlier)
            share = int(below / len(earlier) * 1000 + 0.5) / 10 if len(earlier) >= 3 else None
            want = (len(earlier), below, min(earlier, default=None), share)
        assert got[id] == want


def test_standing_of_nothing(spark):
    none = spark.createDataFrame([], "id int, product_key string, observed_at timestamp, price long")
    assert standing.standing(none).count() == 0


def km(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * asin(min(1, sqrt(h)))


def places(seed, n):
    """Everywhere, at the poles, on both sides of the date line, a crowd in one place, and no places."""
    rng = random.Random(seed)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n)] + [(rng.choice([89.9, -89.95, 90.0, -90.0]), rng.uniform(-180, 180)) for _ in range(n // 4)]
    spots += [(rng.uniform(-5, 5), rng.choice([179.9, -179.9, 180.0, -180.0])) for _ in range(n // 4)] + [(10.0 + rng.random() / 50, 20.0) for _ in range(n // 2)]
    return [*enumerate(spots), (9001, (None, 1.0)), (9002, (91.0, 1.0)), (9003, (1.0, 181.0)), (9004, (float("nan"), 1.0))]


@pytest.mark.parametrize(("distance", "split"), [(1, 4096), (90, 10), (1500, 10), (9000, 30), (19000, 4096)])
def test_within_km(spark, distance, split):
    left, right = places(distance, 160), places(distance + 1, 60)
    make = lambda rows: spark.createDataFrame([(i, la, ln, "x") for i, (la, ln) in rows], "id int, lat double, lng double, band string")
    got = nearby.within_km(make(left), make(right), distance, split=split)
    pairs = sorted((r.id, r.near_id) for r in got.collect())
    known = [r for r in left if r[0] < 9000], [r for r in right if r[0] < 9000]
    assert pairs == sorted((i, j) for i, a in known[0] for j, b in known[1] if km(a, b) <= distance)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("bad", [0, -1, 30000])
def test_no_distance(spark, bad):
    none = spark.createDataFrame([], "id int, lat double, lng double")
    with pytest.raises(ValueError):
        nearby.within_km(none, none, bad)


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_blocks_of_any_size_in_any_batches(cut):
    """Blocks are counted together, in n log(n), wherever batches end."""
    rng = random.Random(cut)
    blocks = [(g, b) for g in "ab" for b in range(3)]
    rows = [(g, b, rng.randrange(9), rng.randrange(1, 4)) for g, b in blocks for _ in range(rng.choice([1, 2, 17, 64]))]
    table = pa.table(dict(zip(("group", "block", "price", "n"), map(list, zip(*rows, strict=True)), strict=True)))
    got = pa.Table.from_batches(standing._inside(iter(table.to_batches(max_chunksize=cut)))).to_pylist()
    want = [sum(n for g, b, price, n in rows[:i] if (g, b) == r[:2] and price < r[2]) for i, r in enumerate(rows)]
    assert [r["lower"] for r in got] == want and [tuple(r.values())[:4] for r in got] == rows


def test_a_large_block_is_counted_at_once():
    """Each pair held against each would be 65,536 squared truth values, 4 GB."""
    n = standing.BLOCK
    price = np.arange(n) * 7919 % n
    lower = standing._lower(np.zeros(n, np.int64), price, np.ones(n, np.int64))
    assert n > 50_000 and all(lower[i] == (price[:i] < price[i]).sum() for i in range(0, n, 5000))


def test_small_groups_are_dealt_out_once(spark):
    """Groups of at most a block of points take one shuffle of their rows."""
    points = spark.createDataFrame([(i, f"p{i % 9}", DAY + timedelta(hours=i % 5), i % 7 + 1) for i in range(90)], "id int, product_key string, observed_at timestamp, price long")
    out = standing.standing(points)
    assert out.count() == 90
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange") == 1


def test_rows_of_one_place_follow_each_other(spark):
    """A distance is worked out once for them, and a file of all pairs packs well; a crowd in one place is dealt to parts all the same."""
    left = spark.range(300).select("id", (45 + F.col("id") % 3 / 100).alias("lat"), F.lit(-75.0).alias("lng"))
    right = spark.range(7).select("id", (45 + F.col("id") / 100).alias("lat"), F.lit(-75.0).alias("lng"))
    for split in (4096, 16):
        rows = nearby.within_km(left, right, 50, split=split).collect()
        assert sorted((r.id, r.near_id) for r in rows) == [(i, j) for i in range(300) for j in range(7)]
        if split == 4096:  # 100 rows a place meet as 64 and 36
            pairs = [(r.lat, r.near_id) for r in rows]
            assert 1 + sum(a != b for a, b in zip(pairs, pairs[1:], strict=False)) <= 3 * 7 * 2
