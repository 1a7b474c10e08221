"""Verification against a plain count over all pairs."""

import math
import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from bargainry.operators import dedupe, verify

NOW = datetime(2024, 1, 1)
DEALS = "id int, source string, merchant_id string, product_key string, product_key_strength string, price_now long, price_was long, discount_pct double, votes long, posted_at timestamp_ntz"
PRICES = [0, 1, 5, 4095, 4096, 4097, 8192, 9000, 9000, 70_000, 70_001, 1 << 40]


def half_up(x, digits=0):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def tables(seed):
    rng = random.Random(seed)
    deals = [
        (i, "x", rng.choice([None, *"abcdefg"[: 1 + i % 7]]), rng.choice([None, "p", "q", "r", "s"]), rng.choice(["gtin", "gtin", "mpn", "model", None]), rng.choice([None, *PRICES]), rng.choice([None, 9500, 80_000]), None, 3, NOW)
        for i in range(90)
    ]
    points = [(rng.choice(["p", "q", "r"]), rng.choice([None, *PRICES]), NOW - timedelta(days=rng.randrange(90))) for _ in range(60)] + [("s", 5, NOW), ("s", 6, NOW)]
    return deals, points


def expected(deals, points):
    best = {}
    for _, _, merchant, product, _, price, *_ in deals:
        if None not in (merchant, product, price):
            best[product, merchant] = min(price, best.get((product, merchant), price))
    for i, _, merchant, product, strength, price, *_ in deals:
        rivals = [p for (k, m), p in best.items() if k == product and m != merchant and p > 0] if strength in ("gtin", "mpn", "asin") else []
        market = int(half_up(median(rivals))) if len(rivals) >= 2 and price is not None else None
        prior = [p for k, p, _ in points if k == product and p is not None and p > 0]
        known = price is not None and len(prior) >= 3
        since = min((at for k, _, at in points if k == product), default=NOW)
        yield (
            i,
            len(rivals),
            market,
            half_up((market - price) / market * 100, 1) if market else None,
            min(*prior, price) if known else None,
            half_up(sum(p < price for p in prior) / len(prior) * 100, 1) if known else None,
            (NOW - since).days,
        )


@pytest.mark.parametrize("seed", range(3))
def test_verify(spark, seed):
    deals, points = tables(seed)
    out = verify.verify(spark.createDataFrame(deals, DEALS), spark.createDataFrame(points, "product_key string, price long, observed_at timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz"))
    rows = out.select("id", "competitors", "market_price", "market_discount_pct", "observed_low", "price_rank_pct", F.col("history_days").cast("int")).collect()
    assert sorted(map(tuple, rows)) == list(expected(deals, points))


def test_no_row_holds_a_group(spark):
    deals, points = tables(0)
    out = verify.verify(spark.createDataFrame(deals, DEALS), spark.createDataFrame(points, "product_key string, price long, observed_at timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan


def test_merge_gathers_a_source_once(spark):
    rows = spark.range(6).select(
        F.col("id").cast("string").alias("id"), F.lit("k").alias("cluster"), (F.col("id") % 2).cast("string").alias("source"), F.lit(None).cast("array<string>").alias("also_seen_on"),
        *[F.lit(None).cast("string").alias(c) for c in ("description", "image_url", "coupon_code")],
        F.lit(1).cast("long").alias("price_now"), F.lit(2).cast("long").alias("price_was"), F.lit(NOW).cast("timestamp_ntz").alias("posted_at"), F.col("id").alias("votes"),
    )
    merged = dedupe.merge(rows)
    assert "collect_list" not in merged._jdf.queryExecution().optimizedPlan().toString()
    (row,) = merged.collect()
    assert row.also_seen_on == ["0", "1"] and row.merged_rows == 6 and row.votes == 15


def test_only_linked_rows_are_dealt_out(spark):
    """Rows that share a key or an id are merged; the others pass by, so that their width is not shuffled."""
    row = lambda id_, url, title="A lamp of brass", votes=1: (id_, "s", url, title, "m", 100, 200, None, None, None, votes, ["t", "s"], NOW)
    schema = "id string, source string, canonical_url string, title string, merchant_id string, price_now long, price_was long, description string, image_url string, coupon_code string, votes long, also_seen_on array<string>, posted_at string"
    rows = [row("a", "https://x.ca/1", "One thing alone"), row("b", "https://x.ca/2"), row("c", "https://x.ca/2", "Named otherwise here"), row("d", "https://x.ca/3"), row("e", "https://x.ca/4", "Twice listed thing", 3), row("e", "https://x.ca/5", "By another name now", 4), row("f", None, None), row("g", None, None)]
    df = dedupe.saved(spark.createDataFrame(rows, schema).withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz")))
    got = {r.id: (r.merged_rows, r.votes, r.also_seen_on) for r in dedupe.dedupe(df).collect()}
    assert got == {"a": (1, 1, ["s", "t"]), "b": (3, 3, ["s", "t"]), "e": (2, 7, ["s", "t"])}
    out = dedupe.dedupe(df.where("id in ('a', 'd')"))
    assert {r.id: r.merged_rows for r in out.collect()} == {"a": 1, "d": 1}
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_an_empty_lake_is_known_to_be_empty(spark):
    """Nothing is dealt out to meet a table without rows."""
    from bargainry.operators import mutations

    found = dedupe.saved(spark.createDataFrame([("s", "1", "a", 5)], "source string, source_id string, id string, price_now long")).withColumn("last_seen_at", F.lit(NOW).cast("timestamp_ntz")).withColumn("first_seen_at", F.col("last_seen_at"))
    after, new = mutations.upsert_deals(mutations.nothing(spark, found.schema), found, F.lit(NOW).cast("timestamp_ntz"))
    assert "Join" not in after._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in new.collect()] == [("a", 5)] and after.count() == 1
