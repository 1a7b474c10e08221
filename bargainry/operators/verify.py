"""Verification: competitor medians, price history, verdicts and ranking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import half_up, heat, percent
from ..schemas import COMPARABLE

MARKET_LEAST, HISTORY_LEAST, NEAR_LOW, ANCHOR = 2, 3, 1.02, 1.25


def best_prices(deals: DataFrame) -> DataFrame:
    """The lowest current price of each product at each merchant."""
    priced = deals.where(F.col("price_now").isNotNull() & F.col("merchant_id").isNotNull() & F.col("product_key").isNotNull())
    return priced.groupBy("product_key", "merchant_id").agg(F.min("price_now").alias("best_price"))


def ladder(prices: DataFrame) -> DataFrame:
    """product_key, price, n (the summed ``weight``), below (the weight at lower prices), total.

    Prices are summed before a product's meet in its window, so a product of any number of
    offers brings a row per different price.
    """
    steps = prices.groupBy("product_key", "price").agg(F.sum("weight").alias("n"))
    product = Window.partitionBy("product_key")
    lower = product.orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumns({"below": F.coalesce(F.sum("n").over(lower), F.lit(0)), "total": F.sum("n").over(product)})


def markets(best: DataFrame) -> DataFrame:
    """A row per product: the number of its best prices, the two lowest and the three in the middle."""
    steps = ladder(best.select("product_key", F.col("best_price").alias("price"), F.lit(1).alias("weight")))
    half = F.floor(F.col("total") / 2)
    at = lambda rank: F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("price")))
    places = {"__lowest": F.lit(0), "__second": F.lit(1), "__mid0": half - 1, "__mid1": half, "__mid2": half + 1}
    return steps.groupBy("product_key").agg(F.max("total").alias("__best"), *[at(rank).alias(c) for c, rank in places.items()])


def competitors(deals: DataFrame) -> DataFrame:
    """The deals with the number, median and lowest of the product's best prices above 0 at other merchants.

    No self-join: leaving one price out moves the middle by one place at most, so a row per
    product and the own merchant's best price tell the median of the others.
    """
    best = best_prices(deals).where("best_price > 0")
    own = best.select("product_key", "merchant_id", F.col("best_price").alias("__own"))
    # the join by product comes last, so that the deals lie as ``past`` joins them
    df = deals.join(own, ["product_key", "merchant_id"], "left").join(markets(best), "product_key", "left")
    mine, without = F.col("__own"), F.col("__own").isNotNull()
    # the price at a place once the own one is out: that place's if the own is higher, else the next one's
    left = lambda low, high: F.when(mine > F.col(low), F.col(low)).otherwise(F.col(high))
    even = F.col("__best") % 2 == 0
    low = F.when(without, left("__mid0", "__mid1")).when(even, F.col("__mid0")).otherwise(F.col("__mid1"))
    high = F.when(without & even, left("__mid0", "__mid1")).when(without, left("__mid1", "__mid2")).otherwise(F.col("__mid1"))
    return df.withColumns(
        {
            "rivals": (F.coalesce("__best", F.lit(0)) - without.cast("int")).cast("int"),
            "rival_median": half_up((low + high) / 2),
            "rival_low": F.when(without, left("__lowest", "__second")).otherwise(F.col("__lowest")),
        }
    ).drop("__best", "__own", "__lowest", "__second", "__mid0", "__mid1", "__mid2")


def past(deals: DataFrame, points: DataFrame) -> DataFrame:
    """The deals with the product's recorded prices above 0: number, lowest, how many below the deal's; and since."""
    whole = points.groupBy("product_key").agg(F.count_if(F.col("price") > 0).alias("points"), F.min(F.when(F.col("price") > 0, F.col("price"))).alias("prior_low"), F.min("observed_at").alias("since"))
    recorded = points.where("price > 0").groupBy("product_key", "price").agg(F.count(F.lit(1)).alias("weight"))
    asked = deals.where("price_now is not null and product_key is not null").select("product_key", F.col("price_now").alias("price")).distinct()
    steps = ladder(recorded.unionByName(asked.withColumn("weight", F.lit(0).cast("long"))))
    below = steps.select("product_key", F.col("price").alias("price_now"), "below")
    return deals.join(whole, "product_key", "left").join(below, ["product_key", "price_now"], "left")


def unrecorded(deals: DataFrame) -> DataFrame:
    """The deals as of ``past`` where no price was recorded."""
    return deals.withColumns({c: F.lit(None).cast(kind) for c, kind in (("points", "long"), ("prior_low", "long"), ("since", "timestamp_ntz"), ("below", "long"))})


def histories(points: DataFrame) -> DataFrame:
    """product_key, prices in order of time, since (the first observation); a row holds all prices of a product."""
    rows = points.groupBy("product_key").agg(F.array_sort(F.collect_list(F.struct("observed_at", "price"))).alias("h"), F.min("observed_at").alias("since"))
    return rows.select("product_key", F.transform("h", lambda x: x["price"]).alias("history"), "since")


def assess(facts: DataFrame, now: Column) -> DataFrame:
    """Adds the quality columns to deals with the facts of ``competitors`` and ``past``."""
    price, none = F.col("price_now"), F.lit(0)
    comparable = F.coalesce(F.col("product_key_strength").isin(*COMPARABLE), F.lit(False))
    rivals = F.when(comparable, F.col("rivals")).otherwise(none)
    market = F.when(rivals >= MARKET_LEAST, F.col("rival_median"))
    known = F.coalesce("points", none) >= HISTORY_LEAST
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 86_400_000_000
    priced = price.isNotNull()
    df = facts.withColumn("market_price", F.when(priced, market))
    df = df.withColumns(
        {
            "market_discount_pct": F.when(F.col("market_price") > 0, percent((F.col("market_price") - price) / F.col("market_price"))),
            "__low": F.when(priced & known, F.col("prior_low")),
            "price_rank_pct": F.when(priced & known, percent(F.col("below") / F.col("points"))),
            "__cheapest": F.when(comparable, F.col("rival_low")),
            "history_days": F.coalesce(F.greatest(F.lit(0.0), days), F.lit(0.0)),
            "claim_suspect": F.coalesce(F.col("price_was") > F.col("market_price") * ANCHOR, F.lit(False)),
            "competitors": rivals,
        }
    )
    df = df.withColumn("observed_low", F.when(F.col("__low").isNotNull(), F.least("__low", price)))
    has_market, has_low = F.col("market_price").isNotNull(), F.col("observed_low").isNotNull()
    unbeaten = F.col("__cheapest").isNull() | (price <= F.col("__cheapest") * NEAR_LOW)
    return df.withColumns(
        {
            "evidence": F.when(has_market & has_low, "strong").when(has_market | (has_low & (F.col("history_days") >= 30)), "moderate").otherwise("none"),
            "verdict": F.when(~priced, "unverified")
            .when(F.col("claim_suspect"), "inflated-anchor")
            .when(F.col("market_discount_pct") <= -5, "above-market")
            .when((price <= F.col("__low") * NEAR_LOW) & unbeaten, "verified-low")
            .when(F.col("market_discount_pct") >= 5, "verified-good")
            .when(F.col("market_discount_pct").isNotNull(), "market-price")
            .otherwise("unverified"),
        }
    ).drop("__low", "__cheapest")


def trusted_pct() -> Column:
    """The discount that stands up: none if the anchor is inflated, the market's if there is one."""
    market = F.col("market_discount_pct")
    return F.when(F.col("verdict") == "inflated-anchor", None).when(market > 0, market).otherwise(F.col("discount_pct"))


def quality_note() -> Column:
    """A sentence for each verdict."""
    dollars = lambda c: F.concat(F.lit("$"), F.replace(F.format_number(F.coalesce(c, F.lit(0)) / 100, 2), F.lit(","), F.lit("")))
    # whole percentages are written without a point
    pct = F.regexp_replace(F.col("market_discount_pct").cast("string"), r"\.0$", "")
    stores = F.concat(F.col("competitors").cast("string"), F.lit(" other "), F.when(F.col("competitors") == 1, "store").otherwise("stores"))
    market, verdict = dollars(F.col("market_price")), F.col("verdict")
    return (
        F.when(F.col("price_now").isNull(), F.lit("No price available to compare."))
        .when((verdict == "verified-low") & (F.col("history_days") >= 1), F.concat(F.lit("Lowest price we've recorded in "), half_up("history_days").cast("string"), F.lit(" days.")))
        .when(verdict == "verified-low", F.lit("Lowest price we've recorded."))
        .when(verdict == "verified-good", F.concat(pct, F.lit("% below the "), market, F.lit(" median across "), stores, F.lit(".")))
        .when(verdict == "market-price", F.concat(F.lit("In line with the "), market, F.lit(" median at "), F.col("competitors").cast("string"), F.lit(" other stores.")))
        .when(verdict == "above-market", F.concat(F.lit("Cheaper elsewhere — "), market, F.lit(" median at "), F.col("competitors").cast("string"), F.lit(" other stores.")))
        .when(verdict == "inflated-anchor", F.concat(F.lit("The "), dollars(F.col("price_was")), F.lit(' "was" price looks inflated: this sells for about '), market, F.lit(" elsewhere.")))
        .otherwise(F.lit("Not enough independent data yet — this is the retailer's own claim."))
    )


def verify(deals: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """Deals with verdicts, notes and heat, from the batch's own rivals and the price points."""
    return judge(past(competitors(deals), points), now)


def judge(facts: DataFrame, now: Column) -> DataFrame:
    """The verdicts, notes and heat of deals with the facts of ``competitors`` and ``past``."""
    out = assess(facts, now)
    score = heat(F.col("votes"), trusted_pct(), F.col("posted_at"), F.col("source"), now)
    out = out.withColumn("quality_note", quality_note()).withColumn("heat", F.when(F.col("verdict") == "inflated-anchor", F.least(F.lit(25.0), score)).otherwise(score))
    return out.drop("rivals", "rival_median", "rival_low", "points", "prior_low", "since", "below")


def summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count(F.lit(1)).alias("assessed"),
        F.count_if(F.col("verdict").isin("verified-low", "verified-good")).alias("verified"),
        F.count_if(F.col("verdict") == "inflated-anchor").alias("suspect_anchors"),
        F.count_if(F.col("market_price").isNotNull()).alias("compared"),
    )
