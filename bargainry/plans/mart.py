"""The driver's tables as merchants, deals, price points, stores, runs and usage.

Each function is a view over scans: filters and column lists reach Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import discount, half_up

NOW = "2001-12-01 00:00:00"
SPLIT = "2000-01-01"
#: Tasks that rows are dealt to, for each core.
TASKS_A_CORE = 4


def now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to all cores, some tasks for each: a file may be too small for as many splits as the work on its rows needs."""
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, of each of which a query makes a page or text that costs far more than the row."""
    return spread(table(spark, sf_dir, "part"))


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier; nations and regions are the fixed 25 and 5 rows."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").cast("string").alias("id"),
            F.col("s_name").alias("slug"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("family"),
            F.col("r_name").alias("vertical"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.element_at(F.array(*map(F.lit, ("gtin", "asin", "mpn", "model"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("product_key"),
        strength.alias("product_key_strength"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    unit = F.col("l_extendedprice") / F.col("l_quantity") * 100
    was, cents = half_up(unit), half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity") * 100)
    seen = now() - hours((F.col("l_partkey") + F.col("l_suppkey")) % 120)
    return line.select(
        key.alias("id"),
        F.lit("lineitem").alias("source"),
        key.alias("source_id"),
        F.col("l_suppkey").cast("string").alias("merchant_id"),
        F.col("l_partkey").cast("string").alias("product_key"),
        cents.cast("long").alias("price_now"),
        was.cast("long").alias("price_was"),
        discount(cents, was)["pct"].alias("discount_pct"),
        (now() - hours(F.col("l_orderkey") % 96)).alias("posted_at"),
        seen.alias("first_seen_at"),
        seen.alias("last_seen_at"),
        F.when(F.col("l_linenumber") % 3 != 0, now() + hours(F.col("l_orderkey") % 200 - 40)).alias("expires_at"),
        F.when(F.col("l_linestatus") == "F", F.lit("expired")).otherwise(F.lit("active")).alias("status"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("TAX"), half_up(F.col("l_tax") * 100).cast("string"))).alias("coupon_code"),
        F.col("l_linenumber").cast("long").alias("votes"),
        F.col("l_shipdate").alias("observed_at"),
        (F.col("l_orderkey") % 50 == 0).alias("unpriced"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest offer of each product and merchant since SPLIT, with the product's fields."""
    recent = offers(spark, sf_dir).where(F.col("observed_at") >= F.lit(SPLIT).cast("timestamp_ntz"))
    newest = Window.partitionBy("product_key", "merchant_id").orderBy(F.desc("observed_at"), F.desc("id"))
    # by product, as the join with the products needs them: the window does with that
    latest = recent.repartition("product_key").withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")
    return latest.join(products(spark, sf_dir), "product_key")


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = offers(spark, sf_dir).where(F.col("observed_at") < F.lit(SPLIT).cast("timestamp_ntz"))
    return old.select("id", "product_key", "merchant_id", F.col("price_now").alias("price"), "observed_at")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.col("c_mktsegment").alias("chain"),
        F.col("c_name").alias("name"),
        (41 + key % 4300 / 100.0).alias("lat"),
        (-142 + key % 9000 / 100.0).alias("lng"),
    )


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("started_at"),
        F.when(F.col("value") < 400, F.lit("ok")).otherwise(F.lit("failed")).alias("outcome"),
        F.floor("value").alias("items_found"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("role").alias("model"),
        size.alias("input_tokens"),
        F.expr("turn * 3").cast("long").alias("output_tokens"),
        (size * 2).alias("cache_read_tokens"),
        F.col("turn").cast("long").alias("tool_calls"),
    )


# The same views for DuckDB.
SQL = {
    "merchants": """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS slug, s_name AS name, n_name AS family, r_name AS vertical
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "products": """SELECT CAST(p_partkey AS VARCHAR) AS product_key,
        CASE p_partkey % 4 WHEN 0 THEN 'gtin' WHEN 1 THEN 'asin' WHEN 2 THEN 'mpn' ELSE 'model' END AS product_key_strength,
        p_name AS title, p_brand AS brand, p_type AS category FROM part""",
    "offers": f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, 'lineitem' AS source,
        CAST(l_suppkey AS VARCHAR) AS merchant_id, CAST(l_partkey AS VARCHAR) AS product_key, price_now, price_was,
        CASE WHEN price_was > price_now AND price_was > 0 AND price_now >= 0 AND (price_was - price_now) / price_was * 100 < 99.5
             THEN floor((price_was - price_now) / price_was * 100 * 10 + 0.5) / 10 END AS discount_pct,
        TIMESTAMP '{NOW}' - to_hours(l_orderkey % 96) AS posted_at,
        TIMESTAMP '{NOW}' - to_hours((l_partkey + l_suppkey) % 120) AS first_seen_at,
        TIMESTAMP '{NOW}' - to_hours((l_partkey + l_suppkey) % 120) AS last_seen_at,
        CASE WHEN l_linenumber % 3 <> 0 THEN TIMESTAMP '{NOW}' + to_hours(l_orderkey % 200 - 40) END AS expires_at,
        CASE WHEN l_linestatus = 'F' THEN 'expired' ELSE 'active' END AS status, l_returnflag <> 'R' AS in_stock,
        CASE WHEN l_tax > 0 THEN 'TAX' || CAST(CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS coupon_code,
        CAST(l_linenumber AS BIGINT) AS votes, l_shipdate AS observed_at, l_orderkey % 50 = 0 AS unpriced
        FROM (SELECT *, CAST(floor(l_extendedprice * (1 - l_discount) / l_quantity * 100 + 0.5) AS BIGINT) AS price_now,
                     CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_was FROM lineitem)""",
    "deals": f"""SELECT o.*, p.product_key_strength, p.title, p.brand, p.category FROM (
            SELECT *, row_number() OVER (PARTITION BY product_key, merchant_id ORDER BY observed_at DESC, id DESC) AS rn
            FROM offers WHERE observed_at >= TIMESTAMP '{SPLIT}') o JOIN products p USING (product_key) WHERE rn = 1""",
    "price_points": f"SELECT id, product_key, merchant_id, price_now AS price, observed_at FROM offers WHERE observed_at < TIMESTAMP '{SPLIT}'",
    "stores": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS chain, c_name AS name,
        41 + c_custkey % 4300 / 100.0::DOUBLE AS lat, -142 + c_custkey % 9000 / 100.0::DOUBLE AS lng FROM customer""",
    "source_runs": """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source, ts AS started_at,
        CASE WHEN value < 400 THEN 'ok' ELSE 'failed' END AS outcome, CAST(floor(value) AS BIGINT) AS items_found FROM events""",
    "usage": """SELECT CAST(conv_id AS VARCHAR) AS conversation_id, role AS model, length(coalesce(text, '')) AS input_tokens,
        turn * 3 AS output_tokens, length(coalesce(text, '')) * 2 AS cache_read_tokens, turn AS tool_calls FROM conversations""",
}

_HEAT = f"""greatest(0, least(100, floor(((30 * CASE WHEN votes <= 0 THEN 0 ELSE least(1, ln(1 + votes) / ln(201.0)) END
    + 35 * CASE WHEN {{pct}} IS NULL OR {{pct}} <= 0 THEN 0 ELSE least(1, {{pct}} / 70) END
    + 25 * CASE WHEN posted_at IS NULL THEN 0.3 WHEN posted_at > TIMESTAMP '{NOW}' THEN 1
           ELSE pow(0.5, date_diff('second', posted_at, TIMESTAMP '{NOW}') / 3600.0::DOUBLE / 12) END
    + 10 * 0.4) / 100.0::DOUBLE * 100) * 10 + 0.5) / 10))"""

SQL["verified"] = f"""
    WITH best AS (SELECT product_key, merchant_id, min(price_now) AS price FROM deals WHERE price_now IS NOT NULL AND merchant_id IS NOT NULL GROUP BY ALL),
    market AS (SELECT d.id, CAST(count(*) AS INTEGER) AS n, min(b.price) AS cheapest,
                      CASE WHEN count(*) >= 2 THEN CAST(floor(median(b.price) + 0.5) AS BIGINT) END AS market_price
               FROM deals d JOIN best b ON b.product_key = d.product_key AND b.merchant_id IS DISTINCT FROM d.merchant_id
               WHERE b.price > 0 AND d.product_key_strength IN ('gtin', 'asin', 'mpn') GROUP BY d.id),
    past AS (SELECT d.id, count(*) FILTER (price > 0) AS points, min(price) FILTER (price > 0) AS low,
                    count(*) FILTER (price > 0 AND price < price_now) AS below, min(h.observed_at) AS since
             FROM deals d JOIN price_points h USING (product_key) GROUP BY d.id),
    facts AS (SELECT d.*, coalesce(m.n, 0) AS competitors, m.cheapest, m.market_price,
                     CASE WHEN m.market_price > 0 THEN floor((m.market_price - price_now) / m.market_price * 1000 + 0.5) / 10 END AS market_discount_pct,
                     CASE WHEN points >= 3 THEN low END AS prior_low,
                     CASE WHEN points >= 3 THEN floor(below / points * 1000 + 0.5) / 10 END AS price_rank_pct,
                     coalesce(greatest(0, date_diff('second', since, TIMESTAMP '{NOW}') / 86400.0::DOUBLE), 0) AS history_days
              FROM deals d LEFT JOIN market m USING (id) LEFT JOIN past USING (id)),
    judged AS (SELECT *, least(prior_low, price_now) AS low_now,
                      coalesce(price_was > market_price * 1.25, false) AS claim_suspect FROM facts),
    named AS (SELECT *, CASE WHEN prior_low IS NOT NULL THEN low_now END AS observed_low,
        CASE WHEN price_now IS NULL THEN 'unverified' WHEN claim_suspect THEN 'inflated-anchor' WHEN market_discount_pct <= -5 THEN 'above-market'
             WHEN price_now <= prior_low * 1.02 AND (cheapest IS NULL OR price_now <= cheapest * 1.02) THEN 'verified-low'
             WHEN market_discount_pct >= 5 THEN 'verified-good' WHEN market_discount_pct IS NOT NULL THEN 'market-price' ELSE 'unverified' END AS verdict,
        CASE WHEN market_price IS NOT NULL AND prior_low IS NOT NULL THEN 'strong'
             WHEN market_price IS NOT NULL OR (prior_low IS NOT NULL AND history_days >= 30) THEN 'moderate' ELSE 'none' END AS evidence FROM judged),
    trusted AS (SELECT *, CASE WHEN verdict = 'inflated-anchor' THEN NULL WHEN market_discount_pct > 0 THEN market_discount_pct ELSE discount_pct END AS trusted_pct FROM named)
    SELECT *, CASE WHEN verdict = 'inflated-anchor' THEN least(25, {_HEAT.format(pct="trusted_pct")}) ELSE {_HEAT.format(pct="trusted_pct")} END AS heat FROM trusted"""

#: Views that a view needs, before it.
NEEDS = {"deals": ("offers", "products"), "price_points": ("offers",), "verified": ("offers", "products", "deals", "price_points")}


def oracle(sql: str, *views: str) -> str:
    """A query over the named views."""
    names: list[str] = []
    for view in views:
        names += [n for n in (*NEEDS.get(view, ()), view) if n not in names]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + sql if names else sql
