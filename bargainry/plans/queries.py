"""The engine's queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars, text
from ..operators import dealquery as dq
from ..operators import evaluate, history, mutations, verify
from ..operators.dealquery import DealQuery
from ..operators.dedupe import saved
from ..streaming import ingest
from . import mart
from .mart import oracle

NOW = datetime.fromisoformat(mart.NOW)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def verified(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """The deals with verdicts, or those of the products that the deals ``of`` are of.

    Rivals, histories and the deals themselves read the deals, so they are written once.
    """
    deals, points = mart.deals(spark, sf_dir), mart.price_points(spark, sf_dir)
    if of is not None:  # a verdict depends on the deals and prices of its product
        asked = saved(of.select("product_key").distinct())
        deals, points = (df.join(asked, "product_key", "left_semi") for df in (deals, points))
    return verify.verify(saved(deals), points, mart.now())


def related(spark: SparkSession, sf_dir: str, deals: DataFrame | None = None) -> DataFrame:
    return dq.with_relations(mart.deals(spark, sf_dir) if deals is None else deals, mart.merchants(spark, sf_dir))


# Listings ---------------------------------------------------------------------------------

_SHOWN = "id, title, price_now, discount_pct, market_discount_pct, verdict, heat, merchant_name"
_FRESH = f"status = 'active' AND last_seen_at >= TIMESTAMP '{mart.NOW}' - INTERVAL 3 DAY"
_RELATED = "(SELECT d.*, m.slug AS merchant_slug, m.name AS merchant_name, m.family, m.vertical FROM {} d LEFT JOIN merchants m ON d.merchant_id = m.id)"
_WEIGHT = "CASE verdict WHEN 'verified-low' THEN 3 WHEN 'verified-good' THEN 2 WHEN 'market-price' THEN 1 ELSE 0 END DESC, coalesce(market_discount_pct, 0) DESC"
_SORTS = {
    "q01_listing_hottest": ("hottest", "heat DESC"),
    "q02_listing_newest": ("newest", "coalesce(posted_at, first_seen_at) DESC"),
    "q03_biggest_drop": ("biggest-drop", "coalesce(market_discount_pct, discount_pct, -1) DESC"),
    "q04_best_verified": ("best-verified", _WEIGHT),
    "q05_price_asc": ("price-asc", "coalesce(price_now, 999999999)"),
    "q06_price_desc": ("price-desc", "coalesce(price_now, -1) DESC"),
    "q07_expiring": ("expiring", "coalesce(expires_at, TIMESTAMP '9999-12-31')"),
}


def _listing(name: str, sort: str, order: str, offset: int = 0) -> None:
    sql = oracle(f"SELECT {_SHOWN} FROM {_RELATED.format('verified')} WHERE {_FRESH} ORDER BY {order}, id LIMIT 48 OFFSET {offset}", "merchants", "verified")

    @query(name, sql)
    def run(spark, sf_dir):
        rows = related(spark, sf_dir, verified(spark, sf_dir))
        return dq.listing(rows, DealQuery(sort=sort, offset=offset), NOW).select(*_SHOWN.split(", "))


for _name, (_sort, _order) in _SORTS.items():
    _listing(_name, _sort, _order)
_listing("q16_page_2", "hottest", "heat DESC", 48)

# Filters ----------------------------------------------------------------------------------

_FILTERS = {
    "q08_filter_price_floor": (DealQuery(min_price=150_000), "price_now >= 150000", True),
    "q09_filter_price_ceiling_null_passes": (DealQuery(max_price=100_000), "(price_now IS NULL OR price_now <= 100000)", True),
    "q10_filter_brand_ci": (DealQuery(brands=("BRAND#13", "brand#21")), "lower(brand) IN ('brand#13', 'brand#21')", False),
    "q11_filter_coupon": (DealQuery(coupon_only=True), "coupon_code IS NOT NULL AND coupon_code <> ''", False),
    "q12_filter_stock": (DealQuery(in_stock_only=True), "in_stock", False),
    "q13_filter_family": (DealQuery(families=("NATION_3", "CANADA", "FRANCE")), "family IN ('NATION_3', 'CANADA', 'FRANCE')", False),
    "q14_filter_fresh": (DealQuery(fresh_days=1), f"last_seen_at >= TIMESTAMP '{mart.NOW}' - INTERVAL 1 DAY", False),
    "q14b_filter_status_any_age": (DealQuery(statuses=("expired",), fresh_days=0), "status = 'expired'", False),
    "q14c_filter_min_discount": (DealQuery(min_discount_pct=5.0), "discount_pct >= 5", False),
    "q15_search_word_start": (DealQuery(search="Brand#1"), "(contains(' ' || lower(title), ' brand#1') OR contains(' ' || lower(merchant_name), ' brand#1') OR contains(' ' || lower(brand), ' brand#1'))", False),
}


def _filter(name: str, q: DealQuery, condition: str, unpriced: bool) -> None:
    base = "(SELECT * REPLACE (CASE WHEN unpriced THEN NULL ELSE price_now END AS price_now) FROM deals)" if unpriced else "deals"
    fresh = _FRESH if q.fresh_days is None and q.statuses == ("active",) else "status = 'active'" if q.statuses == ("active",) else "true"

    @query(name, oracle(f"SELECT id, brand, price_now, coupon_code, merchant_slug FROM {_RELATED.format(base)} WHERE {fresh} AND {condition}", "merchants", "deals"))
    def run(spark, sf_dir):
        deals = mart.deals(spark, sf_dir)
        if unpriced:
            deals = deals.withColumn("price_now", F.when(~F.col("unpriced"), F.col("price_now")))
        return dq.matching(related(spark, sf_dir, deals), q, NOW).select("id", "brand", "price_now", "coupon_code", "merchant_slug")


for _name, _parts in _FILTERS.items():
    _filter(_name, *_parts)

# Counts and facets ------------------------------------------------------------------------


@query("q17_count", oracle(f"SELECT count(*) AS total FROM deals WHERE {_FRESH}", "deals"))
def _count(spark, sf_dir):
    return dq.count(related(spark, sf_dir), DealQuery(), NOW)


for _name, _field, _value, _label in (
    ("q18_facet_category", "category", "category", "category"),
    ("q19_facet_brand", "brand", "brand", "brand"),
    ("q20_facet_merchant", "merchant", "merchant_slug", "merchant_name"),
    ("q20b_facet_family", "family", "family", "family"),
):
    query(
        _name,
        oracle(f"SELECT {_value} AS value, {_label} AS label, count(*) AS count FROM {_RELATED.format('deals')} WHERE {_FRESH} AND {_value} <> '' GROUP BY ALL", "merchants", "deals"),
    )(lambda spark, sf_dir, field=_field: dq.facet(related(spark, sf_dir), field, NOW))


@query(
    "q21_facets_grouping_sets",
    oracle(
        f"""SELECT CASE WHEN GROUPING(category) = 0 THEN 'category' WHEN GROUPING(brand) = 0 THEN 'brand' ELSE 'family' END AS facet,
            coalesce(category, brand, family) AS value, count(*) AS count FROM {_RELATED.format('deals')} WHERE {_FRESH}
            GROUP BY GROUPING SETS ((category), (brand), (family))""",
        "merchants", "deals",
    ),
)
def _facets(spark, sf_dir):
    return dq.facets(related(spark, sf_dir), ("category", "brand", "family"), NOW)


# Runs and usage ---------------------------------------------------------------------------


@query(
    "q22_latest_run_rank",
    oracle("SELECT id, source, started_at, outcome, items_found FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY started_at DESC) AS r FROM source_runs) WHERE r = 1", "source_runs"),
)
def _health(spark, sf_dir):
    return history.source_health(mart.source_runs(spark, sf_dir))


@query(
    "q23_staleness",
    oracle("SELECT max(CASE WHEN outcome = 'ok' THEN started_at END) AS last_success, max(CASE WHEN outcome = 'ok' THEN started_at END) < TIMESTAMP '2024-01-30 12:00:00' AS stale FROM source_runs", "source_runs"),
)
def _stale(spark, sf_dir):
    return history.staleness(mart.source_runs(spark, sf_dir), datetime(2024, 1, 30, 18), timedelta(hours=6))


_USAGE = """count(DISTINCT conversation_id) AS conversations, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CASE WHEN sum(cache_read_tokens) + sum(input_tokens) > 0 THEN sum(cache_read_tokens) / (sum(cache_read_tokens) + sum(input_tokens)) ELSE 0 END AS cache_hit_ratio"""


@query("q24_usage_by_model", oracle(f"SELECT model, {_USAGE} FROM usage GROUP BY model", "usage"))
def _usage_by_model(spark, sf_dir):
    return history.usage_summary(mart.usage(spark, sf_dir), "model")


@query("q25_cache_ratio", oracle(f"SELECT {_USAGE} FROM usage", "usage"))
def _usage(spark, sf_dir):
    return history.usage_summary(mart.usage(spark, sf_dir))


# Places -----------------------------------------------------------------------------------

_AT = (51.0, -132.0, 300.0)
_SHOP = (41.5, -141.5, 60.0)


def _km(lat: float, lng: float) -> str:
    return f"2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lng - ({lng})) / 2), 2))))"


@query("q26_stores_near", oracle(f"SELECT id, name, floor({_km(*_AT[:2])} * 1000 + 0.5) / 1000 AS km FROM stores WHERE {_km(*_AT[:2])} <= {_AT[2]}", "stores"))
def _stores_near(spark, sf_dir):
    return dq.stores_near(mart.stores(spark, sf_dir), *_AT).select("id", "name", scalars.half_up("distance_km", 3).alias("km"))


@query(
    "q27_deals_near",
    oracle(
        f"""SELECT d.id, s.id AS store, d.heat, floor(km * 1000 + 0.5) / 1000 AS km FROM (SELECT * FROM verified WHERE {_FRESH}) d
            JOIN (SELECT id, {_km(*_SHOP[:2])} AS km FROM stores) s ON s.id = d.merchant_id WHERE km <= {_SHOP[2]} ORDER BY d.heat - 1.5 * km DESC, km, d.id LIMIT 48""",
        "verified", "stores",
    ),
)
def _deals_near(spark, sf_dir):
    places = mart.stores(spark, sf_dir).select(F.col("id").alias("store"), "lat", "lng")
    near = dq.within(places, *_SHOP).select(F.col("store").alias("merchant_id"))
    deals = verified(spark, sf_dir, mart.deals(spark, sf_dir).join(near, "merchant_id", "left_semi")).join(places, F.col("merchant_id") == F.col("store"))
    return dq.deals_near(deals, DealQuery(near=_SHOP), NOW).select("id", "store", "heat", scalars.half_up("distance_km", 3).alias("km"))


# Series -----------------------------------------------------------------------------------


@query("q28_price_history", oracle("SELECT id, product_key, merchant_id, price, observed_at FROM price_points WHERE product_key IN (SELECT product_key FROM deals)", "price_points", "deals"))
def _history(spark, sf_dir):
    return history.price_history(mart.price_points(spark, sf_dir), mart.deals(spark, sf_dir))


@query(
    "q29_history_by_product",
    oracle("SELECT product_key, count(*) AS points, string_agg(CAST(price AS VARCHAR), ',' ORDER BY observed_at, price) AS prices FROM price_points GROUP BY product_key", "price_points"),
)
def _by_product(spark, sf_dir):
    rows = verify.histories(mart.price_points(spark, sf_dir))
    return rows.select("product_key", F.size("history").cast("long").alias("points"), F.array_join(F.col("history").cast("array<string>"), ",").alias("prices"))


_SERIES = "product_key || '/' || merchant_id"


def _series(spark, sf_dir):
    return mart.price_points(spark, sf_dir).select("id", F.concat_ws("/", "product_key", "merchant_id").alias("deal_id"), "price", "observed_at")


@query(
    "q30_change_only_append",
    oracle(f"SELECT id, deal_id, price FROM (SELECT id, {_SERIES} AS deal_id, price, lag(price) OVER (PARTITION BY product_key, merchant_id ORDER BY observed_at, id) AS p FROM price_points) WHERE price IS DISTINCT FROM p", "price_points"),
)
def _change_only(spark, sf_dir):
    return history.change_only(_series(spark, sf_dir)).select("id", "deal_id", "price")


@query(
    "q31_prune_keep_latest",
    oracle(f"SELECT id, deal_id FROM (SELECT id, {_SERIES} AS deal_id, observed_at, row_number() OVER (PARTITION BY product_key, merchant_id ORDER BY observed_at DESC, id DESC) AS r FROM price_points) WHERE observed_at >= TIMESTAMP '1999-06-01' OR r = 1", "price_points"),
)
def _prune(spark, sf_dir):
    return history.prune(_series(spark, sf_dir), F.lit("1999-06-01").cast("timestamp_ntz")).select("id", "deal_id")


@query(
    "q32_expire_retire",
    oracle(
        f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN status <> 'active' THEN status WHEN expires_at < TIMESTAMP '{mart.NOW}' THEN 'expired'
            WHEN last_seen_at < TIMESTAMP '{mart.NOW}' - INTERVAL 72 HOUR THEN 'dead' ELSE status END AS status FROM deals) GROUP BY status""",
        "deals",
    ),
)
def _reap(spark, sf_dir):
    deals, _ = mutations.reap(mart.deals(spark, sf_dir), _series(spark, sf_dir), mart.now())
    return deals.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_YEARS = """old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_key, merchant_id ORDER BY observed_at DESC, id DESC) AS r FROM offers WHERE observed_at < TIMESTAMP '2000-01-01') WHERE r = 1),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_key, merchant_id ORDER BY observed_at DESC, id DESC) AS r FROM offers WHERE observed_at >= TIMESTAMP '2000-01-01') WHERE r = 1)"""


def _listings(spark, sf_dir, condition: str) -> DataFrame:
    rows = mart.offers(spark, sf_dir).where(condition).withColumn("source_id", F.concat_ws("/", "product_key", "merchant_id"))
    rows = rows.withColumn("at", F.struct("observed_at", "id"))
    return mutations.last_of_each(rows, ["source", "source_id"], "at").select("id", "source", "source_id", "price_now", "first_seen_at", "last_seen_at")


def _upserted(spark, sf_dir):
    old = _listings(spark, sf_dir, "observed_at < timestamp_ntz'2000-01-01'")
    new = _listings(spark, sf_dir, "observed_at >= timestamp_ntz'2000-01-01'")
    return mutations.upsert_deals(old, new, mart.now())


@query(
    "q33_upsert_priced_changes",
    oracle("SELECT coalesce(o.id, n.id) AS id, n.price_now AS price FROM new n LEFT JOIN old o USING (product_key, merchant_id) WHERE n.price_now IS NOT NULL AND (o.id IS NULL OR coalesce(o.price_now, 0) <> n.price_now)", "offers").replace("\nSELECT coalesce(o.id", ",\n" + _YEARS + "\nSELECT coalesce(o.id"),
)
def _priced_changes(spark, sf_dir):
    return _upserted(spark, sf_dir)[1]


@query(
    "q33b_upsert_deals",
    oracle(f"SELECT coalesce(o.id, n.id) AS id, coalesce(n.price_now, o.price_now) AS price_now, CASE WHEN n.id IS NULL THEN o.last_seen_at ELSE TIMESTAMP '{mart.NOW}' END AS last_seen_at, coalesce(o.first_seen_at, n.first_seen_at) AS first_seen_at FROM new n FULL JOIN old o USING (product_key, merchant_id)", "offers").replace("\nSELECT coalesce(o.id", ",\n" + _YEARS + "\nSELECT coalesce(o.id"),
)
def _upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)[0].select("id", "price_now", "last_seen_at", "first_seen_at")


# Verification -----------------------------------------------------------------------------


@query("q34_best_price_per_merchant", oracle("SELECT product_key, merchant_id, min(price_now) AS best_price FROM deals GROUP BY ALL", "deals"))
def _best(spark, sf_dir):
    return verify.best_prices(mart.deals(spark, sf_dir))


_QUALITY = {
    "q35_market_median_excluding_self": "id, competitors, market_price, market_discount_pct",
    "q36_price_rank": "id, observed_low, price_rank_pct",
    "q37_verdicts": "id, verdict, evidence, claim_suspect",
    "q39_heat": "id, heat",
}
for _name, _columns in _QUALITY.items():
    query(_name, oracle(f"SELECT {_columns} FROM verified", "verified"))(lambda spark, sf_dir, columns=_columns: verified(spark, sf_dir).select(*columns.split(", ")))


@query(
    "q38_verdict_summary",
    oracle("SELECT count(*) AS assessed, count(*) FILTER (verdict IN ('verified-low', 'verified-good')) AS verified, count(*) FILTER (verdict = 'inflated-anchor') AS suspect_anchors, count(market_price) AS compared FROM verified", "verified"),
)
def _summary(spark, sf_dir):
    return verify.summary(verified(spark, sf_dir))


# Scalars ----------------------------------------------------------------------------------


@query("q40_discount", oracle("SELECT id, discount_pct, CASE WHEN discount_pct IS NOT NULL THEN price_was - price_now END AS discount_abs FROM offers", "offers"))
def _discount(spark, sf_dir):
    d = scalars.discount("price_now", "price_was")
    return mart.offers(spark, sf_dir).select("id", d["pct"].alias("discount_pct"), d["abs"].alias("discount_abs"))


@query("q41_cents_from_text", "SELECT DISTINCT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem")
def _cents(spark, sf_dir):
    rows = mart.table(spark, sf_dir, "lineitem")
    english = F.concat(F.lit("CAD $"), F.format_number("l_extendedprice", 2))
    french = F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", " ,"), F.lit(" $"))
    written = F.when(F.col("l_linenumber") % 2 == 0, english).otherwise(french)
    return rows.select("l_orderkey", "l_linenumber", scalars.price_to_cents(written).alias("cents")).distinct()


@query(
    "q43_registrable_domain",
    """WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages)
       SELECT page_id, CASE WHEN len(string_split(host, '.')) <= 2 THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM h""",
)
def _domain(spark, sf_dir):
    return mart.table(spark, sf_dir, "pages").select("page_id", text.registrable_domain("url").alias("domain"))


@query("q48_title_tokens", "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]{1,2}') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in text.NOISE) + "], w))), ' ') AS tokens FROM part")
def _tokens(spark, sf_dir):
    return mart.parts(spark, sf_dir).select("p_partkey", F.array_join(text.title_tokens("p_name"), " ").alias("tokens"))


@query("q51_gtin_check", """SELECT p_partkey, (10 - CAST(list_sum(list_transform(range(1, 13), lambda i: CAST(substr(reverse(lpad(CAST(p_partkey AS VARCHAR), 12, '7')), i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) AS INTEGER) % 10) % 10 = p_partkey % 10 AS valid FROM part""")
def _gtin(spark, sf_dir):
    key = F.col("p_partkey")
    code = F.concat(F.lpad(key.cast("string"), 12, "7"), (key % 10).cast("string"))
    return mart.parts(spark, sf_dir).select("p_partkey", scalars.gtin_valid(code).alias("valid"))


@query("q53_model_token", "SELECT p_partkey, 'QN' || p_size || 'X' || p_partkey AS model FROM part WHERE length('QN' || p_size || 'X' || p_partkey) BETWEEN 4 AND 24")
def _model(spark, sf_dir):
    title = F.concat(F.lit("Great 256GB set, (QN"), F.col("p_size").cast("string"), F.lit("X"), F.col("p_partkey").cast("string"), F.lit(") 4K"))
    return mart.parts(spark, sf_dir).select("p_partkey", scalars.model_token(title).alias("model"))


# Composition ------------------------------------------------------------------------------


@query(
    "q59_composite_first_wins",
    """SELECT l_orderkey, l_linenumber, min(path) AS path FROM (SELECT l_orderkey, l_linenumber, 1 AS path FROM lineitem WHERE l_quantity > 30
       UNION ALL SELECT l_orderkey, l_linenumber, 2 FROM lineitem WHERE l_quantity > 10) GROUP BY ALL""",
)
def _first_wins(spark, sf_dir):
    from ..operators.sets import first_wins

    rows = mart.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    paths = [rows.where("l_quantity > 30"), rows.where("l_quantity > 10")]
    return first_wins(paths, ["l_orderkey", "l_linenumber"], "path").select("l_orderkey", "l_linenumber", "path")


@query(
    "q64_coupons_by_merchant",
    oracle(
        f"""SELECT id, merchant_id, coupon_code, count(*) OVER (PARTITION BY merchant_id) AS group_size FROM (SELECT * FROM deals
            WHERE {_FRESH} AND coupon_code <> '' ORDER BY coalesce(expires_at, TIMESTAMP '9999-12-31'), id LIMIT 100)""",
        "deals",
    ),
)
def _coupons(spark, sf_dir):
    q = DealQuery(coupon_only=True, sort="expiring", limit=100)
    rows = dq.listing(related(spark, sf_dir), q, NOW)
    return rows.select("id", "merchant_id", "coupon_code", F.count(F.lit(1)).over(Window.partitionBy("merchant_id")).alias("group_size"))


@query("q65_directory", oracle("SELECT vertical, count(*) AS merchants, string_agg(name, ',' ORDER BY name) AS names FROM merchants GROUP BY vertical", "merchants"))
def _directory(spark, sf_dir):
    rows = mart.merchants(spark, sf_dir).groupBy("vertical").agg(F.count(F.lit(1)).alias("merchants"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return rows.orderBy(F.desc("merchants"), "vertical")


@query(
    "q66_chart_stats",
    oracle(f"SELECT {_SERIES} AS deal_id, min(price) AS low, max(price) AS high, arg_max(price, struct_pack(a := observed_at, b := id)) AS last_price, min(observed_at) FILTER (price = lowest) AS low_at, count(*) AS points, min(price) = max(price) AS flat FROM (SELECT *, min(price) OVER (PARTITION BY product_key, merchant_id) AS lowest FROM price_points) GROUP BY product_key, merchant_id", "price_points"),
)
def _chart(spark, sf_dir):
    return history.chart(_series(spark, sf_dir), "deal_id")


# Evaluation, scans of JSON and HTML, windows ------------------------------------------------


@query(
    "q60_recall_at_6",
    """WITH f AS (SELECT user_id AS case_id, event_id % 20 AS deal_id, min(event_id) AS pos FROM events GROUP BY ALL),
       r AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY pos) AS place FROM f)
       SELECT case_id, CAST(min(place) FILTER (deal_id = case_id % 20) AS BIGINT) AS rank FROM r GROUP BY case_id""",
)
def _recall(spark, sf_dir):
    events = mart.table(spark, sf_dir, "events")
    surfaced = events.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 20).alias("deal_id"))
    return evaluate.first_hits(surfaced, events.select(F.col("user_id").alias("case_id"), (F.col("user_id") % 20).alias("deal_id")))


@query("q61_json_scan", "SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def _json(spark, sf_dir):
    props = F.from_json("props", "k bigint")
    return mart.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(props["k"]).alias("total"))


@query("q67_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def _windows(spark, sf_dir):
    out = ingest.event_windows(mart.table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")
