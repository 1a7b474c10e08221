"""Queries on merged listings, lookups, parameters, tools, places and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..operators import dealquery as dq
from ..operators import dedupe, history, mutations, present, runlog
from ..operators.dealquery import DealQuery
from ..schemas import USAGE
from ..sources import payloads
from . import mart
from .mart import oracle
from .more import _payloads, _size
from .pages import _kept, _shown
from .pages import _SHOWN as _SHOWN_SQL
from .queries import _FRESH, _RELATED, NOW, _km, query, related

# Merging ------------------------------------------------------------------------------------

_TEXTS = "CASE votes WHEN 1 THEN NULL WHEN 2 THEN 'short' WHEN 3 THEN 'another text' WHEN 4 THEN 'one more text' ELSE 'of a length' END"
_LISTED = f"""(SELECT id, product_key AS cluster, 's' || votes % 3 AS source, CASE WHEN votes % 5 = 0 THEN ['s0', 'x'] WHEN votes % 5 = 1 THEN []::VARCHAR[] END AS also_seen_on, CASE WHEN votes <> 7 THEN posted_at END AS posted_at,
    {_TEXTS} AS description, CASE WHEN votes % 4 = 0 THEN 'i' || id END AS image_url, CASE WHEN NOT unpriced THEN price_now END AS price_now, CASE WHEN discount_pct > 4 THEN price_was END AS price_was, coupon_code, CASE WHEN votes <> 6 THEN votes END AS votes,
    CASE WHEN NOT unpriced AND discount_pct > 4 THEN 0 ELSE 1 END AS complete FROM offers)"""
_RANK = "row(complete, coalesce(posted_at, TIMESTAMP '9999-12-31'), id)"


@query(
    "q50b_merged_rows",
    oracle(
        f"""SELECT cluster, arg_min(id, {_RANK}) AS id, arg_min(source, {_RANK}) AS source, min(posted_at) AS posted_at, arg_min(description, row(-length(description), id)) FILTER (description IS NOT NULL) AS description,
            {', '.join(f'arg_min({c}, {_RANK}) FILTER ({c} IS NOT NULL) AS {c}' for c in ('image_url', 'price_now', 'price_was', 'coupon_code'))}, CAST(sum(votes) AS BIGINT) AS votes,
            array_to_string(list_sort(list_distinct(flatten(list([source] || coalesce(also_seen_on, []))))), ',') AS also_seen_on, count(*) AS merged_rows FROM {_LISTED} GROUP BY cluster""",
        "offers",
    ),
)
def _merged(spark, sf_dir):
    """The offers of a product as one: every field that a merge decides."""
    v = F.col("votes")
    rows = mart.offers(spark, sf_dir).select(
        "id", F.col("product_key").alias("cluster"), F.concat(F.lit("s"), (v % 3).cast("string")).alias("source"), F.when(v % 5 == 0, F.array(F.lit("s0"), F.lit("x"))).when(v % 5 == 1, F.array().cast("array<string>")).alias("also_seen_on"),
        F.when(v != 7, F.col("posted_at")).alias("posted_at"), F.when(v == 1, None).when(v == 2, "short").when(v == 3, "another text").when(v == 4, "one more text").otherwise("of a length").alias("description"),
        F.when(v % 4 == 0, F.concat(F.lit("i"), "id")).alias("image_url"), F.when(~F.col("unpriced"), F.col("price_now")).alias("price_now"), F.when(F.col("discount_pct") > 4, F.col("price_was")).alias("price_was"), "coupon_code", F.when(v != 6, v).alias("votes"),
    )
    clusters = rows.select("id", "cluster")
    merged = dedupe.merge(rows).join(clusters, "id")
    return merged.withColumn("also_seen_on", F.array_join("also_seen_on", ","))


@query(
    "q33c_revival",
    oracle("SELECT id, CASE WHEN price_now % 3 = 0 THEN 'active' WHEN price_now % 3 = 1 THEN 'dead' ELSE 'expired' END AS status, price_now % 3 = 0 OR last_seen_at = TIMESTAMP '2001-12-01' AS seen_now FROM deals", "deals"),
)
def _revival(spark, sf_dir):
    """Dead and expired deals of which a third is listed again."""
    old = mart.deals(spark, sf_dir).withColumn("status", F.when(F.col("price_now") % 3 == 1, "dead").otherwise("expired"))
    found = old.where("price_now % 3 = 0").withColumn("status", F.lit("active"))
    after, _ = mutations.upsert_deals(old, found, mart.now())
    return after.select("id", "status", (F.col("last_seen_at") == mart.now()).alias("seen_now"))


# Lookups, orders and relations --------------------------------------------------------------


@query(
    "q13b_relations_of_stores",
    oracle(
        f"""SELECT d.id, m.slug AS merchant_slug, s.name AS store_name, s.chain, s.lat FROM (SELECT *, CASE WHEN votes <> 7 THEN CAST(CAST(merchant_id AS BIGINT) * 20 AS VARCHAR) END AS store_id FROM deals) d
            LEFT JOIN merchants m ON d.merchant_id = m.id LEFT JOIN stores s ON d.store_id = s.id""",
        "deals", "merchants", "stores",
    ),
)
def _relations(spark, sf_dir):
    """Some deals have no store, some one that is not known."""
    deals = mart.deals(spark, sf_dir).withColumn("store_id", F.when(F.col("votes") != 7, (F.col("merchant_id").cast("long") * 20).cast("string")))
    return dq.with_relations(deals, mart.merchants(spark, sf_dir), mart.stores(spark, sf_dir)).select("id", "merchant_slug", "store_name", "chain", "lat")


_DOMAINS = "(SELECT *, 'm' || CAST(id AS BIGINT) % 40 || '.ca' AS domain FROM merchants)"


@query("q84b_lookups", oracle(f"SELECT 'merchant' AS kind, id, slug AS name FROM {_DOMAINS} WHERE domain = 'm7.ca' UNION ALL SELECT 'store', id, name FROM stores WHERE id = '17'", "merchants", "stores"))
def _lookups(spark, sf_dir):
    merchants = mart.merchants(spark, sf_dir).withColumn("domain", F.concat(F.lit("m"), (F.col("id").cast("long") % 40).cast("string"), F.lit(".ca")))
    found = dq.by_domain(merchants, "M7.CA").select(F.lit("merchant").alias("kind"), "id", F.col("slug").alias("name"))
    return found.unionByName(dq.by_store(mart.stores(spark, sf_dir), "17").select(F.lit("store").alias("kind"), "id", "name"))


@query(
    "q86b_orders_of_places",
    oracle("(SELECT 'store' AS kind, id FROM stores ORDER BY chain, name, id LIMIT 200) UNION ALL (SELECT 'merchant', id FROM merchants ORDER BY lower(name), id LIMIT 20)", "stores", "merchants"),
)
def _orders(spark, sf_dir):
    """The first stores by chain and name, and the first merchants by name."""
    stores = dq.stores_by_chain(mart.stores(spark, sf_dir)).limit(200).select(F.lit("store").alias("kind"), "id")
    return stores.unionByName(dq.merchants_by_name(mart.merchants(spark, sf_dir)).limit(20).select(F.lit("merchant").alias("kind"), "id"))


@query("q17b_page_counts", oracle(f"SELECT family, count(*) AS total, greatest(1, CAST(ceil(count(*) / 24.0) AS BIGINT)) AS pages FROM {_RELATED.format('deals')} WHERE {_FRESH} GROUP BY family", "deals", "merchants"))
def _page_counts(spark, sf_dir):
    counts = dq.matching(related(spark, sf_dir), DealQuery(), NOW).groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    return counts.withColumn("pages", dq.page_count("total", 24))


# What users ask for -----------------------------------------------------------------------------


def _asked(name: str, make, condition: str, order: str, rows: str) -> None:
    @query(name, oracle(f"SELECT id, price_now FROM {_RELATED.format('deals')} WHERE {_FRESH} AND {condition} ORDER BY {order}, id {rows}", "deals", "merchants"))
    def run(spark, sf_dir):
        return dq.listing(related(spark, sf_dir), make(), NOW).select("id", "price_now")


def _pinned() -> DealQuery:
    """What the page pins wins over the address; both ways of the address are taken."""
    asked = dq.from_params("q=zzz&brand=BRAND%2311,Brand%2323&coupon=1&minPrice=10&maxPrice=x&sort=price-desc&page=3&verdict=nope&family=CANADA", 8)
    again = dq.from_params(dq.to_params(asked), 8)
    return again.pinned(families=(), search=None)


_asked("q14d_from_the_address", _pinned, "lower(brand) IN ('brand#11', 'brand#23') AND coupon_code <> '' AND price_now >= 1000", "coalesce(price_now, -1) DESC", "LIMIT 8 OFFSET 16")
_asked("q14e_from_an_api", lambda: dq.validated({"inStock": "1", "minDiscount": "3.5", "sort": "price-asc", "limit": "40", "page": "3"}), "in_stock AND discount_pct >= 3.5", "coalesce(price_now, 999999999)", "LIMIT 40 OFFSET 80")
_asked("q14f_from_tool_arguments", lambda: dq.from_tool_args({"max_price_dollars": 149.999, "in_stock_only": True, "sort": "newest", "limit": 30, "brands": None}), "in_stock AND (price_now IS NULL OR price_now <= 15000)", "coalesce(posted_at, first_seen_at) DESC", "LIMIT 30")


@query(
    "q89b_tools",
    oracle(
        f"""SELECT * FROM (WITH s AS (SELECT * FROM {_SHOWN_SQL} WHERE {_FRESH}), few AS (SELECT id, count(*) OVER () AS total FROM s WHERE coupon_code <> '' ORDER BY heat DESC, id LIMIT 12)
            SELECT 'found' AS part, id AS name, NULL AS n FROM few UNION ALL SELECT 'total', '', (SELECT count(*) FROM s WHERE coupon_code <> '')
            UNION ALL (SELECT 'facet', merchant_slug, count(*) FROM s WHERE merchant_slug <> '' GROUP BY merchant_slug ORDER BY count(*) DESC, merchant_slug LIMIT 60)
            UNION ALL SELECT 'seen', '$' || format('{{:,.2f}}', price / 100.0::DOUBLE) || ' ' || strftime(observed_at, '%Y-%m-%d'), NULL FROM price_points WHERE product_key = (SELECT product_key FROM deals ORDER BY id LIMIT 1)
            UNION ALL SELECT 'error', unnest(['No tool named nope', 'no_location', 'Unknown field', 'Need between 2 and 6 deal ids']), NULL)""",
        "merchants", "verified",
    ),
)
def _tools(spark, sf_dir):
    deals = _kept(_shown(spark, sf_dir))
    first = deals.orderBy("id").first()
    points = mart.price_points(spark, sf_dir).where(F.col("product_key") == first.product_key).select("id", F.lit(first.id).alias("deal_id"), "price", "observed_at")
    tools = present.Tools(deals, points, mart.stores(spark, sf_dir), NOW)
    found = tools.call("search_deals", {"coupon_only": True})
    none = F.lit(None).cast("long").alias("n")
    parts = [
        found["deals"].select(F.lit("found").alias("part"), F.col("id").alias("name"), none),
        found["total"].select(F.lit("total").alias("part"), F.lit("").alias("name"), F.col("total").alias("n")),
        tools.call("list_facets", {"field": "merchant"})["values"].select(F.lit("facet").alias("part"), F.col("value").alias("name"), F.col("count").alias("n")),
        tools.call("get_price_history", {"deal": first.id})["observations"].select(F.lit("seen").alias("part"), F.concat_ws(" ", "price", "observed_at").alias("name"), none),
    ]
    errors = [tools.call(*x)["error"] for x in (("nope", {}), ("find_deals_near_me", {}), ("list_facets", {"field": "x"}), ("compare_deals", {"deals": ["a"]}))]
    out = spark.createDataFrame([("error", e, None) for e in errors], "part string, name string, n long")
    for part in parts:
        out = out.unionByName(part)
    return out


# Whole pages ------------------------------------------------------------------------------------


@query(
    "q84c_deal_page_with_history",
    oracle(
        f"""SELECT * FROM (WITH own AS (SELECT id, product_key, category FROM deals ORDER BY id DESC LIMIT 1) SELECT 'deal' AS part, id, NULL AS price, NULL AS observed_at FROM own
            UNION ALL SELECT 'point', id, price, observed_at FROM price_points WHERE product_key = (SELECT product_key FROM own)
            UNION ALL (SELECT 'related', id, NULL, NULL FROM verified WHERE {_FRESH} AND category = (SELECT category FROM own)
            ORDER BY CASE verdict WHEN 'verified-low' THEN 3 WHEN 'verified-good' THEN 2 WHEN 'market-price' THEN 1 ELSE 0 END DESC, coalesce(market_discount_pct, 0) DESC, id LIMIT 4))""",
        "verified",
    ),
)
def _deal_page(spark, sf_dir):
    """A deal's page with the recorded prices of its product."""
    last = mart.deals(spark, sf_dir).select("id", "category").orderBy(F.desc("id")).first()
    deals = dedupe.saved(_shown(spark, sf_dir, mart.deals(spark, sf_dir).where(F.col("category") == last.category)))
    points = mart.price_points(spark, sf_dir).join(deals.select("product_key", F.col("id").alias("deal_id")), "product_key").select("id", "deal_id", "price", "observed_at")
    own, seen, alike = present.deal_page(deals, points, f"deal-{last.id}", NOW)
    rows = seen.select(F.lit("point").alias("part"), "id", "price", "observed_at")
    return rows.unionByName(own.select(F.lit("deal").alias("part"), "id"), allowMissingColumns=True).unionByName(alike.select(F.lit("related").alias("part"), "id"), allowMissingColumns=True)


_HOME = f"(SELECT v.* REPLACE (CASE WHEN votes % 3 = 0 THEN 'seed' ELSE source END AS source), s.lat, s.lng FROM {_SHOWN_SQL} v JOIN stores s ON s.id = v.merchant_id)"


@query(
    "q85b_home_page_with_places",
    oracle(
        f"""SELECT * FROM (WITH d AS (SELECT *, {_km(41.5, -141.5)} AS km FROM {_HOME} WHERE {_FRESH})
            SELECT * FROM (SELECT 'deal' AS part, id AS key, (SELECT count(*) FROM d) AS n FROM d ORDER BY heat DESC, id LIMIT 24) UNION ALL (SELECT 'nearby', id, NULL FROM d WHERE km <= 25 ORDER BY heat - 1.5 * km DESC, km, id LIMIT 4)
            UNION ALL SELECT 'seeds', '', count(*) FROM d WHERE source = 'seed' UNION ALL SELECT 'state', unnest(['disabled', 'no-location', CASE WHEN EXISTS (SELECT 1 FROM d WHERE km <= 25) THEN 'deals' ELSE 'no-deals' END, 'no-stores']), NULL)""",
        "merchants", "verified", "stores",
    ),
)
def _home(spark, sf_dir):
    """The front page of somebody with a location, where some deals are samples."""
    spots = mart.stores(spark, sf_dir).select(F.col("id").alias("merchant_id"), "lat", "lng")
    deals = _shown(spark, sf_dir).join(spots, "merchant_id").withColumn("source", F.when(F.col("votes") % 3 == 0, "seed").otherwise(F.col("source")))
    deals = _kept(deals)
    here = (41.5, -141.5)
    parts = present.home_page(deals, mart.source_runs(spark, sf_dir), DealQuery(limit=24), NOW, at=here)
    none = F.lit(None).cast("long").alias("n")
    out = parts["deals"].select(F.lit("deal").alias("part"), F.col("id").alias("key"), F.col("total").alias("n"))
    out = out.unionByName(parts["nearby"].select(F.lit("nearby").alias("part"), F.col("id").alias("key"), none))
    out = out.unionByName(parts["seeds"].select(F.lit("seeds").alias("part"), F.lit("").alias("key"), F.col("total").alias("n")))
    near, nothing = dq.stores_near(mart.stores(spark, sf_dir), *here, 25.0), deals.where("false")
    states = [present.near_state(False, here, near, deals), present.near_state(True, None, near, deals), present.near_state(True, here, near, parts["nearby"]), present.near_state(True, here, near.where("false"), nothing)]
    return out.unionByName(spark.createDataFrame([("state", s, None) for s in states], "part string, key string, n long"))


# Places -----------------------------------------------------------------------------------------

_CODES = ["K1A 0B6", "k1a0b6", " H2x-1y4 ", "M5V", "m5v 2t", "D1A 0B6", "K1D 0B6", "K1A 0O6", "W1A 0B6", "Z9Z 9Z9", "K1A  0B6", "K1A 0B6 x", "", "K1", "9A1 B2C", "V6B"]


def _coded(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    own = F.concat(F.char(key % 26 + 65), (key % 10).cast("string"), F.char(key % 7 * 3 + 65), F.when(key % 2 == 0, F.concat(F.lit(" "), (key % 9).cast("string"), F.char(key * 5 % 26 + 97), F.lit("4"))).otherwise(F.lit("")))
    listed = F.get(F.array(*map(F.lit, _CODES)), (key % len(_CODES)).cast("int"))
    return mart.table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 == 0, listed).otherwise(own).alias("code"))


_CODED = f"""(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {_CODES}[c_custkey % {len(_CODES)} + 1] ELSE chr(CAST(c_custkey % 26 + 65 AS INTEGER)) || c_custkey % 10 || chr(CAST(c_custkey % 7 * 3 + 65 AS INTEGER))
    || CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_custkey % 9 || chr(CAST(c_custkey * 5 % 26 + 97 AS INTEGER)) || '4' ELSE '' END END AS code FROM customer)"""
_AREA = "[ABCEGHJ-NPRSTVXY][0-9][ABCEGHJ-NPRSTV-Z]"


@query(
    "q70b_postal_codes",
    f"""SELECT c_custkey, regexp_full_match(upper(trim(code)), '{_AREA}(?:[ -]?[0-9][ABCEGHJ-NPRSTV-Z][0-9])?') AS valid, CASE WHEN regexp_full_match(left(regexp_replace(upper(trim(code)), '[\\s-]', '', 'g'), 3), '{_AREA}') THEN left(regexp_replace(upper(trim(code)), '[\\s-]', '', 'g'), 3) END AS area FROM {_CODED}""",
)
def _postal(spark, sf_dir):
    return _coded(spark, sf_dir).select("c_custkey", places.postal_code("code").alias("valid"), places.sortation_area("code").alias("area"))


_TYPED = "substr(CASE c_custkey % 3 WHEN 0 THEN upper(name) WHEN 1 THEN strip_accents(name) ELSE '  ' || name END, 1, CAST(2 + c_custkey % 11 AS INTEGER)) || CASE WHEN c_custkey % 13 = 0 THEN 'q' ELSE '' END"


@query(
    "q70c_city_points",
    f"""WITH cities AS (SELECT unnest(range({len(places.CITIES)})) AS place, unnest([{', '.join("'" + c[0].replace("'", "''") + "'" for c in places.CITIES)}]) AS name, unnest([{', '.join(str(c[1]) for c in places.CITIES)}]::DOUBLE[]) AS lat),
        typed AS (SELECT c_custkey, lower(strip_accents(trim({_TYPED}))) AS start FROM customer JOIN cities ON place = c_custkey % {len(places.CITIES)})
        SELECT c_custkey, arg_min(name, place) AS city, arg_min(lat, place) AS lat FROM typed LEFT JOIN cities ON length(start) >= 2 AND starts_with(lower(strip_accents(name)), start) GROUP BY c_custkey""",
)
def _cities(spark, sf_dir):
    """Beginnings of names, in capitals, without accents, behind blanks, and with a slip."""
    key = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(c[0]) for c in places.CITIES]), (key % len(places.CITIES)).cast("int"))
    plain = F.translate(name, "éèêëàâîïôöûùüçÉÈÊÀÂÎÔÛÇ", "eeeeaaiioouuucEEEAAIOUC")
    shaped = F.when(key % 3 == 0, F.upper(name)).when(key % 3 == 1, plain).otherwise(F.concat(F.lit("  "), name))
    typed = F.concat(F.substring(shaped, F.lit(1), (2 + key % 11).cast("int")), F.when(key % 13 == 0, "q").otherwise(""))
    return mart.table(spark, sf_dir, "customer").select("c_custkey", places.city_point(typed).alias("p")).select("c_custkey", F.col("p.label").alias("city"), F.col("p.lat").alias("lat"))


@query(
    "q104b_location_both_ways",
    "SELECT c_custkey, (41 + c_custkey % 30 + 0.25)::DOUBLE AS lat, (-60.5 - c_custkey % 70)::DOUBLE AS lng, 'Café & ' || c_name AS label, 'city' AS precision, 'S' || c_custkey || ',a b' AS stores FROM customer",
)
def _cookie(spark, sf_dir):
    """A location as a browser keeps it, read back."""
    key = F.col("c_custkey")
    at = F.struct((41 + key % 30 + 0.25).cast("double").alias("lat"), (-60.5 - key % 70).cast("double").alias("lng"), F.concat(F.lit("Café & "), "c_name").alias("label"), F.lit("city").alias("precision"), F.array(F.concat(F.lit("S"), key.cast("string")), F.lit("a b")).alias("store_ids"))
    back = mart.table(spark, sf_dir, "customer").select("c_custkey", places.stored_location(places.location_cookie(at)).alias("p"))
    return back.select("c_custkey", "p.lat", "p.lng", "p.label", "p.precision", F.array_join("p.store_ids", ",").alias("stores"))


# Costs and payloads -------------------------------------------------------------------------------


@query(
    "q24b_cost_report",
    oracle(
        """SELECT model, CASE WHEN model <> 'system' THEN CAST(sum(input_tokens * 100 + output_tokens * 400 + cache_read_tokens * 10) AS DOUBLE) END AS cents, count(DISTINCT conversation_id) AS conversations,
            CASE WHEN model <> 'system' THEN CAST(sum(input_tokens * 100 + output_tokens * 400 + cache_read_tokens * 10) AS DOUBLE) / count(DISTINCT conversation_id) END AS cents_per_conversation FROM usage GROUP BY model""",
        "usage",
    ),
)
def _costs(spark, sf_dir):
    rates = spark.createDataFrame([(m, 1e6, 4e6, 1e5) for m in ("user", "assistant", "other")], "model string, input_rate double, output_rate double, cache_rate double")
    return history.cost_report(mart.usage(spark, sf_dir), rates)


@query("q92c_append_more_usage", oracle(f"SELECT model, created_at, count(*) AS turns, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM (SELECT model, output_tokens, TIMESTAMP '{mart.NOW}' AS created_at FROM usage UNION ALL SELECT model, output_tokens, TIMESTAMP '2002-01-01' FROM usage WHERE tool_calls = 1) GROUP BY ALL", "usage"))
def _more_usage(spark, sf_dir):
    turns = mart.usage(spark, sf_dir)
    stored = runlog.append_usage(spark.createDataFrame([], USAGE), turns.withColumn("created_at", mart.now()))
    both = runlog.append_usage(stored, turns.where("tool_calls = 1").withColumn("created_at", F.to_timestamp_ntz(F.lit("2002-01-01 00:00:00"))))
    return both.groupBy("model", "created_at").agg(F.count(F.lit(1)).alias("turns"), F.sum("output_tokens").alias("output_tokens"))


@query(
    "q120b_shop_sizes_and_tags",
    """SELECT CAST(p_partkey AS VARCHAR) AS source_id, CASE p_partkey % 4 WHEN 0 THEN 'women' WHEN 1 THEN 'boys' END AS department_hint, CASE WHEN p_partkey % 3 = 0 THEN 'S,L' WHEN p_partkey % 3 = 1 THEN 'Red,Blue' ELSE '' END AS sizes FROM part""",
)
def _sizes(spark, sf_dir):
    """Sizes in the first or second option, or none; departments among the tags, as a list or a text."""
    key = F.col("p_partkey")
    names = F.when(key % 3 == 0, F.array(F.lit("Colour"), F.lit("SIZE"))).when(key % 3 == 1, F.array(F.lit("Taille"))).otherwise(F.array(F.lit("Colour")))
    variant = lambda one, two, live: F.struct(F.lit(one).alias("option1"), F.lit(two).alias("option2"), _size().alias("price"), _size(1).alias("compare_at_price"), F.lit(live).alias("available"))
    variants = F.array(variant("Red", "S", True), variant("Green", "M", False), variant("Blue", "L", True), variant("Red", "S", True))
    tags = F.when(key % 4 == 0, F.to_json(F.array(F.lit("New"), F.lit("Women")))).when(key % 4 == 1, F.lit('"sale, BOYS"')).when(key % 4 == 2, F.lit('"womens"')).otherwise(F.lit("null"))
    tags = F.when(key % 4 == 1, F.lit('["sale", " BOYS "]')).otherwise(tags)
    item = F.struct(key.cast("string").alias("id"), F.col("p_name").alias("title"), F.transform(names, lambda n: F.struct(n.alias("name"))).alias("options"), variants.alias("variants"))
    text = F.to_json(F.struct(F.array(item).alias("products")))
    text = F.replace(text, F.lit('{"products":[{'), F.concat(F.lit('{"products":[{"tags":'), tags, F.lit(",")))
    out = payloads.shopify(_payloads(spark, sf_dir, text), "https://s.ca")
    return out.select("source_id", "department_hint", F.array_join("sizes_available", ",").alias("sizes"))
