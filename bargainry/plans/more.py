"""Queries on labels, places and payloads of storefronts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, places
from ..sources import storefronts
from . import mart
from .mart import oracle
from .queries import query

_UNIT = "CAST({0} AS VARCHAR) || CASE WHEN {0} = 1 THEN ' {1}' ELSE ' {1}s' END"
_AGO = f"""CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || ' min ago' WHEN h < 24 THEN {_UNIT.format("h", "hour")} || ' ago'
    WHEN d < 30 THEN {_UNIT.format("d", "day")} || ' ago' ELSE {_UNIT.format("CAST(floor(d / 30 + 0.5) AS BIGINT)", "month")} || ' ago' END"""
_STEPS = """(SELECT *, CAST(floor(h / 24 + 0.5) AS BIGINT) AS d FROM (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM
    (SELECT *, CAST(floor(s / 60 + 0.5) AS BIGINT) AS m FROM ({}))))"""


@query("q68_relative_time", oracle(f"SELECT id, {_AGO} AS posted FROM {_STEPS.format(f'''SELECT id, date_diff('second', posted_at, TIMESTAMP '{mart.NOW}') AS s FROM deals''')}", "deals"))
def _relative(spark, sf_dir):
    return mart.deals(spark, sf_dir).select("id", labels.relative_time("posted_at", mart.now()).alias("posted"))


_ENDS = f"""CASE WHEN s <= 0 THEN 'Expired' WHEN h < 1 THEN 'Ends within the hour' WHEN h < 24 THEN 'Ends in ' || {_UNIT.format("h", "hour")}
    WHEN d = 1 THEN 'Ends tomorrow' WHEN d > 1 THEN 'Ends in ' || {_UNIT.format("d", "day")} END"""


@query("q69_expiry_label", oracle(f"SELECT id, {_ENDS} AS ends, coalesce(s > 0 AND s < 86400, false) AS soon FROM {_STEPS.format(f'''SELECT id, date_diff('second', TIMESTAMP '{mart.NOW}', expires_at) AS s FROM deals''')}", "deals"))
def _ends(spark, sf_dir):
    return mart.deals(spark, sf_dir).select("id", labels.expiry_label("expires_at", mart.now()).alias("ends"), labels.expiring_soon("expires_at", mart.now()).alias("soon"))


_LETTERS = "ABCEGHJKLMNPRSTVXYZ"


def _values(table: tuple) -> str:
    return ", ".join("('{}', {}, {}, '{}')".format(k, lat, lng, label.replace("'", "''")) for k, lat, lng, label in table)


@query(
    "q70_postal_point",
    f"""WITH c AS (SELECT c_custkey, substr('{_LETTERS}', CAST(c_custkey % {len(_LETTERS)} AS INTEGER) + 1, 1) || CAST(c_custkey % 10 AS VARCHAR) AS prefix FROM customer)
        SELECT c_custkey, coalesce(f.label, p.label) AS label, CAST(coalesce(f.lat, p.lat) AS DOUBLE) AS lat, CAST(coalesce(f.lng, p.lng) AS DOUBLE) AS lng
        FROM c LEFT JOIN (VALUES {_values(places.PREFIXES)}) f(k, lat, lng, label) ON f.k = prefix
        LEFT JOIN (VALUES {_values(places.PROVINCES)}) p(k, lat, lng, label) ON p.k = prefix[1]""",
)
def _postal(spark, sf_dir):
    key = F.col("c_custkey")
    code = F.concat(F.substring(F.lit(_LETTERS), (key % len(_LETTERS) + 1).cast("int"), F.lit(1)), (key % 10).cast("string"), F.lit("a 1b2"))
    return mart.table(spark, sf_dir, "customer").select("c_custkey", places.point(code).alias("p")).select("c_custkey", "p.label", "p.lat", "p.lng")


# Payloads made of parts, a page of one listing each -------------------------------------------


def _payloads(spark, sf_dir, payload) -> DataFrame:
    return mart.parts(spark, sf_dir).select(F.lit("part").alias("source"), payload.alias("payload"))


def _shown(raw: DataFrame) -> DataFrame:
    return raw.select("source_id", "title", F.col("price").cast("double").alias("price"), F.col("price_was").cast("double").alias("price_was"))


def _expected(prefix: str, condition: str, title: str = "trim(p_name)") -> str:
    return f"SELECT '{prefix}' || p_partkey AS source_id, {title} AS title, CAST(p_size AS DOUBLE) AS price, CAST(p_size + 1 AS DOUBLE) AS price_was FROM part WHERE {condition}"


def _size(more: int = 0):
    return (F.col("p_size") + more).cast("string")


@query("q71_storefront_search", _expected("h.ca:", "p_partkey % 3 = 2 AND p_partkey % 5 <> 0"))
def _storefront(spark, sf_dir):
    key = F.col("p_partkey")
    item = F.struct(
        key.cast("string").alias("code"), F.col("p_name").alias("title"), F.struct(F.col("p_size").alias("value")).alias("currentPrice"),
        (F.col("p_size") + key % 3 - 1).alias("originalPrice"), F.when(key % 5 == 0, "Members save more").alias("badge"),
    )
    page = F.to_json(F.struct(F.struct(F.array(item).alias("products")).alias("data")))
    return _shown(storefronts.hybris(_payloads(spark, sf_dir, page), "https://h.ca", "h.ca"))


@query("q72_category_list", _expected("g.ca:", "p_partkey % 3 <> 0"))
def _styles(spark, sf_dir):
    key = F.col("p_partkey")
    sale = F.concat(F.lit("$"), _size(), F.when(key % 3 == 0, F.lit(" - $99")).otherwise(F.lit(".00")))
    price = F.struct(F.concat(F.lit("$"), _size(1), F.lit(".00")).alias("regularPrice"), sale.alias("salePrice"))
    item = F.struct(F.col("p_name").alias("name"), key.cast("string").alias("businessCatalogItemId"), price.alias("price"))
    page = F.to_json(F.struct(F.array(F.struct(F.array(item).alias("ccList"))).alias("pages")))
    return _shown(storefronts.category_list(_payloads(spark, sf_dir, page), "https://g.ca", "g.ca"))


@query("q73_blog_posts", _expected("b.ca:", "p_partkey % 2 = 1", "trim(p_name) || ' $' || p_size || '.00 (reg. $' || (p_size + 1) || '.00)'"))
def _blog(spark, sf_dir):
    key = F.col("p_partkey")
    marked = F.when(key % 2 == 1, F.lit(" (reg. $")).otherwise(F.lit(" and $"))
    title = F.concat("p_name", F.lit(" &#36;"), _size(), F.lit(".00"), marked, _size(1), F.lit(".00)"))
    post = F.struct(key.alias("id"), F.struct(title.alias("rendered")).alias("title"), F.concat(F.lit("https://b.ca/"), key.cast("string")).alias("link"))
    return _shown(storefronts.posts(_payloads(spark, sf_dir, F.to_json(F.array(post))), "b.ca"))


@query("q74_price_drops", _expected("camel:", "true").replace("'camel:' || p_partkey", "'camel:B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"))
def _drops(spark, sf_dir):
    link = F.concat(F.lit("https://t.ca/product/B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    title = F.concat("p_name", F.lit(" - down 5% to $"), _size(), F.lit(".00 from $"), _size(1), F.lit(".00"))
    feed = F.concat(F.lit("<rss><item><title>"), title, F.lit("</title><link>"), link, F.lit("</link></item></rss>"))
    return _shown(storefronts.price_drops(_payloads(spark, sf_dir, feed)))
