"""Queries written as SQL texts, with the engine's functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from . import mart
from .mart import oracle
from .markup import _filled
from .more import _size
from .queries import _km, query


@query(
    "q140_sql_prices",
    oracle(
        """SELECT m.family, d.id, CASE WHEN price_now IS NULL THEN '—' WHEN price_now = 0 THEN 'Free' ELSE '$' || format('{:,.2f}', price_now / 100.0::DOUBLE) END AS price, d.discount_pct AS pct, floor(d.discount_pct + 0.5) AS whole
            FROM deals d JOIN merchants m ON m.id = d.merchant_id WHERE status = 'active' AND d.discount_pct > 3""",
        "deals", "merchants",
    ),
)
def _prices(spark, sf_dir):
    sql.register(spark)
    return spark.sql(
        """SELECT m.family, d.id, format_cents(price_now) AS price, discount_pct(price_now, price_was) AS pct, half_up(discount_pct(price_now, price_was), 0) AS whole
           FROM {deals} d JOIN {merchants} m ON m.id = d.merchant_id WHERE status = 'active' AND discount_pct(price_now, price_was) > 3""",
        deals=mart.deals(spark, sf_dir), merchants=mart.merchants(spark, sf_dir),
    )


@query("q141_sql_distances", oracle(f"SELECT chain, count(*) AS stores, floor(min({_km(51.0, -100.0)}) * 1000 + 0.5) / 1000 AS nearest FROM stores GROUP BY chain", "stores"))
def _distances(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT chain, count(*) AS stores, half_up(min(distance_km(51.0D, -100.0D, lat, lng)), 3) AS nearest FROM {stores} GROUP BY chain", stores=mart.stores(spark, sf_dir))


@query(
    "q142_sql_pages",
    """SELECT page_id, unnest([0, 1]) AS place, unnest(['one & ' || page_id, 'two']) AS text, unnest(['/a/' || page_id, '/b']) AS href FROM pages WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 0, 'two', '/b' FROM pages WHERE page_id % 3 = 0""",
)
def _pages(spark, sf_dir):
    sql.register(spark)
    page = F.col("page_id").cast("string")
    html = _filled(F.when(F.col("page_id") % 3 > 0, _filled("<ul class='x p'><li><a href='/a/", page, "'><b>one</b> &amp; ", page, "</a></ul>")).otherwise("<ul><li><a href='/n'>no</a></ul>"), "<ul class=p><li><a href=/b>two</ul>", F.lit("<div>"), F.col("html"))
    pages = mart.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return spark.sql("SELECT page_id, t.place, t.text, t.attributes['href'] AS href FROM {pages}, LATERAL html_select(html, 'ul.p a[href]') t", pages=pages)


@query(
    "q143_sql_feeds",
    "SELECT p_partkey, 0 AS row, trim(p_name) || ', \"x\"' AS title, CAST(p_size AS VARCHAR) AS price FROM part UNION ALL SELECT p_partkey, 1, NULL, '7' FROM part WHERE p_partkey % 2 = 1",
)
def _feeds(spark, sf_dir):
    sql.register(spark)
    commas = _filled('ID,Title , Price\r\n1,"', F.col("p_name"), ', ""x""",', _size(), "\r\n,,\r\n2,,7\r\n")
    tabs = _filled("﻿title\tprice\n ", F.col("p_name"), ', "x"\t', _size())
    texts = mart.parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 2 == 1, commas).otherwise(tabs).alias("content"))
    return spark.sql("SELECT p_partkey, t.row, t.fields['title'] AS title, t.fields['price'] AS price FROM {feeds}, LATERAL feed_rows(content) t", feeds=texts)
