"""Queries on feeds as files and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dedupe import scratch
from ..sources import delimited, payloads
from ..streaming import changes
from . import mart
from .markup import _filled, _id, _key
from .more import _payloads, _size
from .mart import oracle
from .queries import query


@query(
    "q126b_namespaced_feed",
    """SELECT trim(p_name) || ' & co <b>' AS title, CASE WHEN p_partkey % 2 = 0 THEN 'G/' || p_partkey ELSE 'https://r.ca/?a=1&b=' || p_partkey END AS source_id, 'https://r.ca/?a=1&b=' || p_partkey AS url,
        CASE WHEN p_partkey % 3 = 0 THEN 'Body & more' ELSE 'Short' END AS description, CASE WHEN p_partkey % 5 = 0 THEN '2024-01-02T03:04:05Z' ELSE 'Tue, 02 Jan 2024 03:04:05 GMT' END AS posted_at FROM part""",
)
def _namespaced(spark, sf_dir):
    """Namespaces, attributes, CDATA in pieces, comments, empty elements, and a title of a picture before the item's own."""
    day = F.when(_key() % 5 == 0, "<dc:date>2024-01-02T03:04:05Z</dc:date><pubDate/>").otherwise("<pubDate> Tue, 02 Jan 2024 03:04:05 GMT</pubDate>")
    item = _filled(
        "<item rdf:about='x'><!-- <title>no</title> --><media:title>picture</media:title><title type=\"text\">", F.col("p_name"), " &#38; <![CDATA[co ]]>&lt;b><!-- x --></title><link>https://r.ca/?a=1&amp;b=", _id(), "</link><atom:link href='y'/>",
        F.when(_key() % 2 == 0, _filled("<guid isPermaLink=\"false\">G/", _id(), "</guid>")).otherwise(""), "<description>Short</description>", F.when(_key() % 3 == 0, "<content:encoded><![CDATA[<p>Body &amp; <i>more</i></p>]]></content:encoded>").otherwise(""), day, "</item>",
    )
    feed = _filled("<?xml version='1.0'?><rss xmlns:media='m'><channel><title>all</title><link/>", item, "<item><title>[Expired] y</title></item></channel></rss>")
    said = F.trim(F.regexp_replace("description", r"\s+", " ")).alias("description")
    return payloads.rss(_payloads(spark, sf_dir, feed)).select("title", "source_id", "url", said, "posted_at")


@query(
    "q127b_folder_of_feeds",
    """SELECT CAST(p_partkey AS VARCHAR) AS source_id, trim(p_name) || CASE p_partkey % 3 WHEN 0 THEN ', "big"' || chr(10) || 'one' WHEN 1 THEN ', with comma' ELSE '' END AS title, p_size::DOUBLE AS price, p_size + 1.0::DOUBLE AS price_was, CASE WHEN p_partkey % 3 = 2 THEN p_brand END AS brand FROM part WHERE p_partkey % 6 > 0""",
)
def _folder(spark, sf_dir):
    """Files with commas, quotes and line breaks; with tabs; and with a byte order mark, a column twice and blank rows."""
    folder, part = scratch(spark), mart.table(spark, sf_dir, "part")
    was = F.when(_key() % 6 == 0, _size()).otherwise(_size(1))
    shapes = (
        (0, "ID,Title, Regular_Price ,sale_price,", _filled(_id(), ',"', F.col("p_name"), ', ""big""\none",', was, ".00 CAD,", _size(), ",x")),
        (1, "link\tname\tprice\tsale_price\tid", _filled("l\t", F.col("p_name"), ", with comma\t", was, "\t", _size(), "\t", _id())),
        (2, "﻿sku,brand,title,brand,sale_price,price", _filled(_id(), ",no, ", F.col("p_name"), " ,", F.col("p_brand"), ",", _size(), ",", was, "\n , ,,,\n")),
    )
    for rest, header, line in shapes:
        body = part.where(_key() % 3 == rest).select(_key().alias("at"), line.alias("line"))
        lines = body.unionByName(spark.createDataFrame([(-1, header)], "at long, line string")).coalesce(1).sortWithinPartitions("at")
        lines.select("line").write.text(f"{folder}/{rest}")
    out = payloads.feed(delimited.read_feeds(spark, folder), "feed")
    return out.select("source_id", "title", F.col("price").cast("double").alias("price"), F.col("price_was").cast("double").alias("price_was"), "brand")


@query(
    "q30b_change_stream",
    oracle("SELECT product_key AS key, id, price FROM (SELECT *, lag(price) OVER (PARTITION BY product_key ORDER BY observed_at, id) AS before FROM price_points) WHERE price IS DISTINCT FROM before", "price_points"),
)
def _change_stream(spark, sf_dir):
    """All price points as three files of any order, a batch each; a last row of a later time lets all of them out."""
    folder = scratch(spark)
    points = mart.price_points(spark, sf_dir).select("id", F.col("product_key").alias("deal_id"), "price", F.col("observed_at").cast("timestamp").alias("observed_at"))
    for n in range(3):
        points.where(F.pmod(F.xxhash64("id"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    spark.createDataFrame([("end", "end", 0)], "id string, deal_id string, price long").withColumn("observed_at", F.lit("2100-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", changes.STORE)
    try:
        found = changes.changes_of_files(spark, f"{folder}/in", "id string, deal_id string, price long, observed_at timestamp", f"{folder}/out", late="20000 days")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    return found.select("key", "id", "price")
