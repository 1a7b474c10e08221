"""Parsers on small payloads, a run and a stream of two batches."""

import json

import pytest
from pyspark.sql import functions as F

from bargainry.operators import evaluate
from bargainry.schemas import RAW
from bargainry.sources import payloads
from bargainry.streaming import ingest


def table(spark, *texts):
    return spark.createDataFrame([("s", t) for t in texts], "source string, payload string")


def one(df, *columns):
    (row,) = df.collect()
    return tuple(row[c] for c in columns)


def test_shopify(spark):
    variant = {"id": 1, "option1": "M", "price": "20.00", "compare_at_price": "40.00", "available": True, "barcode": "b"}
    product = {"id": 7, "title": "Coat", "handle": "coat", "body_html": "<p>Warm</p>", "vendor": "V", "tags": ["Women", "sale"], "options": [{"name": "Size"}], "images": [{"src": "//i/x.jpg"}]}
    sold = variant | {"price": "10.00", "available": False, "option1": "S"}
    full = product | {"id": 8, "variants": [variant | {"compare_at_price": None}]}
    page = json.dumps({"products": [product | {"variants": [sold, variant]}, full, product | {"id": 9, "variants": []}]})
    got = payloads.shopify(table(spark, page, "no json", "{}"), "https://shop.ca")
    assert one(got, "source_id", "url", "price", "price_was", "department_hint", "sizes_available", "in_stock") == ("7", "https://shop.ca/products/coat", "20.0", "40.0", "women", ["M"], True)
    assert payloads.shopify(table(spark, page), "https://shop.ca", on_sale=True).count() == 2


def test_other_json(spark):
    topic = {"topic_id": 1, "title": "TV", "web_path": "/tv", "offer": {"price": "$5", "list_price": "$9"}, "votes": {"total_up": 1, "total_down": 4}}
    got = payloads.forum(table(spark, json.dumps({"topics": [topic, topic | {"title": "[EXPIRED] x"}, topic | {"offer": None}]})), "https://f.ca")
    assert one(got, "url", "votes") == ("https://f.ca/tv", 0.0)
    item = {"sku": 3, "name": "Set", "salePrice": 5.0, "regularPrice": 8.0, "productUrl": "/p/3", "availability": {"isAvailableOnline": False}}
    got = payloads.retailer_search(table(spark, json.dumps({"products": [item, item | {"regularPrice": 5.0}, item | {"salePrice": None}]})), "https://r.ca")
    assert one(got, "source_id", "price_was", "in_stock") == ("3", "8.0", False)
    good = {"name": "Mug", "sku": "m", "url_key": "mug", "url_suffix": ".html", "categories": [{"name": "A"}, {"name": "A"}], "price_range": {"minimum_price": {"regular_price": {"value": 9}, "final_price": {"value": 5}}}}
    flat = good | {"price_range": {"minimum_price": {"regular_price": {"value": 9}, "final_price": {"value": 9}}}}
    got = payloads.magento(table(spark, json.dumps({"data": {"products": {"items": [good, flat]}}})), "https://m.ca")
    assert one(got, "url", "price", "category_hint") == ("https://m.ca/mug.html", "5.0", "A")


@pytest.mark.parametrize("shape", ["object", "list", "graph"])
def test_product_page(spark, shape):
    node = {"@type": "Product", "name": "Lamp", "brand": {"@type": "Brand", "name": "B"}, "gtin13": "4006381333931", "sku": "L1", "offers": [{"price": "5.00", "availability": "https://schema.org/OutOfStock"}, {"price": "7.50", "priceCurrency": "CAD"}]}
    block = {"object": node, "list": [{"@type": "Thing"}, node], "graph": {"@graph": [node]}}[shape]
    html = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{json.dumps(block)}</script>'
    pages = spark.createDataFrame([("s", "https://x.ca/l", html), ("s", "https://x.ca/n", "<p>")], "source string, url string, payload string")
    assert one(payloads.product_page(pages), "title", "price", "brand", "gtin", "in_stock") == ("Lamp", "7.5", "B", "4006381333931", True)


def test_pages(spark):
    html = '<meta content="Chair" property="og:title"><meta property="product:price:amount" content="12.50">'
    pages = spark.createDataFrame([("s", "https://x.ca/c", html)], "source string, url string, payload string")
    assert one(payloads.product_page(pages), "title", "price", "price_was") == ("Chair", "12.5", None)
    page = '<a href="/a">1</a> <a class=x href=\'b.html\'>2</a><a href="/a">3</a><a href="mailto:q@x">4</a><a href="//c.ca/d">5</a>'
    got = spark.createDataFrame([(page,)], "h string").select(payloads.links(F.col("h"), F.lit("https://x.ca/dir/p.html")).alias("l"), payloads.platform(F.col("h")).alias("p")).first()
    assert got["l"] == ["https://x.ca/a", "https://x.ca/dir/b.html", "https://c.ca/d"] and got["p"] == "unknown"
    rows = '<tr><th>Item</th></tr><tr><td><a href="/i">Saw blade</a></td><td>$5</td><td>$9</td><td>2 left</td><td>7</td></tr><tr><td>ab</td><td></td><td></td><td></td></tr>'
    assert one(payloads.clearance(table(spark, rows), "https://t.ca"), "title", "url", "stock_note", "in_stock") == ("Saw blade", "https://t.ca/i", "2 in stock · Aisle 7", True)
    feed = "<rss><item><title><![CDATA[A & B]]></title><link>https://x/1</link></item><item><title>Old expired</title></item></rss>"
    assert one(payloads.rss(table(spark, feed)), "title", "url", "source_id") == ("A & B", "https://x/1", "https://x/1")


def test_feed(spark, tmp_path):
    (tmp_path / "f.csv").write_text('﻿ID,Title,Link,Price,Sale_Price\n1,"Mug, ""big""",https://x/1,"1,200.00 CAD",900\n2,Cup,https://x/2,5,5\n', encoding="utf-8")
    got = payloads.feed(payloads.read_feed(spark, str(tmp_path / "f.csv")), "feed")
    assert one(got, "source_id", "title", "price", "price_was", "in_stock") == ("1", 'Mug, "big"', "900.0", "1200.0", True)


def test_stream(spark, tmp_path):
    names = [f.split()[0] for f in RAW.split(", ")]
    row = dict.fromkeys(names) | {"source": "s", "title": "Lamp deluxe", "url": "https://x.ca/l", "merchant_domain": "x.ca"}
    merchants = spark.createDataFrame([("m1", "x", "x.ca")], "id string, slug string, domain string")
    days = [F.to_timestamp_ntz(F.lit(f"2024-01-0{d} 00:00:00")) for d in (1, 2)]
    (tmp_path / "raw").mkdir()
    batches = [[row | {"source_id": "1", "price": "20"}, row | {"source_id": "2", "title": "x", "price": "1"}], [row | {"source_id": "1", "price": "18"}]]
    for n, (rows, day) in enumerate(zip(batches, days, strict=True)):
        (tmp_path / f"raw/{n}.json").write_text("\n".join(map(json.dumps, rows)))
        ingest.start(spark, str(tmp_path / "raw"), str(tmp_path / "lake"), merchants, day).awaitTermination()
    lake = ingest.lake(str(tmp_path / "lake"))
    assert one(lake.deals.read(spark), "price_now", "merchant_id", "status") == (1800, "m1", "active")
    assert sorted(r["price"] for r in lake.points.read(spark, 1).collect()) == [1800, 2000]
    assert lake.drops.read(spark, 0).count() == 1 and lake.runs.read(spark, 1).count() == 2


def test_recall(spark):
    surfaced = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("b", 1, "x")], "case_id string, pos int, deal_id string")
    hits = evaluate.first_hits(surfaced, spark.createDataFrame([("a", "z"), ("b", "q")], "case_id string, deal_id string"))
    assert {r["case_id"]: r["rank"] for r in hits.collect()} == {"a": 3, "b": None}
    assert one(evaluate.recall(hits), "cases", "found") == (2, 1)
