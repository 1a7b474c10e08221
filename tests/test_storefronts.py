"""Storefronts, blogs and trackers, labels and places, on small rows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bargainry.functions import labels, places
from bargainry.sources import storefronts


def table(spark, *texts):
    return spark.createDataFrame([("s", t) for t in texts], "source string, payload string")


def rows(df):
    return {r["source_id"]: r for r in df.collect()}


def test_hybris(spark):
    sale = {"code": "1", "title": "Drill", "currentPrice": {"value": 80.0}, "originalPrice": "$100.00", "url": "/en/p/1", "images": [{"url": "/i.png"}], "brand": {"label": "M"}}
    products = [
        sale, sale | {"title": "again"}, sale | {"code": "2", "originalPrice": 80.0}, sale | {"code": "3", "badges": [{"label": "Triangle member price"}]},
        sale | {"code": "4", "promoMessage": "2 for $150"}, sale | {"code": "5", "currentPrice": None}, {"title": "no code"}, "text",
    ]
    page = json.dumps({"data": [{"results": products}], "results": "no list", "products": 5})
    got = rows(storefronts.hybris(table(spark, page, "{bad", "[]", "3", None), "https://t.ca", "t.ca"))
    assert set(got) == {"t.ca:1", "t.ca:4"}
    one = got["t.ca:1"]
    assert (one["title"], one["price"], one["price_was"], one["url"], one["image_url"], one["brand"], one["in_stock"], one["stock_note"]) == ("Drill", "80.0", "100.0", "https://t.ca/en/p/1", "https://t.ca/i.png", "M", True, None)
    assert got["t.ca:4"]["stock_note"].startswith("2 for $150 — ")


def test_category_list(spark):
    style = {"name": "Jeans", "businessCatalogItemId": "9", "price": {"regularPrice": "$34.99 - $49.99", "salePrice": "$20.00 - $30.00", "promoText": "Extra 50% off, use code MORE"}, "styleColors": [{"inStock": False, "sizes": [{"name": "S"}]}, {"inStock": True, "sizes": [{"name": "S"}, {"name": "M"}]}]}
    others = [style | {"businessCatalogItemId": i, "price": p} for i, p in (("a", {"regularPrice": "$20-$60", "salePrice": "$15"}), ("b", {"regularPrice": "$5", "salePrice": "$5"}), ("c", {"regularPrice": "29,99 $", "salePrice": "19,99 $"}))]
    got = rows(storefronts.category_list(table(spark, json.dumps({"x": {"y": [{"ccList": [style, *others]}]}})), "https://g.ca", "g.ca", department="men"))
    assert set(got) == {"g.ca:9", "g.ca:c"}
    one = got["g.ca:9"]
    assert (one["price"], one["price_was"], one["sizes_available"], one["in_stock"], one["department_hint"]) == ("20.0", "34.99", ["S", "M"], True, "men")
    assert one["stock_note"] == "Extra 50% off — apply with code MORE at checkout." and got["g.ca:c"]["price"] == "19.99"


def test_posts(spark):
    def post(i, title, excerpt=""):
        return {"id": i, "title": {"rendered": title}, "excerpt": {"rendered": excerpt}, "link": f"https://b.ca/{i}", "date_gmt": "2024-01-01T00:00:00", "content": {"rendered": "<img src='https://b.ca/x.jpg'>"}}

    page = [
        post(1, "Lamp &#038; shade &#x1F600; $19.99 (reg. $39.99)"), post(2, "Was $1,039.50, now $19,99"), post(3, "From $5 to $9"), post(4, "$9 and more"),
        post(5, "Sale", "<p>$10</p> " + "x" * 50 + " reg. $20"), post(1, "again $1 (reg. $2)"), post(6, "$50 set, $4 (reg. $8)"),
    ]
    got = rows(storefronts.posts(table(spark, json.dumps(page)), "b.ca", "B", about=("shop.ca", "Shop")))
    assert {k: (r["price"], r["price_was"]) for k, r in got.items()} == {"b.ca:1": ("19.99", "39.99"), "b.ca:2": ("19.99", "1039.5"), "b.ca:6": ("4.0", "8.0")}
    one = got["b.ca:1"]
    assert one["title"].startswith("Lamp & shade \U0001f600 $19.99") and one["merchant_domain"] == "shop.ca" and one["image_url"] == "https://b.ca/x.jpg"


def test_price_drops(spark):
    def item(asin, title, text=""):
        return f"<item><title><![CDATA[{title}]]></title><link>https://t.ca/product/{asin}?x=1</link><description>{text}</description></item>"

    feed = "".join([
        item("B000000001", "Pan - down 21.13% ($6.76) to $25.23 from $31.99"), item("B000000002", "Up", "Now $59.99, previously $49.99"),
        item("B000000003", "Pot", "$5.00 $9.00"), item("B000000001", "Pan to $1 from $2"), item("short", "None", "$5 $9"), item("B000000004", "One", "$5"),
    ])
    got = rows(storefronts.price_drops(table(spark, feed)))
    assert {k: (r["title"], r["price"], r["price_was"]) for k, r in got.items()} == {"camel:B000000001": ("Pan", "25.23", "31.99"), "camel:B000000003": ("Pot", "5.0", "9.0")}


def test_labels(spark):
    now = datetime(2024, 1, 10)
    cases = [(timedelta(seconds=20), "just now"), (timedelta(minutes=5), "5 min ago"), (timedelta(hours=1), "1 hour ago"), (timedelta(hours=30), "1 day ago"), (timedelta(days=45), "2 months ago"), (-timedelta(hours=2), "just now")]
    df = spark.createDataFrame([(n, now - d) for n, (d, _) in enumerate(cases)] + [(99, None)], "n int, at timestamp_ntz")
    at = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    got = {r["n"]: r["x"] for r in df.select("n", labels.relative_time("at", at).alias("x")).collect()}
    assert got == {n: text for n, (_, text) in enumerate(cases)} | {99: ""}
    ends = [(-1, "Expired"), (0.2, "Ends within the hour"), (1, "Ends in 1 hour"), (23, "Ends in 23 hours"), (30, "Ends tomorrow"), (72, "Ends in 3 days")]
    df = spark.createDataFrame([(n, now + timedelta(hours=h)) for n, (h, _) in enumerate(ends)] + [(99, None)], "n int, at timestamp_ntz")
    out = df.select("n", labels.expiry_label("at", at).alias("x"), labels.expiring_soon("at", at).alias("soon")).collect()
    assert {r["n"]: r["x"] for r in out} == {n: text for n, (_, text) in enumerate(ends)} | {99: None}
    assert {r["n"] for r in out if r["soon"]} == {1, 2, 3}
    names = spark.createDataFrame([("Best Buy", "home"), (None, "new"), ("one", "na")], "name string, category string")
    assert [tuple(r) for r in names.select(labels.initials("name"), labels.label("category", labels.CATEGORY_LABELS), labels.distance(F.lit(3.14159))).collect()] == [("BB", "Home", "3.1 km"), ("?", "new", "3.1 km"), ("O", "na", "3.1 km")]


def test_places(spark):
    texts = ["m5v 3l9", "P0A", "Halifax", "montreal", "queb", "V", "D1A", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(places.point("t")["label"], places.point("t")["precision"], places.postal_code("t"), places.sortation_area("t")).collect()]
    assert [g[:2] for g in got] == [("Toronto", "fsa"), ("Northern Ontario", "province"), ("Halifax", "city"), ("Montréal", "city"), ("Québec City", "city"), (None, None), (None, None), (None, None), (None, None)]
    assert got[0][2:] == (True, "M5V") and got[2][2:] == (False, None)


def test_an_item_is_parsed_once(spark):
    """A filter on an item's fields must not parse the item again for each field that it names."""
    found = storefronts.hybris(table(spark, "{}"), "https://t.ca", "t.ca")
    filters = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if x.strip(" :+-").startswith("Filter")]
    assert filters and not any("from_json" in x or "get_json_object" in x for x in filters)
