import pytest
from pyspark.sql import functions as F

from bargainry.functions import rules, scalars, text


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


MONEY = {
    "$1,299.99": 129999, "1 299,99 $": 129999, "1.299,99 €": 129999, "1299": 129900, "CAD 5": 500, "free": 0, "Gratuit": 0, "$0": 0,
    "19,99": 1999, "1,234": 123400, "1.234": 123400, "30 for 2": 3000, "12/31/2024": None, "2024-01-02": None, "rtx4070": None, "": None,
    "call us": None, "-5.00": None, "99999999": None, "$19.9": 1990, None: None, "12,345,678.90": None, "1,234,567.50": 123456750,
}


def test_price_to_cents(spark):
    assert dict(zip(MONEY, values(spark, scalars.price_to_cents("x"), list(MONEY)), strict=True)) == MONEY


def test_discount(spark):
    rows = [(1999, 3999), (3999, 1999), (10, 1_000_000), (None, 5), (0, 100), (3, 4)]
    df = spark.createDataFrame(rows, "a long, b long").select(scalars.discount("a", "b").alias("d")).collect()
    assert [r.d and (r.d.pct, r.d.abs) for r in df] == [(50.0, 2000), None, None, None, None, (25.0, 1)]


URLS = {
    "http://www.Shop.ca/a/?utm_source=x&b=2&a=1#top": "https://shop.ca/a/?a=1&b=2",
    "https://shop.ca/a/": "https://shop.ca/a",
    "https://shop.ca": "https://shop.ca/",
    "https://shop.ca:443/a?ref=1": "https://shop.ca/a",
    "https://shop.ca:8080/a?": "https://shop.ca:8080/a",
    "https://amazon.ca/dp/B000000000?tag=me-20&x=1": "https://amazon.ca/dp/B000000000?x=1",
    "https://go.redirectingat.com/?url=https%3A%2F%2Fwww.shop.ca%2Fp%3Fgclid%3D1": "https://shop.ca/p",
    "mailto:x@y": "mailto:x@y",
    "not a url": "not a url",
}


def test_canonical_url(spark):
    got = values(spark, text.canonical_url("x"), list(URLS))
    assert dict(zip(URLS, got, strict=True)) == URLS
    assert values(spark, text.canonical_url("x"), got) == got


def test_domain_and_asin(spark):
    assert values(spark, text.registrable_domain("x"), ["https://www.a.b.shop.ca/x", "https://x.on.ca", "http://a.b.co.uk/", "nope"]) == ["shop.ca", "x.on.ca", "b.co.uk", None]
    assert values(spark, text.asin_of("x"), ["https://amazon.ca/dp/b0abcd1234?x", "https://amazon.ca/gp/product/B0ABCD1234", "https://x/?asin=B0ABCD1234", "https://x/"]) == ["B0ABCD1234"] * 3 + [None]


def test_titles(spark):
    assert values(spark, text.clean_title("x"), ["[EXPIRED] LEGO ** set  \U0001f525", "Hot: - TV -", "A"]) == ["LEGO set", "TV", "A"]
    assert values(spark, text.slug("x", F.lit("abcdefghij")), ["Café Déjà Vu!", "???"]) == ["cafe-deja-vu-abcdef", "deal-abcdef"]
    assert values(spark, F.array_join(text.title_tokens("x"), " "), ["The NEW 65 Samsung TV, 4K Télé"]) == ["4k samsung tele tv"]


def test_description(spark):
    long = "word " * 60
    got = values(spark, text.trim_description("x"), ["<b>A &amp; B</b>&nbsp;", "  ", None, long, "&amp;lt;"])
    assert got[:3] == ["A & B", None, None] and got[3] == ("word " * 44).rstrip() + "…" and got[4] == "&lt;"


def test_timestamps(spark):
    rows = ["1700000000", "1700000000000", "2023-11-14T22:13:20Z", "Tue, 14 Nov 2023 22:13:20 GMT", "soon", None]
    got = [str(x) if x else None for x in values(spark, text.timestamp_of("x"), rows)]
    assert got == ["2023-11-14 22:13:20"] * 4 + [None, None]


def test_gtin_and_identity(spark):
    assert values(spark, scalars.gtin_valid("x"), ["4006381333931", "4006381333932", "036000291452", "73513537", "12"]) == [True, False, True, True, False]
    rows = [("TV QN65QN90D", "Samsung", "0036000291452", None, None), ("x", None, None, None, "b0abcd1234"), ("x", "LG!", None, "AB-12", None), ("Samsung QN65QN90D 65in", "Samsung", None, None, None), ("plain words 256GB", None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, brand string, gtin string, mpn string, asin string")
    got = df.select(scalars.identity(*[F.col(c) for c in df.columns]).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in got] == [("gtin:00036000291452", "gtin"), ("asin:B0ABCD1234", "asin"), ("mpn:lg:AB12", "mpn"), ("model:samsung:QN65QN90D", "model"), (None, "none")]


def test_heat(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' as n, timestamp_ntz'2024-01-01 00:00:00' as p")
    got = df.select(scalars.recency_part(F.col("p"), F.col("n")), scalars.recency_part(F.col("n"), F.col("p")), scalars.heat(F.lit(200), F.lit(70.0), F.col("n"), F.lit("redflagdeals"), F.col("n"))).first()
    assert got[0] == 0.5 and got[1] == 1.0 and got[2] == 100.0


def test_haversine(spark):
    km = spark.range(1).select(scalars.haversine_km(F.lit(43.6532), F.lit(-79.3832), F.lit(49.2827), F.lit(-123.1207))).first()[0]
    assert km == pytest.approx(3363, rel=0.01)


CATEGORY = {"LEGO Star Wars set": "toys-games", "Dell laptop 16GB RAM": "computers", "Winter parka coat": "clothing", "Air fryer 5L": "kitchen", "thing": "other", "Samsung 65 OLED TV": "electronics"}


def test_category(spark):
    none = F.lit(None).cast("string")
    assert dict(zip(CATEGORY, values(spark, rules.category(F.col("x"), none, none, none), list(CATEGORY)), strict=True)) == CATEGORY
    assert values(spark, rules.category(F.col("x"), none, F.lit("ikea"), none), ["thing", "Winter parka", "LEGO"]) == ["home", "home", "toys-games"]


def test_department(spark):
    none = F.lit(None).cast("string")
    got = values(spark, rules.department(F.col("x"), none, none, none, F.lit("clothing")), ["Women's coat", "Boys' boots", "Men's tie", "Baby onesie", "Coat"])
    assert got == ["women", "boys", "men", "baby", "unisex"]
    assert values(spark, rules.department(F.lit("coat"), none, F.col("x"), F.lit("moores"), F.lit("other")), ["Girls", "zzz"]) == ["girls", "men"]


def test_brand(spark):
    assert values(spark, rules.brand("x"), ["The North Face Columbia jacket", "Applesauce", "apple watch", "La Roche-Posay SPF"]) == ["The North Face", None, "Apple", "La Roche-Posay"]


def test_keywords(spark):
    none = F.lit(None).cast("string")
    assert values(spark, rules.keywords(F.col("x"), none, none), ["MARCO Console oak", "Gold hoops", "étagère", "comfortable"]) == [" table ", " earrings jewellery ", " storage ", None]
    prose = F.lit("Straight-leg jeans in a mid rise. Pairs with a sweater.")
    assert values(spark, rules.keywords(F.col("x"), prose, none), ["Fit"]) == [" pants "]


COUPONS = {
    "Save 20% with promo code SAVE20 today": "SAVE20", "use code: winter-24": "WINTER-24", "Enter code HOLIDAY at checkout": "HOLIDAY", "coupon: ABC10": "ABC10",
    "No code needed": None, "use code words carefully": None, "code 123456": None, "model code SM-928W": None, "nothing here": None, None: None,
}


def test_coupon(spark):
    assert dict(zip(COUPONS, values(spark, rules.coupon("x")["code"], list(COUPONS)), strict=True)) == COUPONS
    assert values(spark, rules.coupon("x")["text"], ["Big sale use code SAVE20 now"]) == ["Big sale now"]
