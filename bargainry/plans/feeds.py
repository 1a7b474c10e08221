"""Queries on parsers: payloads made of parts, a page of one or two listings each, and what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize
from ..sources import grids, payloads
from . import mart
from .more import _expected, _payloads, _shown, _size
from .queries import query

def _key():
    return F.col("p_partkey")


def _n(more: int = 0):
    return (_key() + more).cast("string")


@query("q120_shop_products", "SELECT 'v' || p_partkey AS source_id, trim(p_name) AS title, CAST(p_size AS DOUBLE) AS price, CAST(p_size + 1 AS DOUBLE) AS price_was FROM part WHERE p_partkey % 3 <> 0")
def _shop(spark, sf_dir):
    variant = lambda price, was, live: F.struct(price.alias("price"), was.alias("compare_at_price"), live.alias("available"))
    # the cheapest is sold out; of those in stock one is dearer; every third has no higher price before
    was = F.when(_key() % 3 == 0, _size()).otherwise(_size(1))
    variants = F.array(variant(F.lit("0.5"), F.lit("9.0"), F.lit(False)), variant(_size(), was, F.lit(True)), variant(_size(3), _size(9), F.lit(True)))
    item = F.struct(F.concat(F.lit("v"), _n()).alias("id"), F.col("p_name").alias("title"), F.lit("h").alias("handle"), variants.alias("variants"))
    return _shown(payloads.shopify(_payloads(spark, sf_dir, F.to_json(F.struct(F.array(item).alias("products")))), "https://s.ca"))


@query("q121_retailer_search", _expected("", "p_partkey % 4 <> 0").replace("'' || p_partkey", "CAST(p_partkey AS VARCHAR)").replace("CAST(p_size + 1 AS DOUBLE)", "CASE WHEN p_partkey % 4 <> 1 THEN CAST(p_size + 1 AS DOUBLE) END"))
def _search(spark, sf_dir):
    regular = F.when(_key() % 4 == 0, F.col("p_size")).when(_key() % 4 == 1, F.col("p_size")).otherwise(F.col("p_size") + 1)
    item = F.struct(_n().alias("sku"), F.col("p_name").alias("name"), F.col("p_size").alias("salePrice"), regular.alias("regularPrice"), (_key() % 4 == 1).alias("isOnSale"), F.lit("/p").alias("productUrl"))
    return _shown(payloads.retailer_search(_payloads(spark, sf_dir, F.to_json(F.struct(F.array(item).alias("products")))), "https://r.ca"))


@query("q122_forum_topics", "SELECT CAST(p_partkey AS VARCHAR) AS source_id, trim(p_name) AS title, greatest(0, p_size - 10)::DOUBLE AS votes, CASE WHEN p_partkey % 5 = 1 THEN 'https://f.ca/t/1' ELSE 'https://x.ca/o' END AS url FROM part WHERE p_partkey % 5 > 0 AND p_partkey % 7 > 0 AND p_partkey % 11 > 0")
def _forum(spark, sf_dir):
    offer = F.when(_key() % 5 > 0, F.struct(F.when(_key() % 5 > 1, "https://x.ca/o").alias("url"), (_key() % 7 == 0).alias("expired"), F.lit("5").alias("price")))
    title = F.when(_key() % 11 == 0, F.concat(F.lit("[EXPIRED] "), "p_name")).otherwise(F.col("p_name"))
    topic = F.struct(_n().alias("topic_id"), title.alias("title"), F.lit("/t/1").alias("web_path"), offer.alias("offer"), F.struct(F.col("p_size").alias("total_up"), F.lit(10).alias("total_down")).alias("votes"))
    return payloads.forum(_payloads(spark, sf_dir, F.to_json(F.struct(F.array(topic).alias("topics")))), "https://f.ca").select("source_id", "title", "votes", "url")


@query("q123_magento_products", _expected("", "p_partkey % 2 = 1").replace("'' || p_partkey", "CAST(p_partkey AS VARCHAR)"))
def _magento(spark, sf_dir):
    price = F.struct(F.struct(F.struct((F.col("p_size") + _key() % 2).alias("value")).alias("regular_price"), F.struct(F.col("p_size").alias("value")).alias("final_price")).alias("minimum_price"))
    item = F.struct(F.col("p_name").alias("name"), _n().alias("sku"), F.lit("k").alias("url_key"), price.alias("price_range"))
    page = F.struct(F.struct(F.struct(F.array(item).alias("items")).alias("products")).alias("data"))
    return _shown(payloads.magento(_payloads(spark, sf_dir, F.to_json(page)), "https://m.ca"))


@query("q123b_categories", "SELECT p_partkey || '' AS uid, CASE WHEN p_partkey % 2 = 0 THEN 'k' ELSE p_partkey || '' END AS url_key FROM part WHERE p_partkey % 3 <> 0")
def _categories(spark, sf_dir):
    item = F.struct(_n().alias("uid"), F.when(_key() % 2 == 0, "k").alias("url_key"), F.when(_key() % 3 < 2, _key() % 3).alias("product_count"))
    page = F.struct(F.struct(F.array(item).alias("categoryList")).alias("data"))
    return grids.categories(_payloads(spark, sf_dir, F.to_json(page))).select("uid", "url_key")


@query(
    "q124_product_page",
    """SELECT trim(p_name) AS title, CASE p_partkey % 4 WHEN 0 THEN p_size + 2 ELSE p_size END::DOUBLE AS price, CASE WHEN p_partkey % 4 <> 3 THEN 'B' || p_partkey END AS brand, p_partkey % 4 <> 2 AS in_stock, 'https://p.ca/' || p_partkey AS url FROM part""",
)
def _product(spark, sf_dir):
    offer = lambda price, out: F.struct(price.alias("price"), F.lit("CAD").alias("priceCurrency"), F.when(out, "https://schema.org/OutOfStock").otherwise("InStock").alias("availability"))
    offers = F.array(offer(_size(), _key() % 4 % 2 == 0), offer(_size(2), _key() % 4 == 2))
    node = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.concat(F.lit("B"), _n()).alias("name")).alias("brand"), offers.alias("offers"))
    json = F.to_json(node)
    listed = F.when(_key() % 4 == 1, F.concat(F.lit('{"@graph":['), json, F.lit("]}"))).when(_key() % 4 == 2, F.concat(F.lit('[{"@type":"Thing"},'), json, F.lit("]"))).otherwise(json)
    page = F.concat(F.lit("<html><script type='application/ld+json'>{broken</script><script type=\"application/ld+json\">"), listed, F.lit("</script></html>"))
    graph = F.concat(F.lit('<meta property="og:title" content="'), "p_name", F.lit('"><meta content="'), _size(), F.lit('.00" property="product:price:amount">'))
    pages = mart.parts(spark, sf_dir).select(F.lit("s").alias("source"), F.concat(F.lit("https://p.ca/"), _n()).alias("url"), F.when(_key() % 4 == 3, graph).otherwise(page).alias("payload"))
    return payloads.product_page(pages).select("title", F.col("price").cast("double").alias("price"), "brand", "in_stock", "url")


@query("q125_clearance_table", "SELECT trim(p_name) AS title, p_size::DOUBLE AS price, p_size + 1.0::DOUBLE AS price_was, (p_partkey % 3) || ' in stock · Aisle 7' AS stock_note, p_partkey % 3 > 0 AS in_stock, 'https://t.ca/i/' || p_partkey AS url FROM part")
def _clearance(spark, sf_dir):
    cells = F.concat(F.lit("</a></td><td><b>"), _size(), F.lit(".00</b></td><td>"), _size(1), F.lit("</td><td>"), (_key() % 3).cast("string"), F.lit(" left</td><td>7</td></tr></table>"))
    page = F.concat(F.lit("<table><tr><th>Item</th></tr><tr><td>ab</td><td></td><td></td><td></td></tr><tr class=r><td><a href='/i/"), _n(), F.lit("'>"), F.col("p_name"), cells)
    return payloads.clearance(_payloads(spark, sf_dir, page), "https://t.ca").select("title", F.col("price").cast("double").alias("price"), F.col("price_was").cast("double").alias("price_was"), "stock_note", "in_stock", "url")


@query("q126_rss_items", "SELECT trim(p_name) || ' & <b>' AS title, CASE WHEN p_partkey % 2 = 0 THEN 'g' || p_partkey ELSE 'https://r.ca/' || p_partkey END AS source_id, 'https://r.ca/' || p_partkey AS url FROM part")
def _rss(spark, sf_dir):
    guid = F.when(_key() % 2 == 0, F.concat(F.lit("<guid>g"), _n(), F.lit("</guid>"))).otherwise(F.lit(""))
    title = F.when(_key() % 3 == 0, F.concat(F.lit("<![CDATA["), "p_name", F.lit(" & <b>]]>"))).otherwise(F.concat("p_name", F.lit(" &amp; &lt;b&gt;")))
    feed = F.concat(F.lit("<rss><item><title>Expired: x</title><link>y</link></item><item><title>"), title, F.lit("</title><link>https://r.ca/"), _n(), F.lit("</link>"), guid, F.lit("</item></rss>"))
    return payloads.rss(_payloads(spark, sf_dir, feed)).select("title", "source_id", "url")


@query("q127_delimited_feed", "SELECT CAST(p_partkey AS VARCHAR) AS source_id, trim(p_name) AS title, p_size::DOUBLE AS price, p_size + 1.0::DOUBLE AS price_was, p_partkey % 4 <> 3 AS in_stock FROM part WHERE p_partkey % 2 = 1")
def _feed(spark, sf_dir):
    rows = mart.parts(spark, sf_dir).select(
        _n().alias("g:id"), F.col("p_name").alias("g:title"), F.concat((F.col("p_size") + _key() % 2).cast("string"), F.lit(".00 CAD")).alias("price"), _size().alias("special_price"), F.when(_key() % 4 == 3, "out of stock").otherwise("in stock").alias("availability")
    )
    return payloads.feed(rows, "feed").select("source_id", "title", F.col("price").cast("double").alias("price"), F.col("price_was").cast("double").alias("price_was"), "in_stock")


@query(
    "q128_product_grid",
    """SELECT 's.ca:' || CASE WHEN p_partkey % 5 = 4 THEN 'https://s.ca/p/' || p_partkey ELSE 'P' || p_partkey END AS source_id, trim(p_name) AS title, p_size::DOUBLE AS price, p_size + 1.0::DOUBLE AS price_was,
        'https://s.ca/p/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'Acme' END AS brand, p_partkey % 7 <> 0 AS in_stock FROM part WHERE p_partkey % 11 <> 0""",
)
def _grid(spark, sf_dir):
    href = F.concat(F.lit("<a class='"), F.when(_key() % 5 == 1, "name-link").when(_key() % 5 == 2, "x").otherwise("link y"), F.lit("' href=\"/p/"), _n(), F.lit('">'), F.when(_key() % 5 == 3, F.lit("")).otherwise(F.concat(F.lit(" <b>"), F.col("p_name"), F.lit("</b>\n"))), F.lit("</a>"))
    image = F.concat(F.lit("<img src='/a.png' alt='"), "p_name", F.lit("'>"))
    was = F.when(_key() % 11 == 0, _size()).otherwise(_size(1))
    prices = F.concat(F.lit("<span class='strike-through list'><span class=\"value\" content='"), was, F.lit(".00'>x</span></span><span class='sales'><span class='value'>$"), _size(), F.lit(",00</span></span>"))
    swatch = F.concat(F.lit("<a class='swatch' href='/p/"), _n(), F.lit("'>BLACK</a>"))
    body = F.concat(image, swatch, href, prices, F.when(_key() % 3 == 0, "<i class='product-brand'> Acme </i>").otherwise(""), F.when(_key() % 7 == 0, "<p>Sold out</p>").otherwise("<p>ok</p>"))
    pid = F.concat(F.lit(" data-pid='P"), _n(), F.lit("'"))
    tile = F.when(_key() % 5 == 4, F.concat(F.lit("<div class='grid-tile z'>"), body, F.lit("</div>"))).when(
        _key() % 5 == 0, F.concat(F.lit("<div class=\"product\""), pid, F.lit("><div class='product-tile'>"), body, F.lit("</div></div>"))
    ).otherwise(F.concat(F.lit("<div class='a product-tile b'"), pid, F.lit(">"), body, F.lit("</div>")))
    page = F.concat(F.lit("<html><a href='/'>home</a>"), tile, tile, F.lit("</html>"))
    out = grids.grid(_payloads(spark, sf_dir, page), "https://s.ca", "s.ca")
    return out.select("source_id", "title", F.col("price").cast("double").alias("price"), F.col("price_was").cast("double").alias("price_was"), "url", "brand", "in_stock")


@query("q129_offer_list", _expected("w.ca:", "p_partkey % 4 <> 0"))
def _offers(spark, sf_dir):
    now = F.when(_key() % 3 == 0, F.to_json(F.struct(F.col("p_size").alias("amount")))).when(_key() % 3 == 1, F.concat(F.lit('"$'), _size(), F.lit('.00"'))).otherwise(_size())
    was = F.when(_key() % 4 == 0, _size()).otherwise(_size(1))
    field = F.when(_key() % 2 == 0, "currentPrice").otherwise("salePrice")
    item = F.concat(F.lit('{"id":"'), _n(), F.lit('","name":"'), "p_name", F.lit('","'), field, F.lit('":'), now, F.lit(',"listPrice":'), was, F.lit("}"))
    page = F.concat(F.lit('{"a":{"b":[{"c":{"items":['), item, F.lit(","), item, F.lit("]}}]}}"))
    return _shown(grids.offer_list(_payloads(spark, sf_dir, page), "https://w.ca", "w.ca"))


@query("q130_product_api", _expected("paapi:", "p_partkey % 3 <> 0"))
def _api(spark, sf_dir):
    listing = F.struct(F.struct(F.col("p_size").alias("Amount")).alias("Price"), F.when(_key() % 3 > 0, F.struct((F.col("p_size") + 1).alias("Amount"))).alias("SavingBasis"))
    item = F.struct(_n().alias("ASIN"), F.struct(F.struct(F.col("p_name").alias("DisplayValue")).alias("Title")).alias("ItemInfo"), F.struct(F.array(listing).alias("Listings")).alias("Offers"))
    page = F.struct(F.struct(F.array(item).alias("Items")).alias("SearchResult"))
    return _shown(grids.product_api(_payloads(spark, sf_dir, F.to_json(page)), "www.a.ca", "a.ca", "A"))


_HANDLES = ("sale", "big-sale", "summer", "outlet-x", "deals", "dealsx", "final-sale-a", "clearance", "promo-1", "last-chance", "markdown", "sale-b", "promo-2")


@query(
    "q131_sale_collections",
    f"""SELECT source, handle, place FROM (SELECT source, handle, row_number() OVER (PARTITION BY source ORDER BY length(handle), handle) AS place FROM (SELECT CAST(p_partkey AS VARCHAR) AS source, unnest({list(_HANDLES)}) AS handle FROM part)
        WHERE regexp_matches(handle, 'sale|clearance|outlet|markdown|final-?sale|last-chance|promo|deals?\\b', 'i') AND NOT (handle = 'sale' AND CAST(source AS BIGINT) % 2 = 0)) WHERE place <= 8""",
)
def _collections(spark, sf_dir):
    page = F.to_json(F.struct(F.array(*[F.struct(F.lit(h).alias("handle")) for h in _HANDLES]).alias("collections")))
    pages = mart.parts(spark, sf_dir).select(_n().alias("source"), page.alias("payload"))
    tried = pages.where("cast(source as long) % 2 = 0").select("source", F.lit("sale").alias("handle"))
    return grids.sale_collections(pages, tried=tried)


_HOME = "<a href='/sale'>x</a><a href=\"https://h.ca/Clearance/a?x=1\">y</a><a href='https://o.ca/sale'>z</a><a href='/sale/a/b/c'>deep</a><a href='/sale'>again</a><a href='outlet'>o</a><a href='/wholesale'>no</a><a href='/solde#a'>s</a><a href='/deals'>d</a><a href='/markdown'>m</a><a href='/collections/Big-SALE-1'>c</a><a href='/collections/new'>n</a>"


@query("q132_sale_pages", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/sale,/Clearance/a,/outlet,/solde,/deals' ELSE '' END AS paths, CASE WHEN page_id % 2 = 0 THEN 'big-sale-1' ELSE '' END AS handles FROM pages")
def _sale_pages(spark, sf_dir):
    html = F.when(F.col("page_id") % 2 == 0, F.lit(_HOME)).otherwise(F.lit("<p>none</p>"))
    return mart.table(spark, sf_dir, "pages").select("page_id", F.array_join(grids.sale_paths(html, F.lit("https://h.ca/x/y")), ",").alias("paths"), F.array_join(grids.linked_collections(html), ",").alias("handles"))


def _posts(spark, sf_dir) -> DataFrame:
    link = F.when(_key() % 4 == 0, "https://www.walmart.ca/ip/1").when(_key() % 4 == 1, "https://notwalmart.ca/x").when(_key() % 4 == 2, "https://shop.walmart.ca/x").otherwise("https://forum.ca/t")
    dealer = F.when(_key() % 3 == 0, "The WALMART Store").when(_key() % 3 == 1, "Costco")
    return payloads.as_raw(mart.parts(spark, sf_dir), source=F.lit("forum"), source_id=_n(), title=F.col("p_name"), url=link, merchant_name=dealer)


_ABOUT = "p_partkey % 4 IN (0, 2) OR p_partkey % 3 = 0"


@query("q133_posts_of_retailer", f"SELECT CAST(p_partkey AS VARCHAR) AS source_id FROM part WHERE {_ABOUT}")
def _of_retailer(spark, sf_dir):
    return grids.of_retailer(_posts(spark, sf_dir), "walmart.ca", ("walmart",)).select("source_id")


@query("q133b_posts_of_retailers", f"SELECT CAST(p_partkey AS VARCHAR) AS source_id FROM part WHERE {_ABOUT} OR p_partkey % 3 = 1 OR p_partkey % 4 = 3")
def _of_retailers(spark, sf_dir):
    known = spark.createDataFrame([("walmart.ca", ["walmart"]), ("costco.ca", ["Costco"]), ("Forum.ca", [])], "domain string, dealers array<string>")
    return grids.of_retailers(_posts(spark, sf_dir), known).select("source_id")


def _club(spark, sf_dir):
    rows = mart.parts(spark, sf_dir)
    own = lambda condition, source: payloads.as_raw(rows.where(condition), source=F.lit(source), source_id=_n(), url=F.concat(F.when(F.lit(source == "blog"), "HTTPS://c.ca/").otherwise("https://c.ca/"), _n()), merchant_name=F.lit("Costco"))
    return grids.club(own("p_partkey % 7 = 0", "page"), own("p_partkey % 3 = 0", "blog"), own("p_partkey % 2 = 0", "forum"), own("false", "store"), "c.ca", ("costco",))


@query("q134_club_listings", "SELECT CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_partkey % 7 = 0 THEN 'native' WHEN p_partkey % 3 = 0 THEN 'blogs' ELSE 'forum' END AS source_path FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def _club_listings(spark, sf_dir):
    return _club(spark, sf_dir)[0].select("source_id", "source_path")


@query(
    "q134b_club_attempts",
    """SELECT 1 AS place, 'native' AS path, count_if(p_partkey % 7 = 0) AS found, count_if(p_partkey % 7 = 0) AS kept FROM part UNION ALL SELECT 2, 'blogs', count_if(p_partkey % 3 = 0), count_if(p_partkey % 3 = 0 AND p_partkey % 7 <> 0) FROM part
       UNION ALL SELECT 3, 'forum', count_if(p_partkey % 2 = 0), count_if(p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0) FROM part UNION ALL SELECT 4, 'in-store', 0, 0""",
)
def _club_attempts(spark, sf_dir):
    return _club(spark, sf_dir)[1]


@query(
    "q135_validation",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'url is missing' WHEN 1 THEN 'title is missing' WHEN 2 THEN 'source_id is missing' WHEN 3 THEN 'title is missing' END AS drop_reason FROM part""",
)
def _validation(spark, sf_dir):
    fields = {n: F.lit("x") for n in ("url", "title", "source_id")}
    rows = mart.parts(spark, sf_dir).select(
        "p_partkey", F.when(~(_key() % 5).isin(0, 3), fields["url"]).alias("url"), F.when(_key() % 5 == 1, "").when(_key() % 5 == 3, None).otherwise("x").alias("title"), F.when(_key() % 5 != 2, "x").alias("source_id")
    )
    return normalize.validate(rows).select("p_partkey", "drop_reason")


