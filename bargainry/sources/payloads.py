"""Payloads to raw listings.

A parser takes a table with the columns source and payload (a whole response per row) and
returns the columns of ``schemas.RAW``.  Parsing is column expressions; only elements of HTML that are
looked for by selectors come from Arrow batches (``selectors``).  A payload that is not what
the parser expects gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_html
from ..schemas import RAW
from .selectors import every, first, select

#: Names of columns that feeds use, by field.
FEED_NAMES = {
    "source_id": ("id", "sku", "g:id", "item_id"),
    "title": ("title", "name", "g:title", "product_name"),
    "url": ("link", "url", "g:link", "product_url"),
    "description": ("description", "g:description"),
    "image_url": ("image_link", "image", "g:image_link", "image_url"),
    "regular": ("price", "g:price", "regular_price", "list_price"),
    "sale": ("sale_price", "g:sale_price", "special_price"),
    "brand": ("brand", "g:brand", "manufacturer"),
    "gtin": ("gtin", "g:gtin", "upc", "ean"),
    "mpn": ("mpn", "g:mpn"),
    "availability": ("availability", "g:availability", "stock"),
    "category_hint": ("product_type", "g:product_type", "category"),
}
#: Marks of shop platforms in a page, the first that occurs counts.
PLATFORMS = (
    ("shopify", r"cdn\.shopify\.com|Shopify\.theme|myshopify\.com"),
    ("sfcc", r"demandware\.(?:static|store)|dwanalytics"),
    ("hybris", r"/_ui/(?:responsive|addons)|yacceleratorstorefront"),
    ("magento", r"Magento_|/static/version\d+/frontend|mage/cookies"),
    ("wordpress", r"/wp-content/|/wp-json/"),
    ("jsonld", r"application/ld\+json"),
)


def as_raw(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of RAW; those not given are null."""
    fields = [f.split() for f in RAW.split(", ")]
    return df.select(*[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def amount(text: Column) -> Column:
    """A number with a decimal point, out of a price as written."""
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"\d+(?:\.\d{1,2})?", 0).try_cast("double")


def _items(payloads: DataFrame, schema: str, path) -> DataFrame:
    parsed = payloads.select("source", F.from_json("payload", schema).alias("x"))
    return parsed.select("source", F.explode(path(F.col("x"))).alias("p"))


# JSON ---------------------------------------------------------------------------------------

_SHOP = """products array<struct<id:string,title:string,handle:string,body_html:string,vendor:string,product_type:string,tags:string,
    published_at:string,options:array<struct<name:string>>,images:array<struct<src:string>>,variants:array<struct<id:string,option1:string,
    option2:string,option3:string,price:string,compare_at_price:string,available:boolean,barcode:string>>>>"""


def shopify(payloads: DataFrame, site: str, on_sale: bool = False) -> DataFrame:
    """The cheapest variant in stock (or of all, if none is).

    Without ``on_sale`` (a collection of markdowns) only variants with a higher price before count.
    """
    df = _items(payloads, _SHOP, lambda x: x["products"])
    priced = F.filter("p.variants", lambda v: amount(v["price"]).isNotNull())
    df = df.withColumn("all", priced).withColumn("live", F.filter("all", lambda v: F.coalesce(v["available"], F.lit(True))))
    pool = F.when(F.size("live") > 0, F.col("live")).otherwise(F.col("all"))
    best = F.array_min(F.transform(pool, lambda v, i: F.struct(amount(v["price"]).alias("price"), i.alias("i"), v.alias("v"))))
    df = df.withColumn("best", best).where("best is not null")
    before = amount(F.col("best.v.compare_at_price"))
    df = df.withColumn("was", F.when(before > F.col("best.price"), before))
    if not on_sale:
        df = df.where("was is not null")
    place = F.array_position(F.transform("p.options", lambda o: F.coalesce(o["name"].rlike("(?i)size|taille"), F.lit(False))), True)
    sizes = F.transform("live", lambda v: F.when(place == 1, v["option1"]).when(place == 2, v["option2"]).when(place == 3, v["option3"]))
    tags = F.transform(F.split(F.lower(F.coalesce("p.tags", F.lit(""))), r"[\[\],\"]+"), lambda t: F.trim(t))
    department = F.filter(tags, lambda t: t.isin("women", "men", "girls", "boys", "baby", "unisex"))
    return as_raw(
        df, source=F.col("source"), source_id=F.col("p.id"), title=F.col("p.title"), url=F.concat(F.lit(f"{site}/products/"), "p.handle"),
        description=strip_html("p.body_html"), image_url=F.get("p.images", F.lit(0))["src"], price=F.col("best.price"), price_was=F.col("was"),
        brand=F.col("p.vendor"), gtin=F.col("best.v.barcode"), category_hint=F.col("p.product_type"), department_hint=F.get(department, F.lit(0)),
        in_stock=F.size("live") > 0, sizes_available=F.array_distinct(F.array_compact(sizes)), posted_at=F.col("p.published_at"),
    )


_SEARCH = """products array<struct<sku:string,name:string,salePrice:double,regularPrice:double,isOnSale:boolean,images:string,productUrl:string,
    brandName:string,modelNumber:string,categoryName:string,availability:struct<onlineAvailability:string,isAvailableOnline:boolean>>>"""


def retailer_search(payloads: DataFrame, site: str) -> DataFrame:
    """Items on sale, or with a regular price above the sale price."""
    df = _items(payloads, _SEARCH, lambda x: x["products"]).select("source", "p.*").where("salePrice is not null and (coalesce(isOnSale, false) or regularPrice > salePrice)")
    stock = F.coalesce(F.col("availability.isAvailableOnline"), F.lower("availability.onlineAvailability") == "instock")
    return as_raw(
        df, source=F.col("source"), source_id=F.col("sku"), title=F.col("name"), url=resolve(F.lit(site), F.col("productUrl")), price=F.col("salePrice"),
        price_was=F.when(F.col("regularPrice") > F.col("salePrice"), F.col("regularPrice")), brand=F.col("brandName"), mpn=F.col("modelNumber"),
        category_hint=F.col("categoryName"), in_stock=stock,
    )


_TOPICS = """topics array<struct<topic_id:string,title:string,web_path:string,post_time:string,offer:struct<dealer_name:string,price:string,
    list_price:string,url:string,expires_at:string,expired:boolean>,votes:struct<total_up:bigint,total_down:bigint>>>"""


def forum(payloads: DataFrame, site: str) -> DataFrame:
    """Topics with an offer that is not over; votes are up less down, 0 at least."""
    df = _items(payloads, _TOPICS, lambda x: x["topics"]).select("source", "p.*")
    df = df.where("offer is not null and not coalesce(offer.expired, false)").where(~F.coalesce(F.col("title"), F.lit("")).rlike(r"(?i)\[?\bexpired\b"))
    votes = F.greatest(F.lit(0), F.coalesce("votes.total_up", F.lit(0)) - F.coalesce("votes.total_down", F.lit(0)))
    return as_raw(
        df, source=F.col("source"), source_id=F.col("topic_id"), title=F.col("title"), url=F.coalesce(F.nullif("offer.url", F.lit("")), resolve(F.lit(site), F.col("web_path"))),
        price=F.col("offer.price"), price_was=F.col("offer.list_price"), merchant_name=F.col("offer.dealer_name"), posted_at=F.col("post_time"),
        expires_at=F.col("offer.expires_at"), votes=votes,
    )


_MAGENTO = """data struct<products:struct<items:array<struct<name:string,sku:string,url_key:string,url_suffix:string,small_image:struct<url:string>,
    short_description:struct<html:string>,categories:array<struct<name:string>>,price_range:struct<minimum_price:struct<regular_price:struct<value:double>,
    final_price:struct<value:double>>>>>>>"""


def magento(payloads: DataFrame, site: str) -> DataFrame:
    """Items whose final price is below the regular one."""
    df = _items(payloads, _MAGENTO, lambda x: x["data"]["products"]["items"]).select("source", "p.*", "p.price_range.minimum_price.*")
    df = df.where("final_price.value < regular_price.value")
    return as_raw(
        df, source=F.col("source"), source_id=F.col("sku"), title=F.col("name"), url=F.concat(F.lit(f"{site}/"), "url_key", F.coalesce("url_suffix", F.lit(""))),
        description=strip_html("short_description.html"), image_url=F.col("small_image.url"), price=F.col("final_price.value"), price_was=F.col("regular_price.value"),
        category_hint=F.array_join(F.array_distinct("categories.name"), " "),
    )


# HTML ---------------------------------------------------------------------------------------


def resolve(base: Column, link: Column) -> Column:
    """The absolute form of a link found on ``base``."""
    origin, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), link))
    )


def links(html: Column, base: Column) -> Column:
    """The absolute targets of a page's anchors, each once, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda x: ~x.rlike("(?i)^(?:javascript|mailto|tel):")), lambda x: resolve(base, F.trim(x))))


def platform(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, mark in reversed(PLATFORMS):
        out = F.when(html.rlike(mark), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


_NODE = "array<struct<`@type`:string,name:string,description:string,image:string,brand:string,gtin13:string,gtin12:string,gtin14:string,gtin8:string,gtin:string,mpn:string,sku:string,offers:string,hasVariant:string>>"
_OFFER = "array<struct<price:string,lowPrice:string,priceCurrency:string,availability:string>>"


def json_ld_nodes(html: Column) -> Column:
    """The nodes of every JSON-LD block: one object, a list, or a graph; others are left out."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    empty = F.from_json(F.lit("[]"), _NODE)
    parsed = F.transform(blocks, lambda b: F.concat(F.coalesce(F.from_json(b, _NODE), empty), F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), _NODE), empty)))
    return F.flatten(parsed)


def product_page(pages: DataFrame) -> DataFrame:
    """(source, url, payload) to the product that the page is about; never with a price before.

    Its offer is the cheapest in stock, among its own and its variants'; pages without
    JSON-LD fall back on their OpenGraph tags.
    """
    products = F.filter(json_ld_nodes(F.col("payload")), lambda n: n["@type"].rlike(r"^\W*Product(?:Group)?\W*$") & n["name"].isNotNull())

    def offers(n: Column) -> Column:
        texts = F.concat(F.array(n["offers"]), F.coalesce(F.from_json(n["hasVariant"], "array<struct<offers:string>>")["offers"], F.array().cast("array<string>")))
        listed = F.flatten(F.transform(F.array_compact(texts), lambda o: F.from_json(o, _OFFER)))
        return F.array_min(
            F.transform(
                F.filter(listed, lambda o: amount(F.coalesce(o["price"], o["lowPrice"])).isNotNull()),
                lambda o: F.struct(F.coalesce(o["availability"].rlike("(?i)OutOfStock|SoldOut|Discontinued"), F.lit(False)).alias("out"), amount(F.coalesce(o["price"], o["lowPrice"])).alias("price"), o["priceCurrency"].alias("currency")),
            )
        )

    df = pages.select("source", "url", "payload", F.get(products, F.lit(0)).alias("n"))
    df = df.withColumn("o", offers(F.col("n")))

    def meta(name: str) -> Column:
        after = F.regexp_extract("payload", rf"(?is)<meta[^>]*property\s*=\s*[\"']{name}[\"'][^>]*content\s*=\s*[\"']([^\"']*)", 1)
        before = F.regexp_extract("payload", rf"(?is)<meta[^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*property\s*=\s*[\"']{name}[\"']", 1)
        return F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")))

    title = F.coalesce(F.when(F.col("o").isNotNull(), F.col("n.name")), meta("og:title"))
    price = F.coalesce("o.price", amount(F.coalesce(meta("product:price:amount"), meta("og:price:amount"))))
    brand = F.coalesce(F.get_json_object("n.brand", "$.name"), F.when(~F.col("n.brand").startswith("{"), F.col("n.brand")))
    image = F.regexp_extract(F.col("n.image"), r"(https?:)?//[^\"\s\],}]+", 0)
    out = df.withColumn("title", title).withColumn("price", price).where("title is not null and price is not null")
    return as_raw(
        out, source=F.col("source"), source_id=F.coalesce("n.sku", F.sha1("url")), title=F.col("title"), url=F.col("url"), description=strip_html("n.description"),
        image_url=F.coalesce(F.nullif(image, F.lit("")), meta("og:image")), price=F.col("price"), currency=F.col("o.currency"), brand=brand,
        gtin=F.coalesce("n.gtin13", "n.gtin12", "n.gtin14", "n.gtin8", "n.gtin"), mpn=F.col("n.mpn"), in_stock=~F.coalesce("o.out", F.lit(False)),
    )


def selected_links(pages: DataFrame, selector: str) -> DataFrame:
    """source, url, place, link: the absolute targets of the elements that a selector finds on a page, each once, in order."""
    found = select(pages, "payload", None, {"found": every(selector)}, ("source", "url"))
    targets = F.transform("found", lambda m: F.nullif(F.try_element_at(m["attributes"], F.lit("href")), F.lit("")))
    targets = F.array_distinct(F.transform(F.array_compact(targets), lambda x: resolve(F.col("url"), F.trim(x))))
    return found.select("source", "url", F.posexplode(targets).alias("place", "link"))


#: Where a page of in-store clearance has its items and their fields, if the caller gives no other selectors.
CLEARANCE = {
    "row": "table tbody tr, .clearance-item", "title": ".item-name, td:nth-child(1)", "price": ".clearance-price, td:nth-child(2)", "regular": ".regular-price, td:nth-child(3)",
    "quantity": ".qty, td:nth-child(4)", "aisle": ".aisle, td:nth-child(5)", "link": "a",
}
#: Sites of the chains whose stores have such pages.
CHAIN_SITES = {
    "canadian-tire": "canadiantire.ca", "sportchek": "sportchek.ca", "walmart": "walmart.ca", "best-buy": "bestbuy.ca", "home-depot": "homedepot.ca", "marks": "marks.com", "atmosphere": "atmosphere.ca",
}


def clearance_items(pages: DataFrame, keep: tuple[str, ...], selectors: dict[str, str] | None = None) -> DataFrame:
    """``keep``, place, and title, price, regular, quantity, aisle (texts, null if empty) and link of each item whose title has 3 characters.

    ``selectors`` replaces those of CLEARANCE that it names; a field whose selector is None stays null.
    """
    known = CLEARANCE | (selectors or {})
    fields = {f"f_{name}": first(s) for name, s in known.items() if name != "row" and s}
    rows = select(pages, "payload", known["row"], fields, keep)
    match = {name: F.get(f"f_{name}", F.lit(0)) if f"f_{name}" in fields else None for name in CLEARANCE}
    null = F.lit(None).cast("string")
    text = [F.nullif(F.regexp_replace(m["text"], r"^\s+|\s+$", ""), F.lit("")).alias(n) if m is not None else null.alias(n) for n, m in match.items() if n not in ("row", "link")]
    link = F.try_element_at(match["link"]["attributes"], F.lit("href")) if match["link"] is not None else null
    return rows.select(*keep, "place", *text, link.alias("link")).where(F.length("title") >= 3)


def clearance(pages: DataFrame, site: str, selectors: dict[str, str] | None = None) -> DataFrame:
    """Items of in-store tables, any row being one: title, clearance price, regular price, quantity (its first number), aisle."""
    rows = clearance_items(pages, ("source",), {"row": "tr, .clearance-item"} | (selectors or {}))
    quantity = F.regexp_extract("quantity", r"\d+", 0).try_cast("int")
    note = F.concat_ws(" · ", F.concat(quantity.cast("string"), F.lit(" in stock")), F.concat(F.lit("Aisle "), F.col("aisle")))
    return as_raw(
        rows, source=F.col("source"), source_id=F.sha1(F.concat_ws("|", F.coalesce("link", F.lit("")), "title")), title=F.col("title"), url=resolve(F.lit(site), F.coalesce("link", F.lit(""))),
        price=F.col("price"), price_was=F.col("regular"), in_stock=F.coalesce(quantity > 0, F.lit(False)), stock_note=note,
    )


def store_clearance(pages: DataFrame, base: str = "https://stocktrack.ca", path: str = "/clearance/{storeId}", selectors: dict[str, str] | None = None) -> DataFrame:
    """Clearance of the stores whose pages these are (source, store_id, chain, payload), as a run's pool of it.

    A listing is its store's and its title's; without an absolute link it leads to the store's page.
    """
    rows = clearance_items(pages, ("source", "store_id", "chain"), selectors)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    page = F.replace(F.lit(base.rstrip("/") + path), F.lit("{storeId}"), F.url_encode("store_id"))
    sites = F.create_map(*[F.lit(x) for pair in CHAIN_SITES.items() for x in pair])
    note = F.concat_ws(" · ", F.concat("quantity", F.lit(" in stock")), F.concat(F.lit("Aisle "), F.col("aisle")))
    return as_raw(
        rows, source=F.col("source"), source_id=F.concat("store_id", F.lit(":"), slug), title=F.col("title"), url=F.when(F.col("link").startswith("http"), F.col("link")).otherwise(page),
        price=F.col("price"), price_was=F.col("regular"), currency=F.lit("CAD"), merchant_domain=F.coalesce(F.try_element_at(sites, F.col("chain")), F.lit("stocktrack.ca")),
        store_id=F.col("store_id"), in_stock=~F.coalesce(F.col("quantity").rlike(r"^0\b"), F.lit(False)), stock_note=F.nullif(note, F.lit("")),
    )


# XML and delimited text ---------------------------------------------------------------------


def rss(payloads: DataFrame) -> DataFrame:
    """Items of a feed; those marked as expired are left out.  A body in the content namespace counts before a description."""
    fields = {"f": first("title", "link", "guid", "pubDate", "content|encoded", "description", "dc|date")}
    items = select(payloads, "payload", "item", fields, ("source",), xml=True)
    title, link, guid, day, body, summary, date = (F.trim(F.get("f", F.lit(i))["text"]) for i in range(7))
    filled = lambda c: F.nullif(c, F.lit(""))
    df = items.select("source", title.alias("title"), link.alias("url"), guid.alias("guid"), F.coalesce(filled(day), filled(date)).alias("at"), F.coalesce(filled(body), summary, F.lit("")).alias("text"))
    df = df.where(~F.col("title").rlike(r"(?i)\bexpired\b") & (F.col("title") != ""))
    return as_raw(
        df, source=F.col("source"), source_id=F.coalesce(filled(F.col("guid")), F.col("url")), title=F.col("title"), url=F.col("url"), description=strip_html("text"), posted_at=F.col("at"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header; a tab in its first line makes it tab-separated."""
    first = spark.read.text(path).first()
    tabbed = first is not None and "\t" in first[0]
    df = spark.read.csv(path, header=True, sep="\t" if tabbed else ",", quote='"', escape='"', multiLine=True)
    return df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])


def feed(rows: DataFrame, source: str) -> DataFrame:
    """Rows of a feed whose sale price is below the regular one."""

    def field(name: str) -> Column:
        known = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in FEED_NAMES[name] if c in rows.columns]
        return F.coalesce(*known) if known else F.lit(None).cast("string")

    df = rows.select(*[field(n).alias(n) for n in FEED_NAMES]).withColumn("now", amount(F.col("sale"))).withColumn("was", amount(F.col("regular"))).where("now < was")
    stock = ~F.coalesce(F.col("availability").rlike("(?i)out[ _]?of[ _]?stock|sold ?out"), F.lit(False))
    rest = {n: F.col(n) for n in ("source_id", "title", "url", "description", "image_url", "brand", "gtin", "mpn", "category_hint")}
    return as_raw(df, source=F.lit(source), price=F.col("now"), price_was=F.col("was"), in_stock=stock, **rest)
