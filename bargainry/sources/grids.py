"""Product grids, offer lists, product APIs, and the pages that lead to them.

As in ``payloads``: source and payload in, the columns of RAW out.  A listing that occurs
more than once counts where it comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import registrable_domain
from .payloads import as_raw, resolve
from .selectors import around, every, first, select
from .storefronts import _filled, _first, _found

# A grid's tiles, prices and names, in the order that they are tried.
TILES = (".product-tile", ".product[data-pid]", ".grid-tile", ".product-grid-tile")
SALE_PRICES = (".sales .value", ".price-sales .value", ".sales")
LIST_PRICES = (".strike-through .value", ".price-standard .value", ".list .value", ".strike-through")
NAMES = (".pdp-link a", ".link", ".product-name a", ".name-link", ".product-name-link", ".tile-body a")
NO_NAMES = "quickview|swatch|wishlist|compare|quick-view|colou?r"
SOLD_OUT = "(?i)out of stock|sold out|épuisé"
#: What the handle of a sale collection and the path of a sale page contain.
SALE_HANDLE = r"(?i)sale|clearance|outlet|markdown|final-?sale|last-chance|promo|deals?\b"
SALE_PATH = r"(?i)\b(sale|clearance|outlet|deals|markdown|solde|liquidation)\b"
SALE_LINK = "sale|clearance|outlet|markdown|final|last-chance"


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _attribute(match: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(match["attributes"], F.lit(name)), F.lit(""))


def _number(match: Column) -> Column:
    """A price above 0: the content attribute, else the text, a lone comma being a decimal point."""
    written = F.regexp_replace(match["text"], r"[^\d.,]", "")
    plain = F.when(written.contains(",") & ~written.contains("."), F.regexp_replace(written, "^([^,]*),", "$1.")).otherwise(written)
    numbers = [_attribute(match, "content").try_cast("double"), F.replace(plain, F.lit(","), F.lit("")).try_cast("double")]
    return F.coalesce(*[F.when((n > 0) & (n < float("inf")), n) for n in numbers])


def _present(matches: str) -> Column:
    return F.filter(matches, lambda m: m.isNotNull())


def _price(matches: str) -> Column:
    """The price of the first selector that gives one."""
    return F.get(F.filter(F.transform(_present(matches), _number), lambda n: n.isNotNull()), F.lit(0))


def _named() -> Column:
    """struct(title, href) of the tile's product: of a known name, else of the first anchor that reads like one, else of a name or picture."""
    named = F.get(_present("names"), F.lit(0))
    any_link = F.get(F.filter(F.transform("anchors", lambda a: _attribute(a, "href")), lambda x: x.isNotNull()), F.lit(0))
    href = F.coalesce(_attribute(named, "href"), any_link)
    reads = F.get(F.filter("anchors", lambda a: _clean(a["text"]).isNotNull() & ~F.coalesce(_attribute(a, "class"), F.lit("")).rlike("(?i)" + NO_NAMES)), F.lit(0))
    title = _clean(named["text"])
    other = F.when(reads.isNotNull(), F.struct(_clean(reads["text"]).alias("title"), _attribute(reads, "href").alias("href"))).otherwise(
        F.struct(F.coalesce(_clean(F.get("below", F.lit(0))["text"]), _clean(_attribute(F.get("picture", F.lit(0)), "alt"))).alias("title"), href.alias("href"))
    )
    return F.when(title.isNotNull(), F.struct(title.alias("title"), href.alias("href"))).otherwise(other)


def grid(payloads: DataFrame, site: str, domain: str, name: str | None = None, department: str | None = None) -> DataFrame:
    """Tiles of a product grid (a page or a fragment of one) with a sale price below the list price.

    A product's id is the tile's, or that of an element inside, or around it.
    """
    fields = {"inside": first("[data-pid]"), "outside": around("[data-pid]"), "names": first(*NAMES), "anchors": every("a[href]"), "below": first(".product-name"), "picture": first("img[alt]")}
    fields |= {"sale": first(*SALE_PRICES), "list": first(*LIST_PRICES), "image": first("img"), "label": first(".product-brand, .brand")}
    df = select(payloads, "payload", ", ".join(TILES), fields, ("source", "payload"))
    df = df.withColumn("place", F.struct("place", F.xxhash64("payload"))).drop("payload")
    ids = (F.col("row"), F.get("inside", F.lit(0)), F.get("outside", F.lit(0)))
    df = df.withColumns({"n": _named(), "pid": F.coalesce(*[_attribute(m, "data-pid") for m in ids])}).where("n.title is not null and n.href is not null")
    df = df.withColumns({"url": resolve(F.lit(site + "/"), F.col("n.href")), "now": _price("sale"), "before": _price("list")})
    df = _first(df.where("before > now").drop("names", "anchors", "inside", "outside", "sale", "list"), "source", "url")
    image = F.get("image", F.lit(0))
    return as_raw(
        df, source=F.col("source"), source_id=F.concat(F.lit(f"{domain}:"), F.coalesce("pid", "url")), title=F.col("n.title"), url=F.col("url"),
        image_url=resolve(F.lit(site + "/"), F.coalesce(*[_attribute(image, a) for a in ("data-src", "data-original", "src")])), price=F.col("now"), price_was=F.col("before"),
        currency=F.lit("CAD"), merchant_domain=F.lit(domain), merchant_name=F.lit(name), department_hint=F.lit(department), brand=_clean(F.get("label", F.lit(0))["text"]), mpn=F.col("pid"),
        in_stock=~F.col("row.text").rlike(SOLD_OUT),
    )


# JSON ---------------------------------------------------------------------------------------

_OFFER = ", ".join(
    f"{c} string"
    for c in "productId id sku name title currentPrice price salePrice wasPrice listPrice regularPrice originalPrice url productUrl image thumbnailUrl brand upc gtin availabilityStatus".split()
)


def _amount(*names: str) -> Column:
    """The first of the fields that is a price above 0: a number, a text, or an object around one."""
    found = []
    for c in names:
        for text in (F.when(~F.col(c).startswith("{"), F.col(c)), *[F.get_json_object(c, f"$.{k}") for k in ("value", "amount", "price")]):
            number = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
            found.append(F.when(number > 0, number))
    return F.coalesce(*found)


def offer_list(payloads: DataFrame, site: str, domain: str, name: str | None = None, page: str = "/en/ip/") -> DataFrame:
    """Offers, wherever in the payload their list is (six levels deep), with a price below the one before."""
    df = _found(payloads, ("offers", "products", "items", "results"), 6, False, _OFFER)
    text = lambda *names: F.coalesce(*[_filled(c) for c in names])
    df = df.withColumns({"key": text("productId", "id", "sku"), "label": text("name", "title"), "now": _amount("currentPrice", "price", "salePrice")})
    df = df.withColumn("before", _amount("wasPrice", "listPrice", "regularPrice", "originalPrice")).where("key is not null and label is not null and before > now")
    df = _first(df.drop("id"), "source", "key")
    link = F.coalesce(_filled("url"), _filled("productUrl"), F.concat(F.lit(page), "key"))
    return as_raw(
        df, source=F.col("source"), source_id=F.concat(F.lit(f"{domain}:"), "key"), title=F.col("label"), url=F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(site), link)),
        image_url=text("image", "thumbnailUrl"), price=F.col("now"), price_was=F.col("before"), currency=F.lit("CAD"), merchant_domain=F.lit(domain), merchant_name=F.lit(name),
        brand=_filled("brand"), gtin=text("upc", "gtin"), in_stock=F.coalesce(F.col("availabilityStatus") != "OUT_OF_STOCK", F.lit(True)),
    )


_NAMED = "struct<DisplayValue:string>"
_API = f"""SearchResult struct<Items:array<struct<ASIN:string,DetailPageURL:string,Images:struct<Primary:struct<Large:struct<URL:string>>>,
    ItemInfo:struct<Title:{_NAMED},ByLineInfo:struct<Brand:{_NAMED}>>,BrowseNodeInfo:struct<BrowseNodes:array<struct<DisplayName:string>>>,
    Offers:struct<Listings:array<struct<Price:struct<Amount:double,Currency:string>,SavingBasis:struct<Amount:double>,Availability:struct<Type:string>>>>>>>"""


def product_api(payloads: DataFrame, market: str, domain: str, name: str) -> DataFrame:
    """Items whose first listing is cheaper than its saving basis."""
    parsed = payloads.select("source", F.from_json("payload", _API)["SearchResult"]["Items"].alias("items"))
    df = parsed.select("source", F.explode("items").alias("p")).withColumn("l", F.get("p.Offers.Listings", F.lit(0)))
    df = df.where("p.ASIN is not null and p.ItemInfo.Title.DisplayValue is not null and l.SavingBasis.Amount > l.Price.Amount")
    return as_raw(
        df, source=F.col("source"), source_id=F.concat(F.lit("paapi:"), "p.ASIN"), title=F.col("p.ItemInfo.Title.DisplayValue"),
        url=F.coalesce("p.DetailPageURL", F.concat(F.lit(f"https://{market}/dp/"), "p.ASIN")), image_url=F.col("p.Images.Primary.Large.URL"), price=F.col("l.Price.Amount"),
        price_was=F.col("l.SavingBasis.Amount"), currency=F.coalesce("l.Price.Currency", F.lit("CAD")), merchant_domain=F.lit(domain), merchant_name=F.lit(name), asin=F.col("p.ASIN"),
        brand=F.col("p.ItemInfo.ByLineInfo.Brand.DisplayValue"), category_hint=F.get("p.BrowseNodeInfo.BrowseNodes", F.lit(0))["DisplayName"],
        in_stock=F.coalesce(F.col("l.Availability.Type") != "OutOfStock", F.lit(True)),
    )


def categories(payloads: DataFrame) -> DataFrame:
    """source, uid, url_key of a shop's categories that hold products."""
    kind = "data struct<categoryList:array<struct<uid:string,url_key:string,product_count:bigint>>>"
    rows = payloads.select("source", F.explode(F.from_json("payload", kind)["data"]["categoryList"]).alias("c"))
    return rows.where("coalesce(c.product_count, 1) > 0").select("source", "c.uid", F.coalesce("c.url_key", "c.uid").alias("url_key"))


# Ways in --------------------------------------------------------------------------------------


def sale_collections(payloads: DataFrame, most: int = 8, tried: DataFrame | None = None) -> DataFrame:
    """source, handle, place: a shop's sale collections, short handles first, without those ``tried`` (source, handle)."""
    rows = payloads.select("source", F.explode(F.from_json("payload", "collections array<struct<handle:string>>")["collections"]).alias("c")).select("source", "c.handle")
    rows = rows.where(F.col("handle").rlike(SALE_HANDLE))
    if tried is not None:
        rows = rows.join(tried.select("source", "handle").distinct(), ["source", "handle"], "left_anti")
    return capped(rows, "source", [F.length("handle"), F.col("handle")], most)


def capped(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each value of ``by``, with their place."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def sale_paths(html: Column, base: Column, most: int = 5) -> Column:
    """Paths of the site's own sale pages that a page links to: three parts at most, in order."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    links = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda x: resolve(F.concat(origin, F.lit("/")), x))
    own = F.filter(links, lambda x: x.startswith(F.concat(origin, F.lit("/"))) | (x == origin))
    paths = F.transform(own, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^https?://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/")))
    short = lambda p: F.size(F.filter(F.split(p, "/"), lambda s: s != "")) <= 3
    return F.slice(F.array_distinct(F.filter(paths, lambda p: p.rlike(SALE_PATH) & short(p))), 1, most)


def linked_collections(html: Column, most: int = 6) -> Column:
    """Handles of sale collections that a page links to."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)/collections/([a-z0-9-]+)"), F.lit(1)), lambda x: F.lower(x))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.rlike(SALE_LINK))), 1, most)


#: Names of dealers in a catalogue of retailers at most, as each post is held against each.
MOST_DEALERS = 2000


def same_site(domain: Column, site: Column) -> Column:
    host, target = F.lower(domain), F.lower(site)
    return (host == target) | F.endswith(host, F.concat(F.lit("."), target))


def of_retailer(posts: DataFrame, domain: str, dealers: tuple[str, ...]) -> DataFrame:
    """Posts (RAW) about a retailer: linked to its site, or else by a dealer of one of its names."""
    linked = same_site(F.coalesce("merchant_domain", registrable_domain("url")), F.lit(domain))
    dealer = F.lower(F.coalesce("merchant_name", F.lit("")))
    named = F.lit(False)
    for d in dealers:
        named = named | F.contains(dealer, F.lit(d.lower()))
    return posts.where(F.coalesce(linked, F.lit(False)) | named)


def of_retailers(posts: DataFrame, retailers: DataFrame) -> DataFrame:
    """Posts about any of the retailers (domain, dealers array), which are a catalogue of a few hundred rows.

    A site's own and parent domains are looked up by equality; only names need a scan of the catalogue.
    """
    known = [retailers.select(F.lower("domain").alias("__site")), retailers.select(F.explode("dealers").alias("d")).select(F.lower("d").alias("__dealer"))]
    labels = F.split(F.lower(F.coalesce("merchant_domain", registrable_domain("url"))), r"\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    names = known[1].agg(F.collect_set("__dealer").alias("d")).first()["d"]
    if len(names) > MOST_DEALERS:
        raise ValueError(f"a catalogue has at most {MOST_DEALERS} names of dealers, not {len(names)}")
    named = F.exists(F.array(*map(F.lit, names)).cast("array<string>"), lambda d: F.contains(F.lower(F.coalesce("merchant_name", F.lit(""))), d))
    # by host, so that a post is never joined with itself
    hosts = posts.select(F.array_join(labels, ".").alias("__host"), sites.alias("sites")).where("__host is not null").distinct()
    about = hosts.select("__host", F.explode("sites").alias("__site")).join(known[0].distinct(), "__site").select("__host").distinct().withColumn("__hit", F.lit(True))
    marked = posts.withColumn("__host", F.array_join(labels, ".")).join(about, "__host", "left")
    return marked.where(F.coalesce("__hit", F.lit(False)) | named).drop("__host", "__hit")


def composite(paths: list[tuple[str, DataFrame]], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A retailer's paths in order: listings (RAW) of all, the first path that has an address wins; and the attempts.

    Within a path, the listing wins that comes first by its ``position``, if there is such a
    column, else by its source's id; the files' split has no influence.  The attempts have
    place, path, found (listings of the path) and kept.
    """
    rows = None
    for place, (name, df) in enumerate(paths, 1):
        position = F.col("position").cast("long") if "position" in df.columns else F.lit(None).cast("long")
        told = F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")])
        own = df.withColumns({"source_path": F.lit(name), "__place": F.lit(place), "__at": F.struct(position, "source", "source_id", told)})
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    first = Window.partitionBy(F.lower("url")).orderBy("__place", "__at")
    ranked = rows.withColumn("__rank", F.row_number().over(first))
    tried = rows.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(paths, 1)], "place int, path string")
    counts = ranked.groupBy(F.col("__place").alias("place")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("__rank") == 1).alias("kept"))
    attempts = tried.join(counts, "place", "left").select("place", "path", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("kept", F.lit(0)).alias("kept"))
    kept = ranked.where("__rank = 1")
    if most is not None:
        kept = kept.orderBy("__place", "__at").limit(most)
    return kept.drop("__place", "__at", "__rank"), attempts


#: A warehouse club's paths, in order; its own pages fail most often.
CLUB_PATHS = ("native", "blogs", "forum", "in-store")


def club(pages: DataFrame, blogs: DataFrame, forum: DataFrame, in_store: DataFrame, domain: str, dealers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The composite of a club: product pages, deal blogs, forum posts about it, and its stores' clearance.

    ``in_store`` is the run's pool: the listings that the clearance source has gathered before.
    """
    return composite(list(zip(CLUB_PATHS, (pages, blogs, of_retailer(forum, domain, dealers), of_retailer(in_store, domain, dealers)), strict=True)))
