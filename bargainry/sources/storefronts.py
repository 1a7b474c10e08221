"""Payloads of storefront platforms, deal blogs and price trackers to raw listings.

As in ``payloads``, a parser takes source and payload and returns the columns of RAW.  Lists
that hang at an unknown depth are found in variants (``objects_under``); prices, notes and
fields are column expressions.  A listing that occurs more than once counts where it comes
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import coupon
from ..functions.scalars import let, price_to_cents
from ..functions.text import asin_of
from .payloads import as_raw, resolve
from .selectors import first, select

#: Words that mark the price before and the price now in a post.
WAS_WORDS = r"(?i)\b(?:reg|reg\.|regular|regularly|was|orig|orig\.|originally|retail|list|compare|compared at|value|instead of|down from)\b"
NOW_WORDS = r"(?i)\b(?:now|sale|only|just|deal|for)\b|→|->|»"
#: Labels of the current and the previous price in a tracker's feed, in order.
NOW_LABELS = (r"now\s*", r"dropped\s+to\s*", r"\bto\s*")
WAS_LABELS = (r"was\s*", r"previously\s*", r"from\s*", r"regular(?:ly)?\s*")
_MONEY = r"(?:CDN\$|\$|CAD\s?)\s?(\d{1,6}(?:[.,]\d{2})?)"
#: Prices further apart are no pair; so far before a price its label may stand.
GAP, LEAD = 40, 24


def objects_under(payloads: DataFrame, names: tuple[str, ...], depth: int, below: bool) -> DataFrame:
    """source, place, item: the objects (as JSON) in lists with one of the names, at any place of the payload down to a depth.

    Without ``below`` an object that has such a list is not searched further.  Each level is
    an explode of what the one above holds, as variants; places are in the order of a walk
    that takes an object's own lists first, and fields by name.
    """

    def as_map(v: Column) -> Column:
        return F.try_variant_get(v, "$", "map<string,variant>")

    def as_list(v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def node(hit: bool, at: Column, v: Column) -> Column:
        return F.struct(F.lit(hit).alias("hit"), at.alias("at"), v.alias("v"))

    def held(list_: Column, hit: bool, *path: int) -> Column:
        some = F.coalesce(list_, F.array().cast("array<variant>"))
        own = F.transform(some, lambda x, j: node(hit, F.concat("at", F.array(*map(F.lit, path), j)), x))
        return F.filter(own, lambda n: as_map(n["v"]).isNotNull() | (F.lit(not hit) & as_list(n["v"]).isNotNull()))

    def after(alone: Column, beside: Column):
        return lambda mine: F.concat(mine, F.when(F.size(mine) > 0, beside).otherwise(alone))

    start = F.try_parse_json("payload")
    rows = payloads.select("source", node(False, F.array().cast("array<int>"), start).alias("n")).select("source", "n.*").where("v is not null")
    for level in range(depth + 1):
        mine = F.concat(*[held(F.try_variant_get(F.col("v"), f"$.{name}", "array<variant>"), True, 0, i) for i, name in enumerate(names)])
        inner = held(F.coalesce(F.map_values(as_map(F.col("v"))), as_list(F.col("v"))), False, 1)
        none = F.filter(inner, lambda n: F.lit(False))
        deeper = none if level == depth else inner
        going = let(mine, after(deeper, deeper if below else none))
        step = F.when(F.col("hit"), F.array(F.struct("hit", "at", "v"))).otherwise(going)
        rows = rows.select("source", F.explode(step).alias("n")).select("source", "n.*")
    item = F.to_json("v")
    return rows.where("hit").select("source", F.struct("at", F.xxhash64(item)).alias("place"), item.alias("item"))


def _found(payloads: DataFrame, names: tuple[str, ...], depth: int, below: bool, schema: str) -> DataFrame:
    return once(objects_under(payloads, names, depth, below).select("source", "place", "item"), F.from_json("item", schema)).drop("item")


def once(rows: DataFrame, fields: Column) -> DataFrame:
    """Adds the fields of a struct, worked out once a row: a filter on columns moves below a select and works out their expressions for each mention, but not below an explode."""
    return rows.select("*", F.explode(F.array(fields)).alias("__once")).select(*rows.columns, "__once.*")


def _first(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, "place")]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "place").alias("x")).select(*keys, "x.*")


def _filled(c: Column | str) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


# Storefronts --------------------------------------------------------------------------------

_SEARCH = """code string, sku string, title string, name string, url string, currentPrice string, originalPrice string, regularPrice string,
    priceMessage string, promoMessage string, badges string, badge string, offerMessage string, isMemberPrice boolean, memberOnly boolean,
    brand string, categoryPath string, images string, imageUrl string, image string, isAvailable boolean, inStock boolean"""
_BANNERS = ("priceMessage", "promoMessage", "badges", "badge", "offerMessage")


def _paid(c: str) -> Column:
    """A price that is a number, a text or an object around one; only above 0."""
    text = F.coalesce(*[F.get_json_object(c, f"$.{k}") for k in ("value", "amount", "price", "minPrice")], F.col(c))
    number = F.regexp_replace(text, r"[^\d.]", "").try_cast("double")
    return F.when(number > 0, number)


def _said(c: str) -> Column:
    """The messages of a field that is a text, or a list of texts and labelled objects."""
    listed = F.transform(
        F.from_json(c, "array<string>"), lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.label"), F.get_json_object(x, "$.text"))).otherwise(x)
    )
    return F.when(F.col(c).startswith("["), listed).when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))


def hybris(payloads: DataFrame, site: str, domain: str, name: str | None = None) -> DataFrame:
    """Markdowns that anyone gets: an offer for several pieces is a note, a members' price none.

    The price is that of one piece, also where several cost less.
    """
    df = _found(payloads, ("products", "productData", "results"), 6, False, _SEARCH)
    df = once(df, F.struct(
        F.coalesce(_filled("code"), _filled("sku")).alias("id"), F.coalesce(_filled("title"), _filled("name")).alias("label"), _paid("currentPrice").alias("now"),
        F.coalesce(_paid("originalPrice"), _paid("regularPrice")).alias("before"), F.array_compact(F.flatten(F.array(*map(_said, _BANNERS)))).alias("said"),
    ))
    several = F.get(F.filter("said", lambda m: m.rlike(r"(?i)\b\d+\s*(?:for|pour)\s*\$?\d")), F.lit(0))
    members = F.coalesce("isMemberPrice", F.lit(False)) | F.coalesce("memberOnly", F.lit(False)) | F.exists("said", lambda m: m.rlike("(?i)triangle|member|membre"))
    df = df.withColumn("several", several).where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("before") > F.col("now")) & (F.col("several").isNotNull() | ~members))
    df = _first(df, "source", "id")
    image = F.get_json_object("images", "$[0]")
    image = F.coalesce(F.when(image.startswith("{"), F.get_json_object(image, "$.url")).otherwise(image), _filled("imageUrl"), _filled("image"))
    link = F.coalesce(_filled("url"), F.concat(F.lit("/en/pdp/"), "id", F.lit(".html")))
    return as_raw(
        df, source=F.col("source"), source_id=F.concat_ws(":", F.lit(domain), "id"), title=F.col("label"), url=resolve(F.lit(site + "/"), link),
        image_url=resolve(F.lit(site + "/"), image), price=F.col("now"), price_was=F.col("before"), currency=F.lit("CAD"), merchant_domain=F.lit(domain),
        merchant_name=F.lit(name), brand=F.coalesce(_filled(F.get_json_object("brand", "$.label")), F.when(~F.col("brand").startswith("{"), _filled("brand"))),
        category_hint=_filled("categoryPath"), in_stock=F.coalesce("isAvailable", F.lit(True)) & F.coalesce("inStock", F.lit(True)),
        stock_note=F.concat("several", F.lit(" — the multi-buy price applies only when you buy the full quantity.")),
    )


_STYLES = """name string, businessCatalogItemId string, brandName string, productCategoryName string, price struct<regularPrice:string,salePrice:string,
    currentMinPrice:string,applicablePromo:string,promoText:string>, styleColors array<struct<inStock:boolean,
    productStyleColorImages:array<struct<path:string>>,sizes:array<struct<name:string>>>>"""


def range_floor(price: Column | str) -> Column:
    """The lower end of a price or range of prices, in dollars; null for none and for 0."""
    cents = price_to_cents(F.get(F.split(F.col(price) if isinstance(price, str) else price, r"\s*[-–]\s*"), F.lit(0)))
    return F.when(cents > 0, cents / 100)


def promotion(text: Column | str) -> Column:
    """How to get an offer that the price does not hold."""
    said = F.col(text) if isinstance(text, str) else text
    code = F.regexp_extract(said, r"\bcode:?\s*([A-Z0-9]{3,20})\b", 1)
    bare = F.regexp_replace(said, r"(?i)[,.]?\s*use code:?\s*[A-Z0-9]{3,20}\b", "")
    with_code = F.regexp_replace(F.concat(bare, F.lit(" — apply with code "), code, F.lit(" at checkout.")), r"\s+", " ")
    return F.when(code != "", with_code).otherwise(F.concat(said, F.lit(" — not included in the price shown.")))


def category_list(payloads: DataFrame, site: str, domain: str, name: str | None = None, department: str | None = None) -> DataFrame:
    """Styles with a sale price below the regular one; a range is compared with a range only."""
    df = _found(payloads, ("ccList",), 8, True, _STYLES)
    ranged = lambda c: F.coalesce(F.col(c).rlike(r"\d\s*[-–]\s*\D*\d"), F.lit(False))
    df = df.withColumns({"id": _filled("businessCatalogItemId"), "label": _filled("name"), "now": F.coalesce(range_floor("price.salePrice"), range_floor("price.currentMinPrice")), "before": range_floor("price.regularPrice")})
    df = df.where("id is not null and label is not null and before > now").where(ranged("price.regularPrice") == ranged("price.salePrice"))
    df = _first(df.drop("name"), "source", "id")
    sizes = F.flatten(F.transform(F.filter("styleColors", lambda s: s["sizes"].isNotNull()), lambda s: F.transform(s["sizes"], lambda z: F.trim(z["name"]))))
    sizes = F.array_distinct(F.filter(sizes, lambda z: z != ""))
    images = F.flatten(F.transform(F.filter("styleColors", lambda s: s["productStyleColorImages"].isNotNull()), lambda s: s["productStyleColorImages"]["path"]))
    return as_raw(
        df, source=F.col("source"), source_id=F.concat_ws(":", F.lit(domain), "id"), title=F.col("label"), url=F.concat(F.lit(f"{site}/browse/product.do?pid="), "id"),
        image_url=resolve(F.lit(site + "/"), F.get(F.filter(images, lambda x: F.trim(x) != ""), F.lit(0))), price=F.col("now"), price_was=F.col("before"),
        currency=F.lit("CAD"), merchant_domain=F.lit(domain), merchant_name=F.lit(name), brand=F.coalesce(_filled("brandName"), F.lit(name)), mpn=F.col("id"),
        category_hint=_filled("productCategoryName"), department_hint=F.lit(department), in_stock=F.coalesce(F.exists("styleColors", lambda s: F.coalesce(s["inStock"], F.lit(False))), F.lit(False)),
        sizes_available=F.when(F.size(sizes) > 0, sizes), stock_note=promotion(F.coalesce(_filled("price.applicablePromo"), _filled("price.promoText"))),
    )


# Blogs and trackers -------------------------------------------------------------------------


def plain_text(html: Column | str) -> Column:
    """Text without tags, numbered and named entities as their characters, white space collapsed; null if empty."""
    pieces = F.split(F.regexp_replace(html, "<[^>]*>", " "), r"(?i)(?=&#x?[0-9a-f]+;)")

    def decoded(piece: Column) -> Column:
        ten, sixteen = F.regexp_extract(piece, r"^&#(\d{1,9});", 1), F.regexp_extract(piece, r"(?i)^&#x([0-9a-f]{1,7});", 1)
        number = F.coalesce(ten.try_cast("int"), F.conv(F.nullif(sixteen, F.lit("")), 16, 10).cast("int"))
        real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        letter = F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit(" "))
        return F.when(piece.rlike(r"(?i)^&#x?[0-9a-f]+;"), F.concat(letter, F.regexp_replace(piece, r"^&#[^;]*;", ""))).otherwise(piece)

    out = F.array_join(F.transform(pieces, decoded), "")
    for entity, mark in (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return _filled(F.regexp_replace(out, r"[\s ]+", " "))


_AMOUNT = r"\$\s?(\d{1,3}(?:,\d{3})*(?:[.,]\d{2})?|\d{1,5}(?:[.,]\d{2})?)"


def stated_pair(text: Column) -> Column:
    """struct(now, was) of the first two neighbouring amounts that the text itself calls so."""

    def value(raw: Column) -> Column:
        comma = raw.rlike(r",\d{2}$") & ~raw.rlike(r"\.\d{2}$")
        return F.when(comma, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit(""))).try_cast("double")

    parts = F.struct(
        F.split(text, _AMOUNT).alias("between"), F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(0)).alias("whole"),
        F.transform(F.regexp_extract_all(text, F.lit(_AMOUNT), F.lit(1)), value).alias("values"),
    )

    def pairs(p: Column) -> Column:
        def pair(i: Column) -> Column:
            left, right, gap = F.get(p["values"], i), F.get(p["values"], i + 1), F.get(p["between"], i + 1)
            before = F.transform(F.sequence(F.lit(0), i), lambda k: F.concat(F.get(p["between"], k), F.when(k < i, F.get(p["whole"], k)).otherwise(F.lit(""))))
            lead = F.right(F.array_join(before, ""), F.lit(LEAD))
            near = (F.length(gap) <= GAP) & ~gap.rlike(r"\d") & (left > 0) & (right > 0)
            made = lambda now, was: F.struct(now.alias("now"), was.alias("was"))
            return F.when(near & gap.rlike(WAS_WORDS) & (right > left), made(left, right)).when(near & gap.rlike(NOW_WORDS) & (left > right) & lead.rlike(WAS_WORDS), made(right, left))

        all_pairs = F.when(F.size(p["values"]) > 1, F.transform(F.sequence(F.lit(0), F.size(p["values"]) - 2), pair))
        return F.get(F.filter(all_pairs, lambda x: x.isNotNull()), F.lit(0))

    return let(parts, pairs)


_POSTS = """array<struct<id:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,content:struct<rendered:string>,link:string,date_gmt:string,
    _embedded:struct<`wp:featuredmedia`:array<struct<source_url:string>>>>>"""


def posts(payloads: DataFrame, domain: str, name: str | None = None, about: tuple[str, str] | None = None, category: str | None = None) -> DataFrame:
    """Posts of a blog whose title and excerpt state a price before and after; ``about`` (domain, name) is the shop."""
    df = payloads.select("source", F.posexplode(F.from_json("payload", _POSTS)).alias("at", "p"))
    df = df.select("source", F.struct("at", F.xxhash64("p.link")).alias("place"), "p.*").withColumns({"headline": plain_text("title.rendered"), "said": plain_text("excerpt.rendered")})
    df = df.where("id is not null and headline is not null and link is not null").withColumn("pair", stated_pair(F.concat_ws(" ", "headline", F.coalesce("said", F.lit("")))))
    df = _first(df.where("pair is not null"), "source", "id")
    code = F.coalesce(coupon("headline")["code"], coupon("said")["code"])
    inline = F.nullif(F.regexp_extract("content.rendered", r"(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1), F.lit(""))
    shop = about or (domain, name)
    return as_raw(
        df, source=F.col("source"), source_id=F.concat_ws(":", F.lit(domain), "id"), title=F.col("headline"), url=F.col("link"), description=F.col("said"),
        image_url=F.coalesce(_filled(F.get(F.col("_embedded")["wp:featuredmedia"]["source_url"], F.lit(0))), inline), price=F.col("pair.now"), price_was=F.col("pair.was"),
        currency=F.lit("CAD"), merchant_domain=F.lit(shop[0]), merchant_name=F.lit(shop[1]), coupon_code=code, category_hint=F.lit(category),
        stock_note=F.lit(f"Reported by {name or domain} — confirm in store."), posted_at=F.concat("date_gmt", F.lit("Z")),
    )


def price_drops(payloads: DataFrame) -> DataFrame:
    """Items of a tracker's feed that name a product and a price that fell; labelled prices count before bare ones."""
    items = select(payloads, "payload", "item", {"f": first("title", "link", "description", "pubDate", "enclosure")}, ("source", "payload"), xml=True)
    title, link, text, day = (plain_text(F.get("f", F.lit(i))["text"]) for i in range(4))
    place, attached = F.struct("place", F.xxhash64("payload")).alias("place"), F.try_element_at(F.get("f", F.lit(4))["attributes"], F.lit("url"))
    df = items.select("source", place, F.col("row.text").alias("item"), attached.alias("attached"), title.alias("title"), link.alias("link"), text.alias("text"), day.alias("day"))
    df = df.withColumn("asin", F.coalesce(asin_of("link"), asin_of("item"))).withColumn("said", F.concat_ws(" ", "title", "text"))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    labelled = lambda labels: F.coalesce(*[number(F.nullif(F.regexp_extract("said", "(?i)" + x + _MONEY, 1), F.lit(""))) for x in labels])
    df = df.withColumns({"l": labelled(NOW_LABELS), "h": labelled(WAS_LABELS), "all": F.filter(F.transform(F.regexp_extract_all("said", F.lit("(?i)" + _MONEY), F.lit(1)), number), lambda x: x > 0)})
    enough = (F.col("l").isNotNull() & F.col("h").isNotNull()) | (F.size("all") > 1)
    df = df.withColumns({"now": F.when(enough, F.coalesce("l", F.array_min("all"))), "before": F.when(enough, F.coalesce("h", F.array_max("all")))})
    df = _first(df.where("asin is not null and title is not null and link is not null and before > now"), "source", "asin")
    title = F.col("title")
    for ending in (r"(?i)\s*[-–]\s*down\s+[\d.]+%.*$", r"(?i)\s*[-–]\s*\d+%\s*(?:price\s*)?drop.*$", r"(?i)\s*\((?:was|now)[^)]*\)\s*$"):
        title = F.regexp_replace(title, ending, "")
    picture = F.coalesce(F.nullif("attached", F.lit("")), F.nullif(F.regexp_extract("item", r"(?i)<img[^>]*src=\"([^\"]+)\"", 1), F.lit("")))
    return as_raw(
        df, source=F.col("source"), source_id=F.concat(F.lit("camel:"), "asin"), title=F.trim(title), url=F.concat(F.lit("https://www.amazon.ca/dp/"), "asin"), image_url=picture,
        price=F.col("now"), price_was=F.col("before"), currency=F.lit("CAD"), merchant_domain=F.lit("amazon.ca"), merchant_name=F.lit("Amazon.ca"), asin=F.col("asin"),
        stock_note=F.lit("Price reported by a third-party tracker — confirm on Amazon before buying."), posted_at=F.col("day"),
    )
