"""One query object for listings, counts, facets and proximity."""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from ..functions.text import padded_search
from ..schemas import CATEGORIES, DEPARTMENTS, SORTS, VERDICTS

FRESH_DAYS = 3
#: Merchants are broadcast up to so many.
BROADCAST_ROWS = 500_000
KM_PER_DEGREE = 111.32


@dataclass(frozen=True)
class DealQuery:
    search: str | None = None
    categories: tuple[str, ...] = ()
    departments: tuple[str, ...] = ()
    merchants: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    brands: tuple[str, ...] = ()
    stores: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ("active",)
    verdicts: tuple[str, ...] = ()
    min_price: int | None = None
    max_price: int | None = None
    min_discount_pct: float | None = None
    coupon_only: bool = False
    in_stock_only: bool = False
    verified_only: bool = False
    exclude_suspect: bool = False
    fresh_days: float | None = None
    sort: str = "hottest"
    limit: int = 48
    offset: int = 0
    near: tuple[float, float, float] | None = None

    def pinned(self, **base) -> DealQuery:
        """What a page pins wins over what the user asked for."""
        return replace(self, **base)


def search_term(text: str) -> str:
    plain = unicodedata.normalize("NFD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).lower().strip()


def with_relations(deals: DataFrame, merchants: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Left joins to the dimensions; merchants are broadcast if a count shows that they are few, so that the deals stay where they are."""
    m = merchants.select(F.col("id").alias("merchant_id"), F.col("slug").alias("merchant_slug"), F.col("name").alias("merchant_name"), "family", "vertical")
    few = m.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = deals.join(F.broadcast(m) if few else m, "merchant_id", "left")
    if stores is not None:
        s = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), "chain", "lat", "lng")
        out = out.join(s, "store_id", "left")
    return out


def predicate(q: DealQuery, now: datetime, columns: list[str]) -> Column:
    """All conditions of the query on deals with relations."""
    parts: list[Column] = [F.col("status").isin(*q.statuses)]
    days = FRESH_DAYS if q.fresh_days is None else q.fresh_days
    if days > 0:
        parts.append(F.col("last_seen_at") >= F.lit(now - timedelta(days=days)).cast("timestamp_ntz"))
    listed = {"category": q.categories, "department": q.departments, "merchant_slug": q.merchants, "family": q.families, "store_id": q.stores, "source": q.sources, "verdict": q.verdicts}
    parts += [F.col(name).isin(*values) for name, values in listed.items() if values]
    if q.brands:
        parts.append(F.lower("brand").isin(*[b.lower() for b in q.brands]))
    if q.min_price is not None:
        parts.append(F.col("price_now") >= q.min_price)
    if q.max_price is not None:
        parts.append(F.col("price_now").isNull() | (F.col("price_now") <= q.max_price))
    if q.min_discount_pct is not None:
        parts.append(F.col("discount_pct") >= q.min_discount_pct)
    if q.coupon_only:
        parts.append(F.col("coupon_code").isNotNull() & (F.col("coupon_code") != ""))
    if q.in_stock_only:
        parts.append(F.col("in_stock"))
    if q.verified_only:
        parts.append(F.col("verdict").isin("verified-low", "verified-good"))
    if q.exclude_suspect:
        parts.append(~F.col("claim_suspect"))
    if q.search and (term := search_term(q.search)):
        fields = [padded_search(c, term) for c in ("title", "description", "merchant_name", "brand") if c in columns]
        if "keywords" in columns:
            fields.append(F.contains(F.coalesce("keywords", F.lit("")), F.lit(f" {term} ")))
        any_of = fields[0]
        for f in fields[1:]:
            any_of = any_of | f
        parts.append(any_of)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def ordering(sort: str, columns: list[str]) -> list[Column]:
    """A total order: ties go by id."""
    market = F.col("market_discount_pct") if "market_discount_pct" in columns else F.lit(None).cast("double")
    weight = F.when(F.col("verdict") == "verified-low", 3).when(F.col("verdict") == "verified-good", 2).when(F.col("verdict") == "market-price", 1).otherwise(0) if "verdict" in columns else F.lit(0)
    by = {
        "hottest": [F.desc("heat")],
        "newest": [F.coalesce("posted_at", "first_seen_at").desc()],
        "biggest-drop": [F.coalesce(market, F.col("discount_pct"), F.lit(-1.0)).desc()],
        "best-verified": [weight.desc(), F.coalesce(market, F.lit(0.0)).desc()],
        "price-asc": [F.coalesce("price_now", F.lit(999_999_999)).asc()],
        "price-desc": [F.coalesce("price_now", F.lit(-1)).desc()],
        "expiring": [F.coalesce("expires_at", F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))).asc()],
    }
    return [*by[sort], F.asc("id")]


def matching(deals: DataFrame, q: DealQuery, now: datetime) -> DataFrame:
    return deals.where(predicate(q, now, deals.columns))


def by_slug(deals: DataFrame, slug: str) -> DataFrame:
    """Lookups go past status and age."""
    return deals.where(F.col("slug") == slug)


def by_ids(deals: DataFrame, ids: list[str]) -> DataFrame:
    return deals.where(F.col("id").isin(*ids))


def by_domain(merchants: DataFrame, domain: str) -> DataFrame:
    return merchants.where(F.col("domain") == domain.lower())


def by_store(stores: DataFrame, store: str) -> DataFrame:
    return stores.where(F.col("id") == store)


def listing(deals: DataFrame, q: DealQuery, now: datetime) -> DataFrame:
    """A page: top-k by the sort, without a full sort."""
    out = matching(deals, q, now).orderBy(*ordering(q.sort, deals.columns))
    return out.offset(q.offset).limit(q.limit) if q.offset else out.limit(q.limit)


def count(deals: DataFrame, q: DealQuery, now: datetime) -> DataFrame:
    return matching(deals, q, now).agg(F.count(F.lit(1)).alias("total"))


def pages(total: int, limit: int) -> int:
    return max(1, math.ceil(total / limit))


def page_count(total: str, limit: int) -> Column:
    """The same of a column."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.col(total) / limit))


def stores_by_chain(stores: DataFrame) -> DataFrame:
    return stores.orderBy("chain", "name", "id")


def merchants_by_name(merchants: DataFrame) -> DataFrame:
    return merchants.orderBy(F.lower("name"), "id")


FACETS = {"category": ("category", "category"), "department": ("department", "department"), "merchant": ("merchant_slug", "merchant_name"), "family": ("family", "family"), "brand": ("brand", "brand")}


def facet(deals: DataFrame, field: str, now: datetime) -> DataFrame:
    """value, label, count over active, fresh deals; most first, then by value."""
    value, label = FACETS[field]
    rows = matching(deals, DealQuery(), now).where(F.col(value).isNotNull() & (F.col(value) != ""))
    return rows.groupBy(F.col(value).alias("value"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")


def facets(deals: DataFrame, fields: tuple[str, ...], now: datetime) -> DataFrame:
    """Several facets in one pass: facet, value, count."""
    pairs = [F.struct(F.lit(f).alias("facet"), F.col(FACETS[f][0]).alias("value")) for f in fields]
    rows = matching(deals, DealQuery(), now).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    return rows.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def in_box(lat: float, lng: float, km: float) -> Column:
    """Cheap bounds on columns lat and lng; they reach the scan, the exact distance does not."""
    dlat, dlng = km / KM_PER_DEGREE, km / (KM_PER_DEGREE * max(math.cos(math.radians(lat)), 0.01))
    return F.col("lat").between(lat - dlat, lat + dlat) & F.col("lng").between(lng - dlng, lng + dlng)


def within(rows: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    boxed = rows.where(in_box(lat, lng, km)).withColumn("distance_km", haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))
    return boxed.where(F.col("distance_km") <= km)


def stores_near(stores: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    return within(stores, lat, lng, km).orderBy("distance_km", "id")


def deals_near(deals: DataFrame, q: DealQuery, now: datetime) -> DataFrame:
    """Deals of stores in reach; heat counts against distance."""
    lat, lng, km = q.near
    rows = within(matching(deals, q, now), lat, lng, km)
    out = rows.orderBy((F.col("heat") - 1.5 * F.col("distance_km")).desc(), F.asc("distance_km"), F.asc("id"))
    return out.offset(q.offset).limit(q.limit) if q.offset else out.limit(q.limit)


_LISTS = {"category": ("categories", CATEGORIES), "department": ("departments", DEPARTMENTS), "verdict": ("verdicts", VERDICTS), "merchant": ("merchants", None), "family": ("families", None), "brand": ("brands", None), "store": ("stores", None), "source": ("sources", None)}
_FLAGS = {"coupon": "coupon_only", "inStock": "in_stock_only", "verified": "verified_only", "noSuspect": "exclude_suspect"}


def from_params(query: str, page_size: int = 24) -> DealQuery:
    """Reads a URL's query string; unknown enumeration values are dropped."""
    given = parse_qs(query)
    out: dict = {"limit": page_size}
    for name, (attribute, allowed) in _LISTS.items():
        values = tuple(v for x in given.get(name, []) for v in x.split(",") if v and (allowed is None or v in allowed))
        if values:
            out[attribute] = values
    for name, attribute in _FLAGS.items():
        if given.get(name, [""])[0] in ("1", "true"):
            out[attribute] = True
    for name, attribute in (("minPrice", "min_price"), ("maxPrice", "max_price")):
        try:
            out[attribute] = round(float(given[name][0]) * 100)
        except (KeyError, ValueError):
            pass
    try:
        out["min_discount_pct"] = float(given["minDiscount"][0])
    except (KeyError, ValueError):
        pass
    if given.get("sort", [""])[0] in SORTS:
        out["sort"] = given["sort"][0]
    if given.get("q"):
        out["search"] = given["q"][0]
    page = int(given["page"][0]) if given.get("page", [""])[0].isdigit() else 1
    out["offset"] = (max(1, page) - 1) * page_size
    return DealQuery(**out)


#: Arguments of a tool, by field of the query.
_ARGUMENTS = {
    "search": "search", "categories": "categories", "departments": "departments", "merchant_slugs": "merchants", "families": "families", "brands": "brands",
    "min_discount_pct": "min_discount_pct", "coupon_only": "coupon_only", "in_stock_only": "in_stock_only", "verified_only": "verified_only",
    "exclude_suspect": "exclude_suspect", "sort": "sort", "limit": "limit",
}


def from_tool_args(args: dict) -> DealQuery:
    """A tool's arguments: prices in dollars, 12 rows unless told otherwise; what is not known raises."""
    out: dict = {"limit": 12}
    for name, value in args.items():
        if value is None:
            continue
        if name in ("min_price_dollars", "max_price_dollars"):
            out[name.removesuffix("_dollars")] = math.floor(value * 100 + 0.5)
        elif name in _ARGUMENTS:
            out[_ARGUMENTS[name]] = tuple(value) if isinstance(value, list) else value
        else:
            raise ValueError(f"{name}: unknown argument")
    if out.get("sort", "hottest") not in SORTS:
        raise ValueError("sort: unknown value")
    return DealQuery(**out)


def to_params(q: DealQuery) -> str:
    out: list[tuple[str, str]] = [("q", q.search)] if q.search else []
    out += [(name, ",".join(getattr(q, attribute))) for name, (attribute, _) in _LISTS.items() if getattr(q, attribute)]
    out += [(name, "1") for name, attribute in _FLAGS.items() if getattr(q, attribute)]
    out += [(n, f"{v / 100:g}") for n, v in (("minPrice", q.min_price), ("maxPrice", q.max_price)) if v is not None]
    if q.min_discount_pct is not None:
        out.append(("minDiscount", f"{q.min_discount_pct:g}"))
    if q.sort != "hottest":
        out.append(("sort", q.sort))
    if q.offset:
        out.append(("page", str(q.offset // q.limit + 1)))
    return urlencode(out)


def validated(params: dict[str, str]) -> DealQuery:
    """Strict reading for an API: bad values raise, 1 to 100 rows, 1 to 1000 pages."""
    for name, (_, allowed) in _LISTS.items():
        bad = [v for v in params.get(name, "").split(",") if v and allowed is not None and v not in allowed]
        if bad:
            raise ValueError(f"{name}: unknown value {bad[0]}")
    if params.get("sort", "hottest") not in SORTS:
        raise ValueError("sort: unknown value")
    limit, page = int(params.get("limit", 24)), int(params.get("page", 1))
    if not 1 <= limit <= 100:
        raise ValueError("limit: 1 to 100")
    if not 1 <= page <= 1000:
        raise ValueError("page: 1 to 1000")
    for name in ("minPrice", "maxPrice", "minDiscount"):
        if name in params and float(params[name]) < 0:
            raise ValueError(f"{name}: not below 0")
    return from_params(urlencode(params), limit)
