"""Column functions on money, geography and scores.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
HALF_LIFE_HOURS = 12
#: Weights of the heat score's parts.
HEAT = {"votes": 30, "discount": 35, "recency": 25, "source": 10}
#: Trust by source.
SOURCE_TRUST = {
    "redflagdeals": 1.0, "smartcanucks": 0.8, "cocowest": 0.8, "costcoeast": 0.8, "bestbuy": 0.7, "amazon-paapi": 0.7,
    "camelcamelcamel": 0.6, "stocktrack": 0.7, "costco": 0.6, "walmart": 0.6, "shopify": 0.5, "sfcc": 0.5, "hybris": 0.5,
    "gapinc": 0.5, "magento": 0.5, "jsonld": 0.4,
}
DEFAULT_TRUST = 0.4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Rounds halves toward plus infinity."""
    scale = 10**digits
    rounded = F.floor(col(c) * F.lit(float(scale)) + F.lit(0.5))
    return rounded / F.lit(float(scale)) if digits else rounded


def percent(share: Column) -> Column:
    """A share in per cent with one digit, rounded once."""
    return half_up(share * 1000) / 10


def discount(now: Column | str, was: Column | str) -> Column:
    """struct(pct, abs, was); all null unless the earlier price stands up."""
    now, was = col(now), col(was)
    gap = was - now
    share = gap / was * 100
    sound = now.isNotNull() & was.isNotNull() & (was > now) & (was > 0) & (now >= 0)
    sound = sound & (F.when(was > 0, share) < 99.5)
    return F.when(sound, F.struct(half_up(share, 1).alias("pct"), gap.alias("abs"), was.alias("was")))


def format_cents(cents: Column | str) -> Column:
    cents = col(cents)
    return F.when(cents.isNull(), F.lit("—")).when(cents == 0, F.lit("Free")).otherwise(F.concat(F.lit("$"), F.format_number(cents / 100, 2)))


def price_to_cents(text: Column | str) -> Column:
    """Cents of a price in English, French or continental notation; null if it is none."""
    raw = F.trim(F.regexp_replace(col(text), "^[\\s ]+|[\\s ]+$", ""))
    free = raw.rlike(r"(?i)^(free|gratuit|no charge|\$0(?:\.00)?)$")
    other = raw.rlike(r"(?i)^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|[a-z]{2,}\d+[a-z]*)$")
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)CAD|CDN|USD|EUR|\$|€|£", " "), "[^\\d.,\\s -]", " ")
    number = F.regexp_extract(bare, "-?\\d+(?:[.,\u00a0 ]\\d{3})*(?:[.,]\\d+)?", 0)

    def plain(n: Column) -> Column:
        comma, dot = F.instr(F.reverse(n), ","), F.instr(F.reverse(n), ".")  # from the end; 0: none
        comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
        grouped = n.rlike(r"^-?\d+(,\d{3})+$") | n.rlike(r"^\d{1,3}\.\d{3}$")
        european = F.regexp_replace(F.replace(n, F.lit("."), F.lit("")), ",", ".")
        return F.when(grouped, F.translate(n, ",.", "")).when(comma_last, european).otherwise(F.replace(n, F.lit(","), F.lit(""))).try_cast("double")

    bounded = lambda v: F.when((v >= 0) & (v <= 10_000_000), half_up(v * 100))
    cents = let(let(F.regexp_replace(number, "[\\s\u00a0]", ""), plain), bounded)
    # digits and at most two decimals read the same in any notation
    bare_number = col(text).rlike(r"^\d{1,8}(?:\.\d{1,2})?\z")
    return F.when(bare_number, bounded(col(text).try_cast("double"))).when(raw.isNull() | (raw == "") | other, F.lit(None).cast("long")).when(free, F.lit(0).cast("long")).otherwise(cents)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def votes_part(votes: Column) -> Column:
    return F.when(votes <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(votes) / F.log1p(F.lit(200.0))))


def discount_part(pct: Column) -> Column:
    return F.when(pct.isNull() | (pct <= 0), 0.0).otherwise(F.least(F.lit(1.0), pct / 70))


def hours_between(earlier: Column, later: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 3_600_000_000


def recency_part(posted: Column, now: Column) -> Column:
    age = hours_between(posted, now)
    return F.when(posted.isNull(), 0.3).when(age < 0, 1.0).otherwise(F.pow(F.lit(0.5), age / HALF_LIFE_HOURS))


def source_part(source: Column) -> Column:
    trust = F.create_map(*[F.lit(x) for pair in SOURCE_TRUST.items() for x in pair])
    return F.coalesce(F.try_element_at(trust, source), F.lit(DEFAULT_TRUST))


def heat(votes: Column, pct: Column, posted: Column, source: Column, now: Column, weights: dict[str, float] = HEAT) -> Column:
    """From 0 to 100, to one digit."""
    score = (
        weights["votes"] * votes_part(votes)
        + weights["discount"] * discount_part(pct)
        + weights["recency"] * recency_part(posted, now)
        + weights["source"] * source_part(source)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(score / sum(weights.values()) * 100, 1)))


def gtin_valid(code: Column | str) -> Column:
    """Check digit of 8, 12, 13 or 14 digits."""
    digits = F.regexp_replace(col(code), r"\D", "")
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    weigh = lambda i: F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), weigh), F.lit(0), lambda a, x: a + x)
    check = (F.lit(10) - total % 10) % 10
    return F.when(F.length(digits).isin(8, 12, 13, 14), check == F.right(digits, F.lit(1)).cast("int")).otherwise(False)


def model_token(title: Column | str) -> Column:
    """The first word of 4 to 24 letters and digits that has both and is no measure, in capitals."""
    tokens = F.transform(F.split(col(title), "[\\s ,()\\[\\]]+"), lambda t: F.regexp_replace(t, "[^A-Za-z0-9-]", ""))
    measure = r"(?i)^\d+(?:gb|tb|mb|kg|lb|ml|oz|cm|mm|in|ft|hz|w|k|p|pc|pk|ct)$"
    fits = lambda t: (F.length(t) >= 4) & (F.length(t) <= 24) & t.rlike("[A-Za-z]") & t.rlike(r"\d") & ~t.rlike(measure)
    return F.upper(F.get(F.filter(tokens, fits), F.lit(0)))


def identity(title: Column, brand: Column, gtin: Column, mpn: Column, asin: Column) -> Column:
    """struct(key, strength) from the strongest evidence there is."""
    from .text import fold

    digits = F.regexp_replace(gtin, r"\D", "")
    maker = F.regexp_replace(F.lower(fold(brand)), "[^a-z0-9]", "")
    maker = F.when(F.length(maker) >= 2, maker)
    part = F.upper(F.regexp_replace(mpn, "[^A-Za-z0-9]", ""))
    model = model_token(title)
    scoped = lambda kind, value: F.concat_ws(":", F.lit(kind), maker, value)  # noqa: E731  nulls are skipped
    made = lambda key, strength: F.struct(key.alias("key"), F.lit(strength).alias("strength"))
    return (
        F.when(gtin_valid(gtin), made(F.concat(F.lit("gtin:"), F.lpad(digits, 14, "0")), "gtin"))
        .when(asin.rlike("(?i)^[A-Z0-9]{10}$"), made(F.concat(F.lit("asin:"), F.upper(asin)), "asin"))
        .when(F.length(part) >= 3, made(scoped("mpn", part), "mpn"))
        .when(model.isNotNull(), made(scoped("model", model), "model"))
        .otherwise(made(F.lit(None).cast("string"), "none"))
    )


def price_bucket(cents: Column | str) -> Column:
    """Bands of 5 %."""
    cents = col(cents)
    return (
        F.when(cents.isNull(), F.lit("unknown"))
        .when(cents == 0, F.lit("free"))
        .otherwise(half_up(F.log(cents.cast("double")) / F.log(F.lit(1.05))).cast("string"))
    )
