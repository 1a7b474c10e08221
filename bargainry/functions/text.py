"""Column functions on titles, descriptions, slugs and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, let

#: Words without identity in titles.
NOISE = (
    "the", "a", "an", "and", "or", "for", "with", "new", "sale", "deal", "deals", "off", "save", "now", "only", "free", "shipping",
    "clearance", "today", "hot", "best", "price", "lowest", "ymmv", "expired", "back", "in", "stock", "at", "to", "from", "up", "on",
)
#: Query parameters that track visitors.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "gclid", "gclsrc", "dclid", "fbclid",
    "msclkid", "twclid", "igshid", "mc_cid", "mc_eid", "srsltid", "ref", "referrer", "referer", "source", "cmpid", "campaign", "cm_mmc",
    "cm_sp", "irclickid", "irgwc", "clickid", "affid", "affiliate", "partner", "pcrid", "sid", "siteid", "eid", "_ga", "_gl", "icid",
    "intcmp", "ecid", "trk", "trkid",
)
#: Such parameters of single sites, in lower case.
SITE_TRACKING = {
    "amazon.ca": ("tag", "linkcode", "linkid", "ascsubtag", "psc", "th", "creative", "creativeasin"),
    "amazon.com": ("tag", "linkcode", "linkid", "ascsubtag", "psc", "th"),
    "bestbuy.ca": ("icmp", "intl"),
    "walmart.ca": ("athbdg", "athcpid", "athstid"),
}
#: Sites that wrap a target in a parameter.
WRAPPERS = {
    "redflagdeals.com": "url", "googleadservices.com": "adurl", "doubleclick.net": "ds_dest_url", "go.redirectingat.com": "url",
    "anrdoezrs.net": "url", "dpbolvw.net": "url", "linksynergy.com": "murl",
}
#: Endings of host names that count as one label.
TWO_PART = ("co.uk", "com.au", "co.nz", "com.br", "gc.ca", "on.ca", "qc.ca")

# Letters of Latin-1 and Latin Extended-A with a mark, and the letter below it.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"


def fold(text: Column | str) -> Column:
    """Letters without their marks; loose combining marks go."""
    return F.regexp_replace(F.translate(col(text), _MARKED, _PLAIN), r"\p{M}", "")


def clean_title(title: Column | str) -> Column:
    """Without status tags, runs of asterisks and emoji; white space collapsed."""
    out = F.regexp_replace(col(title), r"(?i)^\s*\[?(?:expired|dead|hot|deal|sale|update|ymmv)\]?\s*[:—-]?\s*", " ")
    out = F.regexp_replace(out, r"(?i)\s*\[(?:expired|dead|update|ymmv)\]\s*", " ")
    out = F.regexp_replace(out, r"\*{2,}", " ")
    out = F.regexp_replace(out, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}©®™]", " ")
    out = F.regexp_replace(out, r"\s{2,}", " ")
    return F.trim(F.regexp_replace(out, r"^[\s:—-]+|[\s:—-]+$", ""))


def strip_html(text: Column | str) -> Column:
    out = F.regexp_replace(col(text), "<[^>]*>", " ")
    # one pass over the entities, so "&amp;lt;" stays "&lt;"
    parts = F.split(out, "&amp;")

    def plain(part: Column) -> Column:
        for entity, mark in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
            part = F.replace(part, F.lit(entity), F.lit(mark))
        return part

    return F.array_join(F.transform(parts, plain), "&")


def trim_description(text: Column | str, most: int = 220) -> Column:
    """Plain text of at most ``most`` characters and an ellipsis, cut at a space past 60 %."""
    plain = F.trim(F.regexp_replace(strip_html(text), r"\s{2,}", " "))
    cut = F.substring(plain, 1, most)
    space = F.lit(most) - F.instr(F.reverse(cut), " ")  # place of the last space, from 0
    kept = F.when((F.instr(cut, " ") > 0) & (space > most * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(plain == "", None).when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(kept), F.lit("…")))


def slug(title: Column | str, suffix: Column | str) -> Column:
    base = F.regexp_replace(F.lower(fold(title)), "[^a-z0-9]+", "-")
    base = F.regexp_replace(F.substring(F.regexp_replace(base, "^-+|-+$", ""), 1, 70), "-+$", "")
    return F.concat(F.when(base == "", F.lit("deal")).otherwise(base), F.lit("-"), F.substring(col(suffix), 1, 6))


def title_tokens(title: Column | str) -> Column:
    """Identifying words, sorted; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(fold(title)), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_sort(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*NOISE) & ~w.rlike(r"^\d{1,2}$")))


def fingerprint(merchant: Column, title: Column, cents: Column) -> Column:
    from .scalars import price_bucket

    tokens = title_tokens(title)
    payload = F.concat_ws("|", merchant, F.array_join(tokens, " "), price_bucket(cents))
    return F.when((F.size(tokens) >= 2) & (merchant != ""), F.sha1(payload))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


#: Addresses that are canonical as they stand: of lower-case sites without www., port, query or closing slash.
_CANONICAL = r"^https://(?!www\.)[a-z0-9.-]+/(?:[!-\x22\x24-\x3E@-~]*[!-\x22\x24-.0-\x3E@-~])?\z"


def _is_site(host: Column, site: str) -> Column:
    return (host == site) | host.endswith("." + site)


def host(url: Column | str) -> Column:
    """Lower-case host without www., null for anything but an absolute URL."""
    return F.nullif(F.regexp_replace(F.lower(_part(F.trim(col(url)), 2)), r"^www\.", ""), F.lit(""))


def _wraps(url: Column) -> Column:
    return F.lower(url).rlike("|".join(map(re.escape, WRAPPERS)))


def _target(url: Column) -> Column:
    """What a redirect wraps; the address itself if it wraps nothing."""

    def pick(at: Column, query: Column) -> Column:
        out = F.lit("")
        for site, parameter in WRAPPERS.items():
            out = F.when(_is_site(at, site), F.regexp_extract(query, f"(?:^|&){parameter}=([^&]*)", 1)).otherwise(out)
        return F.try_url_decode(out)

    parts = F.struct(F.lower(_part(url, 2)).alias("at"), _part(url, 5).alias("query"))
    found = let(parts, lambda p: pick(p["at"], p["query"]))
    inside = let(found, lambda f: F.when(f.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), f).otherwise(url))
    # few addresses name such a site anywhere; no other wraps one
    return F.when(_wraps(url), inside).otherwise(url)


def _canonical(scheme: Column, site: Column, port: Column, path: Column, query: Column, raw: Column) -> Column:
    own = F.array().cast("array<string>")
    for known, names in SITE_TRACKING.items():
        own = F.when(_is_site(site, known), F.array(*map(F.lit, names))).otherwise(own)
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(name(p)).isin(*TRACKING) & ~F.array_contains(own, F.lower(name(p))))
    # by name; parameters of one name stay in the order given
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    joined = F.array_join(F.transform(placed, lambda x: x["p"]), "&")
    base = F.concat(F.lit("https://"), site, F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    bare = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))
    full = let(joined, lambda q: F.when(q == "", F.concat(base, bare)).otherwise(F.concat(base, path, F.lit("?"), F.regexp_replace(q, "/$", ""))))
    return F.when(scheme.isin("http", "https") & (site != ""), full).otherwise(raw)


def canonical_url(url: Column | str) -> Column:
    """One form for all addresses of a page: https, no www., no tracking, sorted parameters."""

    def of(raw: Column, target: Column) -> Column:
        parts = F.struct(
            F.lower(_part(target, 1)).alias("scheme"),
            F.regexp_replace(F.lower(_part(target, 2)), r"^www\.", "").alias("site"),
            _part(target, 3).alias("port"),
            F.coalesce(F.nullif(_part(target, 4), F.lit("")), F.lit("/")).alias("path"),
            _part(target, 5).alias("query"),
        )
        return let(parts, lambda p: _canonical(p["scheme"], p["site"], p["port"], p["path"], p["query"], raw))

    def unwrapped(raw: Column) -> Column:
        return let(let(let(let(raw, _target), _target), _target), lambda t: of(raw, t))

    # what names no wrapping site is its own target
    direct = lambda raw: F.when(_wraps(raw), unwrapped(raw)).otherwise(of(raw, raw))
    return F.when(col(url).rlike(_CANONICAL), col(url)).otherwise(let(F.trim(col(url)), direct))


def registrable_domain(url: Column | str) -> Column:
    def of(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
        return F.when(last(2).isin(*TWO_PART), last(3)).otherwise(last(2))

    return let(F.split(host(url), r"\."), of)


def asin_of(url: Column | str) -> Column:
    shapes = (r"/dp/([A-Z0-9]{10})(?:[/?]|$)", r"/gp/product/([A-Z0-9]{10})(?:[/?]|$)", r"/product/([A-Z0-9]{10})(?:[/?]|$)", r"[?&]asin=([A-Z0-9]{10})(?:&|$)")
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(col(url), "(?i)" + s, 1), F.lit("")) for s in shapes]))


def affiliate_url(url: Column, template: Column) -> Column:
    encoded = F.replace(F.url_encode(url), F.lit("+"), F.lit("%20"))
    return F.when(template.contains("{url}"), F.replace(template, F.lit("{url}"), encoded)).otherwise(url)


def image_url(url: Column | str) -> Column:
    u = F.trim(col(url))
    return F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike("^https?://"), F.regexp_replace(u, "^http:", "https:"))


def timestamp_of(text: Column | str) -> Column:
    """Seconds or milliseconds since 1970, ISO 8601 or RFC 822; UTC; null if none of them."""
    raw = F.trim(col(text))
    # a date is no number: trying costs an exception each
    number = F.when(~raw.rlike(r"^\d{4}-\d\d"), raw.try_cast("double"))
    millis = F.when(number < 1e11, number * 1000).otherwise(number).cast("long")
    mail = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|Z)$", " +0000")
    instant = F.when(number.isNotNull(), F.timestamp_millis(millis)).otherwise(
        F.coalesce(raw.try_cast("timestamp"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))
    )
    return F.to_timestamp_ntz(F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def padded_search(column: Column | str, term: str) -> Column:
    """Whether a word of the column begins with the term."""
    return F.contains(F.concat(F.lit(" "), F.lower(F.coalesce(col(column), F.lit("")))), F.lit(" " + term))
