"""Queries on titles, descriptions, coupons, addresses and pages, over the shelf's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, scalars, text
from ..operators import dedupe
from ..sources import payloads
from . import shelf
from .queries import query
from .shelf import listed, quoted

_BOTH_ENDS = "[\\s:—-]"


def _re2(pattern: str) -> str:
    """For DuckDB, which has no lookahead: what follows simply has to be there too."""
    return pattern.replace("(?=", "", 1).removesuffix(")") if "(?=" in pattern else pattern


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_PLAIN_TITLE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title,
    '^\s*\[?(?:expired|dead|hot|deal|sale|update|ymmv)\]?\s*[:—-]?\s*', ' ', 'i'), '\s*\[(?:expired|dead|update|ymmv)\]\s*', ' ', 'gi'), '\*{2,}', ' ', 'g'),
    '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}©®™]', ' ', 'g'), '\s{2,}', ' ', 'g')"""


@query("q45_clean_title", f"SELECT p_partkey, trim(regexp_replace({_PLAIN_TITLE}, '^{_BOTH_ENDS}+|{_BOTH_ENDS}+$', '', 'g')) AS value FROM ({shelf.parts_sql(shelf.CATEGORY_TEXTS)})")
def _clean(spark, sf_dir):
    return shelf.parts(spark, sf_dir, shelf.CATEGORY_TEXTS).select("p_partkey", text.clean_title("title").alias("value"))


_PLAIN = """list_reduce([['&nbsp;', ' '], ['&quot;', '"'], ['&#39;', ''''], ['&lt;', '<'], ['&gt;', '>']], lambda t, x: [replace(t[1], x[1], x[2])], [p])[1]"""
_TRIMMED = rf"""WITH bare AS (SELECT key, regexp_replace(body, '<[^>]*>', ' ', 'g') AS t FROM ({{}})),
    plain AS (SELECT key, trim(regexp_replace(array_to_string(list_transform(string_split(t, '&amp;'), lambda p: {_PLAIN}), '&'), '\s{{{{2,}}}}', ' ', 'g')) AS t FROM bare),
    cut AS (SELECT key, t, substr(t, 1, 220) AS c, 220 - strpos(reverse(substr(t, 1, 220)), ' ') AS place FROM plain)
    SELECT key AS {{}}, CASE WHEN t = '' THEN NULL WHEN length(t) <= 220 THEN t
        ELSE rtrim(CASE WHEN strpos(c, ' ') > 0 AND place > 132 THEN substr(c, 1, place) ELSE c END) || '…' END AS description FROM cut"""


@query("q46_strip_html_description", _TRIMMED.format("SELECT page_id AS key, html AS body FROM pages", "page_id"))
def _page_descriptions(spark, sf_dir):
    return shelf.mart.table(spark, sf_dir, "pages").select("page_id", text.trim_description("html").alias("description"))


@query("q46b_trim_description", _TRIMMED.format(f"SELECT p_partkey AS key, description AS body FROM ({shelf.parts_sql(shelf.CATEGORY_TEXTS)})", "p_partkey"))
def _descriptions(spark, sf_dir):
    return shelf.parts(spark, sf_dir, shelf.CATEGORY_TEXTS).select("p_partkey", text.trim_description("description").alias("description"))


_SLUG = r"regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 70), '-+$', '')"


@query("q47_slug", f"SELECT p_partkey, CASE WHEN {_SLUG} = '' THEN 'deal' ELSE {_SLUG} END || '-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS value FROM ({shelf.parts_sql(shelf.KEYWORD_TEXTS)})")
def _slug(spark, sf_dir):
    return shelf.parts(spark, sf_dir, shelf.KEYWORD_TEXTS).select("p_partkey", text.slug("title", F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("value"))


_WORDS = rf"""list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(title)), '[^a-z0-9\s]', ' ', 'g'), '\s+'),
    lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]{{1,2}}') AND NOT list_contains({listed(text.NOISE)}, w)))"""
_CENTS = "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0 ELSE p_partkey * 100 END"


@query(
    "q49_fingerprint",
    f"""SELECT p_partkey, CASE WHEN len(words) >= 2 AND p_brand <> '' THEN sha1(p_brand || '|' || array_to_string(words, ' ') || '|' ||
        CASE WHEN cents IS NULL THEN 'unknown' WHEN cents = 0 THEN 'free' ELSE CAST(CAST(floor(ln(cents) / ln(1.05::DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) END) END AS value
        FROM (SELECT p_partkey, p_brand, {_WORDS} AS words, {_CENTS} AS cents FROM ({shelf.parts_sql(shelf.KEYWORD_TEXTS)}))""",
)
def _fingerprint(spark, sf_dir):
    rows = shelf.parts(spark, sf_dir, shelf.KEYWORD_TEXTS)
    return rows.select("p_partkey", text.fingerprint(F.col("p_brand"), F.col("title"), F.expr(_CENTS)).alias("value"))


#: Codes by key, in SQL that both engines read.
_CODES = {
    "gtin": "CASE p_partkey % 6 WHEN 0 THEN '0012345678905' WHEN 1 THEN '96385074' WHEN 2 THEN '036000291453' WHEN 3 THEN '12' END",
    "asin": "CASE p_partkey % 5 WHEN 0 THEN 'b00000000x' WHEN 1 THEN 'short' END",
    "mpn": "CASE p_partkey % 4 WHEN 0 THEN 'ab-12/c' WHEN 1 THEN 'x-' END",
}
_SUM = "list_sum(list_transform(range(1, length(d)), lambda i: CAST(substr(reverse(substr(d, 1, length(d) - 1)), i, 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))"
_MODEL = r"""upper(list_filter(list_transform(regexp_split_to_array(title, '[\s\x{00A0},()\[\]]+'), lambda t: regexp_replace(t, '[^A-Za-z0-9-]', '', 'g')),
    lambda t: length(t) BETWEEN 4 AND 24 AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+(?:gb|tb|mb|kg|lb|ml|oz|cm|mm|in|ft|hz|w|k|p|pc|pk|ct)$', 'i'))[1])"""


@query(
    "q52_product_key",
    f"""WITH c AS (SELECT *, regexp_replace(gtin, '[^0-9]', '', 'g') AS d, upper(regexp_replace(mpn, '[^A-Za-z0-9]', '', 'g')) AS m,
            regexp_replace(lower(strip_accents(p_brand)), '[^a-z0-9]', '', 'g') AS b, {_MODEL} AS model
            FROM (SELECT p_partkey, p_brand, title, {", ".join(f"{v} AS {k}" for k, v in _CODES.items())} FROM ({shelf.parts_sql(shelf.CATEGORY_TEXTS)}))),
        k AS (SELECT *, CASE WHEN length(b) >= 2 THEN b || ':' ELSE '' END AS maker FROM c)
        SELECT p_partkey, CASE WHEN length(d) IN (8, 12, 13, 14) AND (10 - CAST({_SUM} AS INTEGER) % 10) % 10 = CAST(right(d, 1) AS INTEGER) THEN 'gtin:' || lpad(d, 14, '0')
            WHEN regexp_full_match(asin, '[A-Za-z0-9]{{10}}') THEN 'asin:' || upper(asin) WHEN length(m) >= 3 THEN 'mpn:' || maker || m WHEN model IS NOT NULL THEN 'model:' || maker || model END AS value
        FROM k""",
)
def _identity(spark, sf_dir):
    rows = shelf.parts(spark, sf_dir, shelf.CATEGORY_TEXTS)
    codes = {k: F.expr(v) for k, v in _CODES.items()}
    return rows.select("p_partkey", scalars.identity(F.col("title"), F.col("p_brand"), codes["gtin"], codes["mpn"], codes["asin"])["key"].alias("value"))


_JOINED = "coalesce(title, '') || ' ' || coalesce(description, '')"
_KNOWN = "CASE " + " ".join(f"WHEN merchant IN ({', '.join(map(quoted, slugs))}) THEN '{name}'" for name, slugs in rules.MERCHANT_HINTS.items()) + " END"


@query(
    "q54_category_rules",
    f"""WITH t AS (SELECT *, {_JOINED} || ' ' || coalesce(hint, '') AS body FROM ({shelf.parts_sql(shelf.CATEGORY_TEXTS)})),
        hits AS (SELECT p_partkey, name, place, weight + (count(*) - 1) * 2 AS score FROM t, (VALUES {_values((n, i, w, p) for i, (n, w, ps) in enumerate(rules.CATEGORY_RULES) for p in ps)}) r(name, place, weight, pattern)
            WHERE regexp_matches(body, pattern, 'i') GROUP BY p_partkey, name, place, weight),
        best AS (SELECT p_partkey, arg_max(name, score * 100 - place) AS name, max(score) AS score FROM hits GROUP BY p_partkey)
        SELECT p_partkey, CASE WHEN name IS NULL THEN coalesce({_KNOWN}, 'other') WHEN score <= 7 THEN coalesce({_KNOWN}, name) ELSE name END AS value FROM t LEFT JOIN best USING (p_partkey)""",
)
def _category(spark, sf_dir):
    rows = shelf.parts(spark, sf_dir, shelf.CATEGORY_TEXTS)
    return rows.select("p_partkey", rules.category(F.col("title"), F.col("description"), F.col("merchant"), F.col("hint")).alias("value"))


def _first(rows) -> str:
    return f"(VALUES {_values((i, name, pattern) for i, (name, pattern) in enumerate(rows))}) r(place, name, pattern)"


@query(
    "q55_department_rules",
    f"""WITH t AS (SELECT *, {_JOINED} AS body, CASE p_partkey % 4 WHEN 0 THEN 'clothing' WHEN 1 THEN 'grocery' WHEN 2 THEN 'baby-kids' END AS kind FROM ({shelf.parts_sql(shelf.DEPARTMENT_TEXTS)})),
        told AS (SELECT p_partkey, arg_min(name, place) AS told FROM t, {_first(rules.DEPARTMENT_HINTS)} WHERE regexp_matches(hint, pattern, 'i') GROUP BY p_partkey),
        read AS (SELECT p_partkey, arg_min(name, place) AS read FROM t, {_first((n, p) for n, ps in rules.DEPARTMENT_RULES for p in ps)} WHERE regexp_matches(body, pattern, 'i') GROUP BY p_partkey)
        SELECT p_partkey, coalesce(told, read, CASE WHEN merchant IN ({", ".join(map(quoted, rules.ONE_DEPARTMENT["women"]))}) THEN 'women' WHEN merchant IN ({", ".join(map(quoted, rules.ONE_DEPARTMENT["men"]))}) THEN 'men' END,
            CASE WHEN kind IN ('clothing', 'shoes-accessories', 'baby-kids') THEN 'unisex' ELSE 'na' END) AS value FROM t LEFT JOIN told USING (p_partkey) LEFT JOIN read USING (p_partkey)""",
)
def _department(spark, sf_dir):
    rows = shelf.parts(spark, sf_dir, shelf.DEPARTMENT_TEXTS)
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'clothing' WHEN 1 THEN 'grocery' WHEN 2 THEN 'baby-kids' END")
    return rows.select("p_partkey", rules.department(F.col("title"), F.col("description"), F.col("hint"), F.col("merchant"), kind).alias("value"))


@query(
    "q56_keywords",
    f"""WITH s AS (SELECT *, regexp_extract(trim(coalesce(description, '')), '^(.*?[.!?])(\\s|$)', 1, 's') AS stop FROM ({shelf.parts_sql(shelf.KEYWORD_TEXTS)})),
        d AS (SELECT *, CASE WHEN stop <> '' THEN stop ELSE trim(coalesce(description, '')) END AS first FROM s),
        t AS (SELECT p_partkey, title || ' ' || CASE WHEN length(first) <= {rules.DEFINITION_CHARS} THEN first ELSE '' END || ' ' || coalesce(hint, '') AS body FROM d),
        found AS (SELECT DISTINCT p_partkey, term FROM t, (VALUES {_values((term, _re2(p)) for term, ps in rules.KEYWORDS.items() for p in ps)}) r(term, pattern) WHERE regexp_matches(body, pattern, 'i'))
        SELECT p_partkey, ' ' || string_agg(term, ' ' ORDER BY term) || ' ' AS value FROM t LEFT JOIN found USING (p_partkey) GROUP BY p_partkey""",
)
def _keywords(spark, sf_dir):
    rows = shelf.parts(spark, sf_dir, shelf.KEYWORD_TEXTS)
    return rows.select("p_partkey", rules.keywords(F.col("title"), F.col("description"), F.col("hint")).alias("value"))


_BRANDS = ["", *rules.BRANDS, "snapple", "Sony LG", "HP DeWalt!", "(Apple) Bosch", "levi's jeans", "mellow melissa & doug"]


@query(
    "q57_brand",
    f"""WITH t AS ({shelf.parts_sql(_BRANDS)}),
        b AS (SELECT p_partkey, arg_min(name, place) AS value FROM t, (VALUES {_values((i, n) for i, n in enumerate(sorted(rules.BRANDS, key=lambda x: -len(x))))}) r(place, name)
            WHERE regexp_matches(title, '(^|[^\\w])' || regexp_escape(name) || '([^\\w]|$)', 'i') GROUP BY p_partkey)
        SELECT p_partkey, value FROM t LEFT JOIN b USING (p_partkey)""",
)
def _brand(spark, sf_dir):
    return shelf.parts(spark, sf_dir, _BRANDS).select("p_partkey", rules.brand("title").alias("value"))


def _coupon_sql() -> str:
    found = " UNION ALL ".join(f"SELECT p_partkey, t, {i} AS place, regexp_extract(t, {quoted(p)}, 0, 'i') AS phrase, upper(regexp_extract(t, {quoted(p)}, 1, 'i')) AS code FROM t" for i, p in enumerate(rules.COUPONS))
    return rf"""WITH t AS (SELECT p_partkey, trim(({listed(shelf.COUPON_TEXTS)})[CAST(p_partkey % {len(shelf.COUPON_TEXTS)} AS INTEGER) + 1] || ' ' || p_name) AS t FROM part), f AS ({found}),
        s AS (SELECT p_partkey, arg_min({{'code': code, 'phrase': phrase}}, place) AS x FROM f WHERE code <> '' AND regexp_matches(code, '[A-Z]') AND code NOT IN ({", ".join(map(quoted, rules.NOT_CODES))})
            AND NOT (regexp_matches(code, '^[A-Z]{{1,3}}-?[0-9]{{3,}}-?[A-Z]*$') AND contains(code, '-')) AND NOT regexp_matches(t, {quoted(rules.NO_COUPON)}, 'i') GROUP BY p_partkey)
        SELECT p_partkey, x.code AS code, trim(regexp_replace(substr(t, 1, strpos(t, x.phrase) - 1) || substr(t, strpos(t, x.phrase) + length(x.phrase)), '\s{{2,}}', ' ', 'g')) AS rest FROM t LEFT JOIN s USING (p_partkey)"""


@query("q58_coupon", _coupon_sql())
def _coupon(spark, sf_dir):
    body = F.concat(shelf.pick(shelf.COUPON_TEXTS, "p_partkey"), F.lit(" "), F.col("p_name"))
    found = shelf.mart.parts(spark, sf_dir).select("p_partkey", rules.coupon(body).alias("x"))
    return found.select("p_partkey", "x.code", F.col("x.text").alias("rest"))


# Addresses and pages --------------------------------------------------------------------------


def _unwrapped(table: str) -> str:
    """One step out of a redirect."""
    cases = " ".join(f"WHEN host = '{site}' OR ends_with(host, '.{site}') THEN regexp_extract(query, '(?:^|&){parameter}=([^&]*)', 1)" for site, parameter in reversed(text.WRAPPERS.items()))
    return f"""SELECT page_id, raw, CASE WHEN regexp_matches(inner_url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN inner_url ELSE url END AS url FROM (SELECT page_id, raw, url, url_decode(CASE {cases} ELSE '' END) AS inner_url
        FROM (SELECT page_id, raw, url, lower(regexp_extract(url, '{_URL}', 2)) AS host, regexp_extract(url, '{_URL}', 5) AS query FROM ({table})))"""


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_OWN = " ".join(f"WHEN site = '{site}' OR ends_with(site, '.{site}') THEN {listed(names)}" for site, names in reversed(text.SITE_TRACKING.items()))
_CANONICAL = rf"""(WITH parted AS (SELECT page_id, raw, lower(regexp_extract(url, '{_URL}', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '{_URL}', 2)), '^www\.', '') AS site, regexp_extract(url, '{_URL}', 3) AS port,
        CASE WHEN regexp_extract(url, '{_URL}', 4) = '' THEN '/' ELSE regexp_extract(url, '{_URL}', 4) END AS path, string_split(regexp_extract(url, '{_URL}', 5), '&') AS query
        FROM ({_unwrapped(_unwrapped(_unwrapped(f"SELECT page_id, trim(url) AS raw, trim(url) AS url FROM ({shelf.ADDRESSES_SQL})")))})),
    kept AS (SELECT *, list_filter(list_transform(query, lambda p, i: {{'k': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': CASE WHEN contains(p, '=') THEN p ELSE p || '=' END}}),
        lambda x: x.p <> '=' AND NOT list_contains({listed(text.TRACKING)}, lower(x.k)) AND NOT list_contains(CASE {_OWN} ELSE [] END, lower(x.k))) AS params FROM parted),
    joined AS (SELECT *, array_to_string(list_transform(list_sort(params), lambda x: x.p), '&') AS q, 'https://' || site || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END AS base FROM kept)
    SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') OR site = '' THEN raw WHEN q <> '' THEN base || path || '?' || regexp_replace(q, '/$', '')
        WHEN path = '/' THEN base || path ELSE base || regexp_replace(path, '/$', '') END AS canonical_url FROM joined)"""


@query("q42_canonical_url", f"SELECT * FROM {_CANONICAL}")
def _canonical(spark, sf_dir):
    return shelf.addresses(spark, sf_dir).select("page_id", text.canonical_url("url").alias("canonical_url"))


@query("q44_url_dedupe", f"SELECT canonical_url, min(page_id) AS page_id, count(*) AS pages FROM {_CANONICAL} GROUP BY canonical_url")
def _url_dedupe(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy("canonical_url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("pages"))


@query(
    "q50_dedupe_clusters",
    f"""WITH RECURSIVE keys AS (SELECT page_id AS id, 'u:' || canonical_url AS key FROM {_CANONICAL} UNION SELECT page_id, 'm:' || CAST(page_id % 40 AS VARCHAR) FROM pages WHERE page_id % 3 = 0 UNION SELECT page_id, 'n:' || CAST(page_id // 50 AS VARCHAR) FROM pages WHERE page_id % 5 = 0),
        edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b USING (key)),
        reach AS (SELECT id AS a, id AS b FROM keys UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
        SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a""",
)
def _clusters(spark, sf_dir):
    page = F.col("page_id")
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("u:"), "canonical_url"),
            F.when(page % 3 == 0, F.concat(F.lit("m:"), (page % 40).cast("string"))),
            F.when(page % 5 == 0, F.concat(F.lit("n:"), F.floor(page / 50).cast("string"))),
        )
    )
    return dedupe.clusters(_canonical(spark, sf_dir).select(page.alias("id"), F.explode(keys).alias("key")))


@query(
    "q62_html_links",
    rf"""SELECT DISTINCT page_id, CASE WHEN regexp_matches(link, '^https?://', 'i') THEN link WHEN starts_with(link, '//') THEN 'https:' || link
            WHEN starts_with(link, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || link
            ELSE rtrim(regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/)?)', 1), '/') || '/' || link END AS link
        FROM (SELECT page_id, url, trim(raw) AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)', 1)) AS raw FROM ({shelf.PAGES_SQL}))
            WHERE NOT regexp_matches(raw, '^(?:javascript|mailto|tel):', 'i'))""",
)
def _links(spark, sf_dir):
    return shelf.pages(spark, sf_dir).select("page_id", F.explode(payloads.links(F.col("html"), F.col("url"))).alias("link"))


@query(
    "q63_probe_platform",
    f"SELECT page_id, coalesce(arg_min(name, place), 'unknown') AS platform FROM ({shelf.PAGES_SQL}) LEFT JOIN {_first(payloads.PLATFORMS)} ON regexp_matches(html, pattern) GROUP BY page_id",
)
def _probe(spark, sf_dir):
    return shelf.pages(spark, sf_dir).select("page_id", payloads.platform(F.col("html")).alias("platform"))
