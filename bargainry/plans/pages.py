"""Queries on what pages, tools, logs, the catalogue and evaluation show, and the whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, places, scalars, text
from ..operators import dealquery as dq
from ..operators import dedupe, evaluate, mutations, normalize, present, runlog, sets, verify
from ..operators.dealquery import DealQuery
from ..schemas import SOURCE_RUNS, USAGE
from ..streaming import ingest
from . import mart
from .mart import oracle
from .queries import _FRESH, _RELATED, _km, NOW, query, related, verified

_SHOWN = f"(SELECT *, 'deal-' || id AS slug, 'https://x.ca/' || id AS url, merchant_id AS store_id FROM {_RELATED.format('verified')})"


def _shown(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """Verified deals with relations, as pages see them; with ``of``, those of its products only."""
    rows = related(spark, sf_dir, verified(spark, sf_dir, of))
    return rows.withColumns({"slug": F.concat(F.lit("deal-"), "id"), "url": F.concat(F.lit("https://x.ca/"), "id"), "store_id": F.col("merchant_id")})


def _kept(shown: DataFrame) -> DataFrame:
    """Shown deals, written once without the texts that their other columns tell, which are added again."""
    told = [c for c in ("slug", "url", "store_id", "quality_note") if c in shown.columns]
    rows = dedupe.saved(shown.drop(*told))
    texts = {"slug": F.concat(F.lit("deal-"), "id"), "url": F.concat(F.lit("https://x.ca/"), "id"), "store_id": F.col("merchant_id"), "quality_note": verify.quality_note()}
    return rows.withColumns({c: texts[c] for c in told}).select(*shown.columns)


def _money(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} = 0 THEN 'Free' ELSE '$' || format('{{:,.2f}}', {c} / 100.0::DOUBLE) END"


_HEADLINE = """CASE WHEN verdict <> 'inflated-anchor' THEN CAST(floor(CASE WHEN market_discount_pct > 0 THEN market_discount_pct WHEN discount_pct > 0 THEN discount_pct END + 0.5) AS BIGINT) END"""
_WAS = "price_was IS NOT NULL AND verdict <> 'inflated-anchor'"


@query(
    "q80_summaries",
    oracle(
        f"""SELECT id, coalesce(merchant_name, 'Unknown store') AS store, {_money("price_now")} AS price, CASE WHEN {_WAS} THEN {_money("price_was")} END AS was_price,
            CASE WHEN verdict <> 'inflated-anchor' THEN coalesce(market_discount_pct, discount_pct) END AS discount_pct, coupon_code AS coupon FROM {_SHOWN}""",
        "merchants", "verified",
    ),
)
def _summaries(spark, sf_dir):
    return present.summarize(_shown(spark, sf_dir)).select("id", "store", "price", "was_price", "discount_pct", "coupon")


@query("q81_headline_discount", oracle(f"SELECT id, {_HEADLINE} AS headline, {_WAS} AS shows_was, CASE WHEN market_discount_pct > 0 THEN 'verified' ELSE 'claimed' END AS confidence FROM {_SHOWN}", "merchants", "verified"))
def _headlines(spark, sf_dir):
    return _shown(spark, sf_dir).select("id", present.headline_discount().alias("headline"), present.shows_was().alias("shows_was"), present.confidence().alias("confidence"))


@query(
    "q82_serialized",
    oracle(
        f"SELECT id, 'deal-' || id AS slug, merchant_slug AS merchant, price_now AS now, 'CAD' AS currency, discount_pct AS claimed, market_price AS market, verdict, source, heat FROM {_SHOWN}",
        "merchants", "verified",
    ),
)
def _serialized(spark, sf_dir):
    deal = present.serialize(_shown(spark, sf_dir)).select("id", F.to_json("deal").alias("json"))
    # read back in one pass over each text
    shape = "slug string, merchant struct<slug:string>, price struct<now:long,currency:string>, verification struct<claimedDiscountPct:double,marketPrice:long,verdict:string>, source string, heat double"
    return deal.select("id", F.from_json("json", shape).alias("d")).select(
        "id", "d.slug", F.col("d.merchant.slug").alias("merchant"), "d.price.now", "d.price.currency", F.col("d.verification.claimedDiscountPct").alias("claimed"),
        F.col("d.verification.marketPrice").alias("market"), "d.verification.verdict", "d.source", "d.heat",
    )


@query("q83_page_and_total", oracle(f"SELECT id, heat, (SELECT count(*) FROM verified WHERE {_FRESH}) AS total FROM verified WHERE {_FRESH} ORDER BY heat DESC, id LIMIT 24 OFFSET 24", "verified"))
def _page(spark, sf_dir):
    return present.page(verified(spark, sf_dir), DealQuery(limit=24, offset=24), NOW).select("id", "heat", "total")


_BEST = "CASE verdict WHEN 'verified-low' THEN 3 WHEN 'verified-good' THEN 2 WHEN 'market-price' THEN 1 ELSE 0 END DESC, coalesce(market_discount_pct, 0) DESC, id"


@query(
    "q84_deal_page",
    oracle(
        f"""SELECT 'deal' AS part, id, {_HEADLINE} AS headline, last_seen_at < TIMESTAMP '{mart.NOW}' - INTERVAL 3 DAY AS unconfirmed FROM {_SHOWN} WHERE id = (SELECT min(id) FROM deals)
            UNION ALL (SELECT 'related', id, NULL, NULL FROM verified WHERE {_FRESH} AND category = (SELECT category FROM deals ORDER BY id LIMIT 1) ORDER BY {_BEST} LIMIT 4)""",
        "merchants", "verified",
    ),
)
def _deal_page(spark, sf_dir):
    deals = mart.deals(spark, sf_dir)
    id, category = deals.agg(F.min(F.struct("id", "category"))).select("*").first()[0]
    points = mart.price_points(spark, sf_dir).select("id", F.lit("none").alias("deal_id"), "price", "observed_at")
    own, _, alike = present.deal_page(_shown(spark, sf_dir, deals.where(F.col("category") == category)), points, f"deal-{id}", NOW)
    rows = own.select(F.lit("deal").alias("part"), "id", F.col("headline_discount").alias("headline"), "unconfirmed")
    return rows.unionByName(alike.select(F.lit("related").alias("part"), "id"), allowMissingColumns=True)


@query(
    "q85_home_page",
    oracle(
        f"""(SELECT 'best' AS part, id AS key, NULL AS n FROM verified WHERE {_FRESH} ORDER BY {_BEST} LIMIT 3) UNION ALL SELECT 'merchant', merchant_slug, count(*) FROM {_SHOWN} WHERE {_FRESH} AND merchant_slug <> '' GROUP BY 2
            UNION ALL SELECT 'health', source, count(*) FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY started_at DESC) AS r FROM source_runs) WHERE r = 1 GROUP BY 2 UNION ALL SELECT 'seeds', '', 0""",
        "merchants", "verified", "source_runs",
    ),
)
def _home(spark, sf_dir):
    parts = present.home_page(_shown(spark, sf_dir), mart.source_runs(spark, sf_dir), DealQuery(limit=24), NOW)
    rows = parts["best"].select(F.lit("best").alias("part"), F.col("id").alias("key"), F.lit(None).cast("long").alias("n"))
    rows = rows.unionByName(parts["merchants"].select(F.lit("merchant").alias("part"), F.col("value").alias("key"), F.col("count").alias("n")))
    rows = rows.unionByName(parts["health"].groupBy(F.lit("health").alias("part"), F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    return rows.unionByName(parts["seeds"].select(F.lit("seeds").alias("part"), F.lit("").alias("key"), F.col("total").alias("n")))


@query("q86_coupon_groups", oracle(f"SELECT id, coalesce(merchant_name, 'Other stores') AS \"group\", count(*) OVER (PARTITION BY merchant_name) AS group_size FROM (SELECT * FROM {_SHOWN} WHERE {_FRESH} AND coupon_code <> '' ORDER BY coalesce(expires_at, TIMESTAMP '9999-12-31'), id LIMIT 100)", "merchants", "verified"))
def _coupon_groups(spark, sf_dir):
    return present.coupon_page(_shown(spark, sf_dir), NOW).select("id", "group", "group_size")


@query("q87_store_page", oracle(f"SELECT id, count(*) OVER () AS total FROM (SELECT * FROM {_SHOWN} WHERE {_FRESH} AND store_id = '7') ORDER BY heat DESC, id LIMIT 48", "merchants", "verified"))
def _store_page(spark, sf_dir):
    return present.store_page(_shown(spark, sf_dir), "7", NOW).select("id", "total")


@query("q88_comparison", oracle(f"SELECT id, title, coalesce(merchant_name, 'Unknown store') AS store, {_money('price_now')} AS price, verdict FROM {_SHOWN} WHERE id IN (SELECT unnest([min(id), max(id)]) FROM deals)", "merchants", "verified"))
def _comparison(spark, sf_dir):
    deals = mart.deals(spark, sf_dir)
    ids = list(deals.agg(F.min("id"), F.max("id")).first())
    return present.compare(_shown(spark, sf_dir, dq.by_ids(deals, ids)), ids).select("id", "title", "store", "price", "verdict")


@query("q89_escaped", """SELECT event_id, replace('{"t":"<b>' || event_type || '</b>","n":' || event_id || '}', '<', '\\u003c') AS payload FROM events""")
def _escaped(spark, sf_dir):
    rows = mart.table(spark, sf_dir, "events")
    json = F.to_json(F.struct(F.concat(F.lit("<b>"), "event_type", F.lit("</b>")).alias("t"), F.col("event_id").alias("n")))
    return rows.select("event_id", present.escaped(json).alias("payload"))


@query("q90_notes", oracle(
    f"""SELECT id, CASE WHEN price_now IS NULL THEN 'No price available to compare.'
        WHEN verdict = 'verified-low' AND history_days >= 1 THEN 'Lowest price we''ve recorded in ' || CAST(CAST(floor(history_days + 0.5) AS BIGINT) AS VARCHAR) || ' days.' WHEN verdict = 'verified-low' THEN 'Lowest price we''ve recorded.'
        WHEN verdict = 'verified-good' THEN regexp_replace(CAST(market_discount_pct AS VARCHAR), '\\.0$', '') || '% below the ' || m || ' median across ' || competitors || ' other ' || CASE WHEN competitors = 1 THEN 'store' ELSE 'stores' END || '.'
        WHEN verdict = 'market-price' THEN 'In line with the ' || m || ' median at ' || competitors || ' other stores.' WHEN verdict = 'above-market' THEN 'Cheaper elsewhere — ' || m || ' median at ' || competitors || ' other stores.'
        WHEN verdict = 'inflated-anchor' THEN 'The $' || format('{{:.2f}}', price_was / 100.0::DOUBLE) || ' "was" price looks inflated: this sells for about ' || m || ' elsewhere.'
        ELSE 'Not enough independent data yet — this is the retailer''s own claim.' END AS note FROM (SELECT *, '$' || format('{{:.2f}}', coalesce(market_price, 0) / 100.0::DOUBLE) AS m FROM verified)""", "verified"))  # fmt: skip
def _notes(spark, sf_dir):
    return verified(spark, sf_dir).select("id", F.col("quality_note").alias("note"))


_MORE = {
    "q91_filter_category": (DealQuery(categories=("ECONOMY", "SMALL")), "category IN ('ECONOMY', 'SMALL')"),
    "q91b_filter_store_source": (DealQuery(stores=("1", "2", "3"), sources=("lineitem",)), "store_id IN ('1', '2', '3') AND source = 'lineitem'"),
    "q91c_filter_verified": (DealQuery(verified_only=True), "verdict IN ('verified-low', 'verified-good')"),
    "q91d_filter_verdicts": (DealQuery(verdicts=("above-market", "unverified"), exclude_suspect=True), "verdict IN ('above-market', 'unverified') AND NOT claim_suspect"),
    "q91e_filter_merchant": (DealQuery(merchants=("Supplier#000000001", "Supplier#7")), "merchant_slug IN ('Supplier#000000001', 'Supplier#7')"),
    "q91f_search_everywhere": (DealQuery(search="  RÉd  "), "(contains(' ' || lower(title), ' red') OR contains(' ' || lower(description), ' red') OR contains(' ' || lower(merchant_name), ' red') OR contains(' ' || lower(brand), ' red') OR contains(keywords, ' red '))"),
    "q91g_filter_department": (DealQuery(departments=("men", "na")), "department IN ('men', 'na')"),
}
_FIELDS = {"description": "CASE WHEN votes % 2 = 0 THEN 'A redder thing' ELSE 'bored' END", "keywords": "CASE WHEN votes % 3 = 0 THEN ' red table ' ELSE ' tablered ' END", "department": "CASE votes % 3 WHEN 0 THEN 'men' WHEN 1 THEN 'na' ELSE 'women' END"}


def _filter(name: str, q: DealQuery, condition: str) -> None:
    fields = ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items())

    @query(name, oracle(f"SELECT id, verdict FROM (SELECT *, {fields} FROM {_SHOWN}) WHERE {_FRESH} AND {condition}", "merchants", "verified"))
    def run(spark, sf_dir):
        rows = _shown(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _FIELDS.items()})
        return dq.matching(rows, q, NOW).select("id", "verdict")


for _name, _parts in _MORE.items():
    _filter(_name, *_parts)


# Logs, counts, catalogue ----------------------------------------------------------------------

_OUTCOMES = "SELECT event_type AS source, count(*) AS items_found, count_if(value > 400) AS items_dropped FROM events GROUP BY event_type"


def _outcomes(spark, sf_dir) -> DataFrame:
    rows = mart.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("items_found"), F.count_if(F.col("value") > 400).alias("items_dropped"))
    return rows.withColumns({"started_at": mart.now(), "outcome": F.lit("ok"), "items_new": F.lit(None).cast("long"), "items_updated": F.lit(2).cast("long")})


@query("q92_append_runs", oracle(f"SELECT id, source, items_found, NULL AS items_new, NULL AS items_dropped FROM source_runs UNION ALL SELECT sha1(source || '|' || '{mart.NOW}'), source, items_found, 0, items_dropped FROM ({_OUTCOMES})", "source_runs"))
def _append_runs(spark, sf_dir):
    fields = [f.split() for f in SOURCE_RUNS.split(", ")]
    stored = mart.source_runs(spark, sf_dir)
    stored = stored.select(*[(F.col(n) if n in stored.columns else F.lit(None)).cast(k).alias(n) for n, k in fields])
    return runlog.append_runs(stored, _outcomes(spark, sf_dir)).select("id", "source", "items_found", "items_new", "items_dropped")


@query("q92b_append_usage", oracle(f"SELECT sha1(conversation_id || '|' || '{mart.NOW}' || '|' || model) AS id, conversation_id, output_tokens FROM usage", "usage"))
def _append_usage(spark, sf_dir):
    turns = mart.usage(spark, sf_dir).withColumn("created_at", mart.now())
    return runlog.append_usage(spark.createDataFrame([], USAGE), turns).select("id", "conversation_id", "output_tokens")


@query("q93_run_totals", f"SELECT count(*) AS sources, CAST(sum(items_found) AS BIGINT) AS total_found, 0 AS total_new, 2 * count(*) AS total_updated, CAST(sum(items_dropped) AS BIGINT) AS total_dropped FROM ({_OUTCOMES})")
def _totals(spark, sf_dir):
    return runlog.totals(_outcomes(spark, sf_dir))


@query("q94_reap_preview", oracle(f"SELECT count_if(status = 'active') AS active, count_if({_FRESH}) AS listed, count_if(status = 'active' AND last_seen_at < TIMESTAMP '{mart.NOW}' - INTERVAL 72 HOUR) AS unseen FROM deals", "deals"))
def _preview(spark, sf_dir):
    return runlog.reap_preview(mart.deals(spark, sf_dir), mart.now())


@query("q95_seed_share", oracle("SELECT count_if(votes = 1) AS seeds, count(*) AS total, count_if(votes = 1) = count(*) AND count(*) > 0 AS only_samples FROM deals", "deals"))
def _seeds(spark, sf_dir):
    return runlog.seed_share(mart.deals(spark, sf_dir).withColumn("source", F.when(F.col("votes") == 1, "seed").otherwise("shop")))


_PROBES = "SELECT event_id AS id, event_type AS source, event_id % 5 <> 0 AS enabled, CAST(floor(value) AS BIGINT) % 3 AS items, CASE event_id % 7 WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'Robots.txt' WHEN 3 THEN 'timeout' END AS error FROM events"
_PROBED = f"SELECT *, CASE WHEN NOT enabled THEN 'skipped' WHEN regexp_matches(error, '403|blocked|forbidden|robots', 'i') THEN 'blocked' WHEN error IS NOT NULL THEN 'error' WHEN items = 0 THEN 'empty' ELSE 'ok' END AS status FROM ({_PROBES})"


def _probed(spark, sf_dir):
    rows = mart.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("event_id") % 5 != 0).alias("enabled"), (F.floor("value") % 3).alias("items"),
        F.expr("CASE event_id % 7 WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'Robots.txt' WHEN 3 THEN 'timeout' END").alias("error"),
    )
    return runlog.classify_probes(rows)


@query("q96_probe_status", f"SELECT id, status FROM ({_PROBED})")
def _probe_status(spark, sf_dir):
    return _probed(spark, sf_dir).select("id", "status")


@query("q96b_probe_rollup", f"SELECT count_if(status = 'ok') AS healthy, count_if(status NOT IN ('ok', 'skipped')) AS broken, count_if(status = 'skipped') AS skipped, false AS all_failed FROM ({_PROBED})")
def _rollup(spark, sf_dir):
    return runlog.probe_rollup(_probed(spark, sf_dir))


@query("q97_sources_of_families", "SELECT s_name AS source, CASE WHEN contains(s_name, '1') THEN '1' ELSE '42' END AS family_label FROM supplier WHERE contains(s_name, '1') OR contains(s_name, '42')")
def _families(spark, sf_dir):
    return runlog.sources_of(mart.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source")), ["1", "42"])


_CATALOGUE = """SELECT s_suppkey AS place, 'r' || (s_suppkey % 77) AS id, CASE WHEN s_suppkey % 11 <> 3 THEN s_name END AS name, CASE WHEN s_suppkey % 13 = 5 THEN 'Amazon.ca' ELSE 'd' || (s_suppkey % 61) || '.ca' END AS domain,
    'https://x.ca' AS base_url, CASE s_suppkey % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'sfcc' ELSE 'magento' END AS engine, CASE s_suppkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'working' ELSE 'unverified' END AS status,
    s_suppkey % 5 <> 0 AS enabled, s_name AS slug, CASE WHEN s_suppkey % 9 = 0 THEN 'api' END AS covered_by FROM supplier"""


def _catalogue(spark, sf_dir):
    n, k = F.col("s_suppkey"), (lambda m: (F.col("s_suppkey") % m).cast("string"))
    return mart.table(spark, sf_dir, "supplier").select(
        n.alias("place"), F.concat(F.lit("r"), k(77)).alias("id"), F.when(n % 11 != 3, F.col("s_name")).alias("name"), F.when(n % 13 == 5, "Amazon.ca").otherwise(F.concat(F.lit("d"), k(61), F.lit(".ca"))).alias("domain"),
        F.lit("https://x.ca").alias("base_url"), F.when(n % 3 == 0, "shopify").when(n % 3 == 1, "sfcc").otherwise("magento").alias("engine"), F.when(n % 4 == 0, "blocked").when(n % 4 == 1, "working").otherwise("unverified").alias("status"),
        (n % 5 != 0).alias("enabled"), F.col("s_name").alias("slug"), F.when(n % 9 == 0, "api").alias("covered_by"),
    )


_ENTRIES = """SELECT p_partkey AS place, CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN '' ELSE 'r' || (p_partkey % 700) END AS id, CASE WHEN p_partkey % 83 <> 0 THEN p_name END AS name,
    CASE WHEN p_partkey % 53 = 5 THEN 'Amazon.CA' ELSE 'd' || (p_partkey * 7 % 900) || '.ca' END AS domain, CASE WHEN p_partkey % 41 = 0 THEN 'not a url' WHEN p_partkey % 43 <> 0 THEN 'https://x.ca' END AS base_url,
    CASE WHEN p_partkey % 37 = 0 THEN 'nonsense' ELSE ['shopify', 'sfcc', 'feed'][p_partkey % 3 + 1] END AS engine, CASE WHEN p_partkey % 31 = 0 THEN '??' WHEN p_partkey % 3 > 0 THEN ['verified', 'blocked'][p_partkey % 2 + 1] END AS status,
    CASE WHEN p_partkey % 29 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 1.5 END AS rate_limit_rps, CASE WHEN p_partkey % 47 = 0 THEN -1 END AS max_product_pages, CASE WHEN p_partkey % 59 = 0 THEN 'x y' WHEN p_partkey % 4 = 0 THEN 'https://h.ca' END AS hybris_api_base,
    CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 5 <> 0 END AS enabled FROM part"""


def _entries(spark, sf_dir):
    n, k = F.col("p_partkey"), (lambda m: (F.col("p_partkey") % m).cast("string"))
    pick = lambda m, *values: F.get(F.array(*map(F.lit, values)), (n % m).cast("int"))
    return mart.table(spark, sf_dir, "part").select(
        n.alias("place"), F.when(n % 97 == 0, None).when(n % 89 == 0, "").otherwise(F.concat(F.lit("r"), k(700))).alias("id"), F.when(n % 83 != 0, F.col("p_name")).alias("name"),
        F.when(n % 53 == 5, "Amazon.CA").otherwise(F.concat(F.lit("d"), (n * 7 % 900).cast("string"), F.lit(".ca"))).alias("domain"), F.when(n % 41 == 0, "not a url").when(n % 43 != 0, "https://x.ca").alias("base_url"),
        F.when(n % 37 == 0, "nonsense").otherwise(pick(3, "shopify", "sfcc", "feed")).alias("engine"), F.when(n % 31 == 0, "??").when(n % 3 > 0, pick(2, "verified", "blocked")).alias("status"),
        F.when(n % 29 == 0, 0.0).when(n % 2 == 0, 1.5).alias("rate_limit_rps"), F.when(n % 47 == 0, -1).alias("max_product_pages"), F.when(n % 59 == 0, "x y").when(n % 4 == 0, "https://h.ca").alias("hybris_api_base"),
        F.when(n % 7 > 0, n % 5 != 0).alias("enabled"),
    )


#: One entry after the other, with the ids and domains that are taken.
_VALIDATED = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY place) AS n, list_filter([CASE WHEN coalesce(id, '') = '' THEN 'id is missing' END, CASE WHEN name IS NULL THEN 'name is missing' END,
        CASE WHEN base_url IS NULL THEN 'base_url is missing' WHEN base_url = 'not a url' THEN 'base_url is not a URL' END, CASE WHEN engine = 'nonsense' THEN 'engine is unknown' END, CASE WHEN hybris_api_base = 'x y' THEN 'hybris_api_base is not a URL' END,
        CASE WHEN rate_limit_rps <= 0 THEN 'rate_limit_rps is not positive' END, CASE WHEN max_product_pages <= 0 THEN 'max_product_pages is not positive' END, CASE WHEN status = '??' THEN 'status is unknown' END], lambda x: x IS NOT NULL) AS shape FROM ({_ENTRIES})),
    steps AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS ids, []::VARCHAR[] AS domains, []::VARCHAR[] AS errors UNION ALL
        SELECT n, CASE WHEN len(errors) = 0 THEN list_append(ids, id) ELSE ids END, CASE WHEN len(errors) = 0 THEN list_append(domains, domain) ELSE domains END, errors FROM (
            SELECT e.n, ids, domains, e.id, e.domain, CASE WHEN len(shape) > 0 THEN shape WHEN list_contains(ids, e.id) THEN ['duplicate id'] WHEN list_contains(domains, e.domain) THEN ['duplicate domain']
                WHEN coalesce(e.enabled, true) AND lower(e.domain) IN ('amazon.ca', 'amazon.com') THEN ['must not be crawled'] ELSE [] END AS errors FROM steps JOIN e ON e.n = steps.n + 1)),
    v AS (SELECT e.*, errors, errors[1] AS error FROM e JOIN steps USING (n))"""


@query("q98_catalogue_errors", f"{_VALIDATED} SELECT place, id, error, array_to_string(errors, '; ') AS errors FROM v")
def _validated(spark, sf_dir):
    return runlog.validate_catalogue(_entries(spark, sf_dir)).select("place", "id", "error", F.array_join("errors", "; ").alias("errors"))


@query("q98b_catalogue_runnable", f"{_VALIDATED} SELECT place, engine FROM v WHERE error IS NULL AND coalesce(enabled, true) AND coalesce(status, 'unverified') <> 'blocked'")
def _runnable(spark, sf_dir):
    return runlog.runnable(runlog.validate_catalogue(_entries(spark, sf_dir))).select("place", "engine")


@query("q99_catalogue_drift", f"SELECT place AS id, engine, CASE WHEN place % 6 <> 0 THEN 'sfcc' END AS detected, CASE WHEN place % 6 = 0 THEN 'unreachable' WHEN engine = 'sfcc' THEN 'ok' ELSE 'MISMATCH' END AS result FROM ({_CATALOGUE})")
def _drift(spark, sf_dir):
    rows = _catalogue(spark, sf_dir).withColumn("id", F.col("place"))
    return runlog.drift(rows, rows.where("place % 6 <> 0").select("id", F.lit("sfcc").alias("platform")))


@query(
    "q100_coverage",
    oracle(
        f"""SELECT slug, coalesce(n, 0) AS deals, CASE WHEN n > 0 THEN 'Live' WHEN covered_by IS NOT NULL THEN 'Dedicated adapter' WHEN NOT enabled THEN 'Not yet live'
            WHEN status = 'working' THEN 'Working' WHEN status = 'blocked' THEN 'Blocked' ELSE 'Unverified' END AS coverage FROM ({_CATALOGUE})
            LEFT JOIN (SELECT merchant_slug AS slug, count(*) AS n FROM {_RELATED.format("deals")} WHERE {_FRESH} AND merchant_id NOT LIKE '%3' GROUP BY 1) USING (slug)""",
        "merchants", "deals",
    ),
)
def _coverage(spark, sf_dir):
    facet = dq.facet(related(spark, sf_dir).where("merchant_id not like '%3'"), "merchant", NOW)
    return runlog.coverage(_catalogue(spark, sf_dir), facet).select("slug", "deals", "coverage")


_DIRECTORY = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS chain, CAST(c_custkey AS VARCHAR) AS source_store_id, c_name || ' new' AS name, 41 + c_custkey % 4300 / 100.0::DOUBLE AS lat, -142 + c_custkey % 9000 / 100.0::DOUBLE AS lng FROM customer"


@query(
    "q101_store_sync",
    f"""WITH d AS (SELECT * FROM ({_DIRECTORY}) WHERE {_km(51.0, -132.0)} <= 150), s AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS source_store_id, c_mktsegment AS chain, c_name AS name FROM customer WHERE c_custkey % 2 = 0)
        SELECT coalesce('old-' || k, d.id) AS id, coalesce(d.chain, s.chain) AS chain, coalesce(d.name, s.name) AS name FROM s FULL JOIN d USING (chain, source_store_id)""",
)
def _sync(spark, sf_dir):
    places_ = mart.stores(spark, sf_dir).withColumn("source_store_id", F.col("id"))
    stamps = {"created_at": mart.now(), "updated_at": mart.now()}
    old = places_.where("cast(id as long) % 2 = 0").withColumn("id", F.concat(F.lit("old-"), "id")).withColumns(stamps)
    new = places_.withColumn("name", F.concat("name", F.lit(" new"))).withColumns(stamps)
    return runlog.sync_stores(old, new, 51.0, -132.0, 150.0).select("id", "chain", "name")


@query(
    "q102_merchant_upsert",
    """SELECT domain, CASE WHEN k % 3 <> 0 THEN 'old' ELSE 'new' END || k AS id, CASE WHEN k % 2 = 0 THEN 'New ' || k ELSE 'Old ' || k END AS name, CASE WHEN k % 2 = 0 AND k % 5 = 0 THEN 'F' WHEN k % 3 <> 0 THEN 'G' END AS family
        FROM (SELECT s_suppkey AS k, 'd' || s_suppkey || '.ca' AS domain FROM supplier) WHERE k % 3 <> 0 OR k % 2 = 0""",
)
def _merchant_upsert(spark, sf_dir):
    k, text_of = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    rows = mart.table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(F.lit("d"), text_of, F.lit(".ca")).alias("domain"), F.concat(F.lit("old"), text_of).alias("id"), F.concat(F.lit("Old "), text_of).alias("name"), F.lit("G").alias("family"), F.lit("x").alias("status"), mart.now().alias("created_at"), mart.now().alias("updated_at"))
    new = rows.where("k % 2 = 0").withColumns({"id": F.concat(F.lit("new"), F.col("k").cast("string")), "name": F.concat(F.lit("New "), F.col("k").cast("string")), "family": F.when(F.col("k") % 5 == 0, "F")})
    return mutations.upsert_merchants(rows.where("k % 3 <> 0").drop("k"), new.drop("k")).select("domain", "id", "name", "family")


@query("q102b_heat_update", oracle("SELECT id, CASE WHEN votes = 1 THEN 1.5 ELSE discount_pct END AS heat FROM deals", "deals"))
def _heat(spark, sf_dir):
    rows = mart.deals(spark, sf_dir).withColumn("heat", F.col("discount_pct"))
    return mutations.update_heat(rows, rows.where("votes = 1").select("id", F.lit(1.5).alias("heat"))).select("id", "heat")


_SITE = "CASE p_partkey % 6 WHEN 0 THEN 'www.' ELSE '' END || 'Shop' || (p_partkey % 40) || CASE p_partkey % 4 WHEN 0 THEN '.ca' WHEN 1 THEN '.com' WHEN 2 THEN '.io' ELSE '.org' END"


@query(
    "q103_new_merchants",
    f"""WITH seen AS (SELECT regexp_replace(lower(site), '^www\\.', '') AS domain, min(nullif(trim(name), '')) AS name FROM (SELECT {_SITE} AS site, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS name FROM part) GROUP BY 1),
        new AS (SELECT *, trim(regexp_replace(regexp_replace(domain, '\\.(ca|com|net|org|co\\.uk)$', ''), '[^a-z0-9]+', '-', 'g'), '-') AS base, string_split(domain, '.')[-1] AS last FROM seen WHERE domain NOT IN ('shop4.ca', 'shop8.ca')),
        a AS (SELECT *, base NOT IN ('shop1', 'shop2-2', 'shop4', 'shop8', 'shop12-ca') AND row_number() OVER (PARTITION BY base ORDER BY domain) = 1 AS first FROM new),
        b AS (SELECT *, NOT first AND base || '-' || last NOT IN ('shop1', 'shop2-2', 'shop4', 'shop8', 'shop12-ca') AND base || '-' || last NOT IN (SELECT base FROM a WHERE first) AND row_number() OVER (PARTITION BY first, base || '-' || last ORDER BY domain) = 1 AS second FROM a),
        c AS (SELECT *, row_number() OVER (PARTITION BY first, second, base ORDER BY domain) AS turn FROM b)
        SELECT 'merchant:' || domain AS id, CASE WHEN first THEN base WHEN second THEN base || '-' || last ELSE base || '-' || (turn + 1 + CASE WHEN base = 'shop2' THEN 1 ELSE 0 END) END AS slug,
            coalesce(name, CASE WHEN first THEN base WHEN second THEN base || '-' || last ELSE base || '-' || (turn + 1 + CASE WHEN base = 'shop2' THEN 1 ELSE 0 END) END) AS name, domain FROM c""",
)
def _new_merchants(spark, sf_dir):
    seen = mart.table(spark, sf_dir, "part").select(F.expr(_SITE.replace("(p_partkey % 40)", "cast(p_partkey % 40 as string)")).alias("domain"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    held = [("a", "shop1", "elsewhere.ca"), ("b", "shop2-2", "two.ca"), ("c", "shop4", "shop4.ca"), ("d", "shop8", "www.shop8.ca"), ("e", "shop12-ca", "twelve.ca")]
    return normalize.new_merchants(seen, spark.createDataFrame(held, "id string, slug string, domain string"))


_COOKIES = """CASE k % 8 WHEN 0 THEN '{"lat":43.5,"lng":-79.25,"label":"Here","precision":"gps","storeIds":["a",1,"b"]}' WHEN 1 THEN '{"lat":"45","lng":"-75.5"}' WHEN 2 THEN '{"lat":10,"lng":-79}'
    WHEN 3 THEN 'no json' WHEN 4 THEN '{"lat":43,"lng":-79,"label":5}' WHEN 5 THEN '{"lat":84,"lng":-52,"label":"' || repeat('x', 70) || '"}' WHEN 6 THEN '[]' END"""


@query(
    "q104_stored_location",
    """SELECT c_custkey, CASE k WHEN 0 THEN 43.5 WHEN 1 THEN 45 WHEN 4 THEN 43 WHEN 5 THEN 84 END::DOUBLE AS lat, CASE k WHEN 0 THEN -79.25 WHEN 1 THEN -75.5 WHEN 4 THEN -79 WHEN 5 THEN -52 END::DOUBLE AS lng,
        CASE k WHEN 0 THEN 'Here' WHEN 1 THEN 'Your area' WHEN 4 THEN 'Your area' WHEN 5 THEN repeat('x', 60) END AS label, CASE WHEN k = 0 THEN 'gps' WHEN k IN (1, 4, 5) THEN 'fsa' END AS precision,
        CASE WHEN k = 0 THEN 'a,b' END AS stores FROM (SELECT c_custkey, c_custkey % 8 AS k FROM customer)""",
)
def _location(spark, sf_dir):
    cookie = F.url_encode(F.expr(_COOKIES.replace("k % 8", "c_custkey % 8")))
    rows = mart.table(spark, sf_dir, "customer").select("c_custkey", places.stored_location(cookie).alias("p"))
    return rows.select("c_custkey", "p.lat", "p.lng", "p.label", "p.precision", F.array_join("p.store_ids", ",").alias("stores"))


# Small functions ------------------------------------------------------------------------------


@query("q105_money_and_labels", f"""SELECT c_custkey, {_money("CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 1234567 END")} AS money,
    CASE WHEN c_custkey % 5 <> 0 THEN format('{{:.1f}} km', c_custkey / 7.0::DOUBLE) END AS far, upper(c_name[1]) AS initials, CASE c_custkey % 3 WHEN 0 THEN 'Women' WHEN 1 THEN '' ELSE 'pets' END AS department FROM customer""")  # fmt: skip
def _labels(spark, sf_dir):
    k = F.col("c_custkey")
    cents = F.when(k % 9 == 0, None).when(k % 7 == 0, 0).otherwise(k * 1234567)
    named = F.when(k % 3 == 0, "women").when(k % 3 == 1, "na").otherwise("pets")
    return mart.table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.format_cents(cents).alias("money"), labels.distance(F.when(k % 5 != 0, k / 7)).alias("far"), labels.initials("c_name").alias("initials"), labels.label(named, labels.DEPARTMENT_LABELS).alias("department")
    )


@query(
    "q106_links_and_times",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'https://go.ca/?u=https%3A%2F%2Fx.ca%2Fa%20b%3Fq%3D' || event_id ELSE 'https://x.ca/a b?q=' || event_id END AS affiliate,
        CASE event_id % 4 WHEN 0 THEN 'https://i.ca/1' WHEN 1 THEN 'https://i.ca/2' WHEN 2 THEN 'https://i.ca/3' END AS image,
        CASE WHEN event_id % 5 <> 4 THEN date_trunc('second', ts) END AS at FROM events""",
)
def _times(spark, sf_dir):
    k, at = F.col("event_id"), F.date_trunc("second", F.col("ts")).cast("timestamp")
    n = k.cast("string")
    image = F.when(k % 4 == 0, "//i.ca/1").when(k % 4 == 1, "http://i.ca/2").when(k % 4 == 2, " https://i.ca/3 ").otherwise("data:x")
    seconds = F.unix_seconds(at)
    written = (
        F.when(k % 5 == 0, seconds.cast("string")).when(k % 5 == 1, (seconds * 1000).cast("string")).when(k % 5 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 5 == 3, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    )
    return mart.table(spark, sf_dir, "events").select(
        "event_id", text.affiliate_url(F.concat(F.lit("https://x.ca/a b?q="), n), F.when(k % 2 == 0, "https://go.ca/?u={url}").otherwise("https://go.ca/")).alias("affiliate"),
        text.image_url(image).alias("image"), text.timestamp_of(written).alias("at"),
    )


@query("q107_difference", "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
def _difference(spark, sf_dir):
    return sets.difference(mart.table(spark, sf_dir, "orders").select("o_orderkey"), mart.table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


# Evaluation -----------------------------------------------------------------------------------

_CASES = "SELECT DISTINCT user_id AS case_id, CASE WHEN user_id % 5 = 0 THEN 'clarify' ELSE 'find' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, 'm' || (user_id % 4) AS model FROM events"
_SCORED = f"""WITH cases AS ({_CASES}), first AS (SELECT user_id AS case_id, event_id % 20 AS deal_id, min(event_id) AS pos FROM events GROUP BY ALL),
    placed AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY pos) AS place FROM first),
    said AS (SELECT user_id AS case_id, string_agg(event_type || CASE WHEN event_id % 3 = 0 THEN '? ' ELSE '. ' END, '' ORDER BY event_id) AS body FROM events GROUP BY user_id),
    met AS (SELECT case_id, count(*) AS surfaced, min(place) FILTER (place <= 6 AND deal_id = case_id % 20) AS hit_rank, count(*) FILTER (place <= 6 AND deal_id = (case_id + 7) % 20 AND case_id % 3 = 0) AS violations FROM placed GROUP BY case_id),
    scored AS (SELECT *, violations = 0 AND CASE WHEN kind = 'clarify' THEN clarified ELSE hit_rank IS NOT NULL END AS passed, CASE WHEN model <> 'm3' THEN (case_id * 200 + 7 * 1000 + 3 * 20 + 250) / 1000000.0::DOUBLE END AS cost_cents
        FROM (SELECT *, regexp_matches(trim(body), '\\?\\s*$|\\?\\s+\\S') AS clarified FROM cases JOIN met USING (case_id) JOIN said USING (case_id)))"""


def _scored(spark, sf_dir):
    events = mart.table(spark, sf_dir, "events")
    case = F.col("user_id").alias("case_id")
    n = F.col("user_id")
    cases = events.select(case, F.when(n % 5 == 0, "clarify").otherwise("find").alias("kind"), F.when(n % 2 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("m"), (n % 4).cast("string")).alias("model")).distinct()
    surfaced = events.select(case, F.col("event_id").alias("pos"), (F.col("event_id") % 20).alias("deal_id"))
    told = events.select(case, F.explode(F.array(F.struct(F.lit("acceptable").alias("kind"), (n % 20).cast("string").alias("source_id")), F.struct(F.lit("forbidden").alias("kind"), F.when(n % 3 == 0, ((n + 7) % 20).cast("string")).alias("source_id")))).alias("x")).select("case_id", "x.*").distinct()
    ids = spark.range(20).select(F.col("id").cast("string").alias("source_id"), "id")
    said = events.select(case, F.lit("text").alias("type"), F.col("event_id").alias("pos"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "? ").otherwise(". ")).alias("text"))
    scored = evaluate.score_cases(cases, surfaced, evaluate.label_ids(told, ids), evaluate.assistant_text(said))
    usage = scored.withColumns({"input_tokens": F.col("case_id"), "output_tokens": F.lit(7), "cache_read_tokens": F.lit(3), "cache_creation_tokens": F.lit(1), "tool_calls": F.col("surfaced")})
    rates = spark.createDataFrame([(f"m{i}", 200.0, 1000.0, 20.0, 250.0) for i in range(3)], "model string, input_rate double, output_rate double, cache_rate double, write_rate double")
    return evaluate.cost_cents(usage, rates)


@query("q108_scored_cases", f"{_SCORED} SELECT case_id, surfaced, hit_rank, violations, clarified, passed, cost_cents FROM scored")
def _scored_cases(spark, sf_dir):
    return _scored(spark, sf_dir).select("case_id", "surfaced", "hit_rank", "violations", "clarified", "passed", "cost_cents")


_REPORT = """SELECT model, coalesce(avg(passed::INT) FILTER (kind = 'find'), 0) AS recall, coalesce(avg(passed::INT) FILTER (kind = 'find' AND split = 'test'), 0) AS recall_test, coalesce(avg(passed::INT) FILTER (kind = 'clarify'), 0) AS clarify_rate,
    CAST(sum(violations) AS BIGINT) AS violations, CASE WHEN count(cost_cents) = count(*) THEN avg(cost_cents) END AS mean_cost_cents, avg(surfaced) AS mean_tool_calls FROM scored GROUP BY model"""


@query("q109_evaluation_report", f"{_SCORED} {_REPORT}")
def _report(spark, sf_dir):
    return evaluate.report(_scored(spark, sf_dir))


@query("q109b_best_model", f"{_SCORED} SELECT model FROM ({_REPORT}) ORDER BY recall >= 0.85 AND clarify_rate >= 0.8 DESC, CASE WHEN recall >= 0.85 AND clarify_rate >= 0.8 THEN mean_cost_cents END NULLS LAST, CASE WHEN NOT (recall >= 0.85 AND clarify_rate >= 0.8) THEN -recall END, model LIMIT 1")
def _best_model(spark, sf_dir):
    return evaluate.best_model(evaluate.report(_scored(spark, sf_dir))).select("model")


# The whole run --------------------------------------------------------------------------------

_FIRST_RUN = "2001-11-01 00:00:00"


def _raw(spark, sf_dir, condition: str) -> DataFrame:
    """Listings of the latest offers, one of a product and merchant."""
    from ..schemas import RAW
    from ..sources.payloads import as_raw

    # by product, so that listings of one text lie together
    rows = mart.offers(spark, sf_dir).where(condition).repartition("product_key")
    rows = mutations.last_of_each(rows, ["product_key", "merchant_id"], "observed_at", "id").withColumn("key", F.concat_ws("/", "product_key", "merchant_id"))
    site = F.concat(F.lit("m"), "merchant_id", F.lit(".ca"))
    dollars = lambda c: F.format_string("%.2f", F.col(c) / 100)
    return as_raw(
        rows, source=F.concat(F.lit("s"), (F.col("merchant_id").cast("long") % 3).cast("string")), source_id=F.col("key"), title=F.when(F.col("votes") == 7, "x").otherwise(F.concat(F.lit("Item P"), F.lpad("product_key", 7, "0"), F.lit(" of many"))),
        url=F.concat(F.lit("https://www."), site, F.lit("/p/"), "product_key", F.lit("?utm_source=x")), price=dollars("price_now"), price_was=dollars("price_was"), mpn=F.concat(F.lit("P"), F.lpad("product_key", 7, "0")),
        votes=F.col("votes").cast("double"), posted_at=F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )


def _two_runs(spark, sf_dir) -> ingest.Run:
    held = spark.createDataFrame([("1", "m1", "m1.ca"), ("2", "m2", "m2.ca")], "id string, slug string, domain string")
    first = ingest.run(_raw(spark, sf_dir, "observed_at < timestamp_ntz'2000-01-01'"), held, None, None, F.to_timestamp_ntz(F.lit(_FIRST_RUN)))
    saved = [ingest.dedupe.saved(df) for df in (first.deals, first.points, first.merchants, first.runs)]
    return ingest.run(_raw(spark, sf_dir, "observed_at >= timestamp_ntz'2000-01-01'"), saved[2], saved[0], saved[1], mart.now(), saved[3])


def _latest(name: str, condition: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, product_key || '/' || merchant_id AS key, row_number() OVER (PARTITION BY product_key, merchant_id ORDER BY observed_at DESC, id DESC) AS r FROM offers WHERE {condition}) WHERE r = 1)"


_OFFERS = oracle("", "offers").strip() + ",\n" + _latest("first_run", "observed_at < TIMESTAMP '2000-01-01'") + ",\n" + _latest("second_run", "observed_at >= TIMESTAMP '2000-01-01'")
_RUN = f"""{_OFFERS}, a AS (SELECT * FROM first_run WHERE votes <> 7), b AS (SELECT * FROM second_run WHERE votes <> 7),
    deals AS (SELECT * REPLACE (key AS id, CASE WHEN discount_pct IS NOT NULL THEN price_was END AS price_was), 'mpn' AS product_key_strength FROM b),
    price_points AS (SELECT product_key, price_now AS price, TIMESTAMP '{_FIRST_RUN}' AS observed_at FROM a), v AS ({mart.SQL["verified"]})"""


@query(
    "q110_run_deals",
    f"""{_RUN} SELECT coalesce(v.key, a.key) AS source_id, CASE WHEN v.key IS NULL THEN 'dead' ELSE 'active' END AS status, coalesce(v.price_now, a.price_now) AS price_now, v.verdict, v.market_price
        FROM v FULL JOIN a ON a.key = v.key""",
)
def _run_deals(spark, sf_dir):
    out = _two_runs(spark, sf_dir).deals
    fresh = F.col("status") == "active"
    return out.select("source_id", "status", "price_now", F.when(fresh, F.col("verdict")).alias("verdict"), F.when(fresh, F.col("market_price")).alias("market_price"))


@query(
    "q110b_run_tables",
    f"""{_RUN}, old AS (SELECT *, TIMESTAMP '{_FIRST_RUN}' AS seen FROM first_run), new AS (SELECT *, TIMESTAMP '{mart.NOW}' AS seen FROM second_run)
        SELECT 'point' AS part, key AS name, TIMESTAMP '{_FIRST_RUN}' AS seen, price_now AS n FROM a
        UNION ALL SELECT 'point', b.key, TIMESTAMP '{mart.NOW}', b.price_now FROM b LEFT JOIN a USING (key) WHERE a.key IS NULL OR a.price_now <> b.price_now
        UNION ALL SELECT 'found', 's' || (CAST(merchant_id AS BIGINT) % 3), seen, count(*) FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL
        UNION ALL SELECT 'dropped', 's' || (CAST(merchant_id AS BIGINT) % 3), seen, count_if(votes = 7) FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL
        UNION ALL SELECT 'total', unnest(['sources', 'total_found', 'total_dropped', 'total_new', 'total_updated']), NULL, unnest([3, (SELECT count(*) FROM second_run), (SELECT count(*) FROM second_run WHERE votes = 7), count_if(a.key IS NULL), count(a.key)])
            FROM b LEFT JOIN a USING (key)
        UNION ALL SELECT 'merchants', '', NULL, 2 + count(DISTINCT merchant_id) FROM (SELECT * FROM old UNION ALL SELECT * FROM new) WHERE merchant_id NOT IN ('1', '2')""",
)
def _run_tables(spark, sf_dir):
    out = _two_runs(spark, sf_dir)
    points = out.points.join(out.deals.select(F.col("id").alias("deal_id"), "source_id"), "deal_id").select(F.lit("point").alias("part"), F.col("source_id").alias("name"), F.col("observed_at").alias("seen"), F.col("price").alias("n"))
    log = [out.runs.select(F.lit(part).alias("part"), F.col("source").alias("name"), F.col("started_at").alias("seen"), F.col(f"items_{part}").alias("n")) for part in ("found", "dropped")]
    sums = out.totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in out.totals.columns])).alias("x"))
    sums = sums.select(F.lit("total").alias("part"), "x.name", F.lit(None).cast("timestamp_ntz").alias("seen"), "x.n")
    count = out.merchants.agg(F.count(F.lit(1)).alias("n")).select(F.lit("merchants").alias("part"), F.lit("").alias("name"), F.lit(None).cast("timestamp_ntz").alias("seen"), "n")
    return sets.union_all([points, *log, sums, count])
