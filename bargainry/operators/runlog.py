"""Run logs, usage logs, counts over runs, and the catalogue of retailers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from ..schemas import SOURCE_RUNS, USAGE
from . import mutations
from .dedupe import saved

#: Sites that are never crawled.
NO_CRAWL = ("amazon.ca", "amazon.com")
#: Engines that an entry may name, and states that it may be in.
ENGINES = ("shopify", "sfcc", "hybris", "gapinc", "magento", "wordpress", "jsonld", "feed")
CATALOGUE_STATUSES = ("verified", "unverified", "blocked")
#: Labels of a retailer's state in the directory.
STATUS_LABELS = {"working": "Working", "unverified": "Unverified", "blocked": "Blocked"}


def _as_stored(rows: DataFrame, schema: str, ids: list[str]) -> DataFrame:
    """The columns of a log; those not given are null, the id follows from the columns ``ids``."""
    fields = [f.split() for f in schema.split(", ")]
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.sha1(F.concat_ws("|", *ids)))
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in fields])


def append_runs(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log with a row per source of a run; the counts of a source that found nothing are 0."""
    rows = _as_stored(outcomes, SOURCE_RUNS, ["source", "started_at"])
    return stored.unionByName(rows.fillna(0, ["items_found", "items_new", "items_updated", "items_dropped"]))


def append_usage(stored: DataFrame, turns: DataFrame) -> DataFrame:
    return stored.unionByName(_as_stored(turns, USAGE, ["conversation_id", "created_at", "model"]))


def run_outcomes(normalized: DataFrame, started: Column, finished: Column) -> DataFrame:
    """A row per source of a run's normalised listings: found, dropped, and the path that found them."""
    dropped = F.col("drop_reason").isNotNull()
    return normalized.groupBy("source").agg(
        F.count(F.lit(1)).alias("items_found"), F.count_if(dropped).alias("items_dropped"), F.min("source_path").alias("source_path"),
    ).select("source", started.alias("started_at"), finished.alias("finished_at"), F.lit("ok").alias("outcome"), "items_found", "items_dropped", "source_path")


def totals(outcomes: DataFrame) -> DataFrame:
    """One row: what a run found, added, changed and dropped over all sources."""
    sums = [F.coalesce(F.sum(f"items_{n}"), F.lit(0)).alias(f"total_{n}") for n in ("found", "new", "updated", "dropped")]
    return outcomes.agg(F.count(F.lit(1)).alias("sources"), *sums)


def infers_absence(outcomes: DataFrame) -> bool:
    """Whether what was not seen may count as gone: a source has worked and found something."""
    return not outcomes.where("outcome = 'ok' and items_found > 0").isEmpty()


def reap_preview(deals: DataFrame, now: Column, fresh_days: int = 3, unseen_hours: int = 72) -> DataFrame:
    """Active rows, those listed today, and those that absence would retire."""
    active = F.col("status") == "active"
    since = lambda h: F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(0), F.lit(h))
    return deals.agg(
        F.count_if(active).alias("active"), F.count_if(active & since(fresh_days * 24)).alias("listed"), F.count_if(active & ~since(unseen_hours)).alias("unseen")
    )


def seed_share(deals: DataFrame, seed: str = "seed") -> DataFrame:
    """How many deals are samples, and whether all are."""
    return deals.agg(F.count_if(F.col("source") == seed).alias("seeds"), F.count(F.lit(1)).alias("total")).withColumn("only_samples", (F.col("seeds") > 0) & (F.col("seeds") == F.col("total")))


def classify_probes(probes: DataFrame) -> DataFrame:
    """(source, enabled, items, error) to a status: skipped, blocked, error, empty or ok."""
    status = (
        F.when(~F.col("enabled"), "skipped").when(F.col("error").rlike("(?i)403|blocked|forbidden|robots"), "blocked").when(F.col("error").isNotNull(), "error")
        .when(F.coalesce("items", F.lit(0)) == 0, "empty").otherwise("ok")
    )
    return probes.withColumn("status", status)


def probe_rollup(classified: DataFrame) -> DataFrame:
    """healthy, broken, skipped, and whether all that ran has failed."""
    ok, skipped = F.col("status") == "ok", F.col("status") == "skipped"
    out = classified.agg(F.count_if(ok).alias("healthy"), F.count_if(~ok & ~skipped).alias("broken"), F.count_if(skipped).alias("skipped"))
    return out.withColumn("all_failed", (F.col("healthy") == 0) & (F.col("broken") > 0))


def sources_of(sources: DataFrame, families: list[str]) -> DataFrame:
    """The sources whose id contains a family's name, each with the first that it does."""
    label = F.lit(None).cast("string")
    for family in reversed(families):
        label = F.when(F.contains("source", F.lit(family)), F.lit(family)).otherwise(label)
    return sources.withColumn("family_label", label).where("family_label is not null")


# Catalogue ------------------------------------------------------------------------------------


def schema_errors(entries: DataFrame) -> Column:
    """Every field of an entry that is missing or isn't what it has to be, in the order of the schema; columns that the table lacks count as null."""
    has = {c for c in entries.columns}
    at = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    empty = lambda c: F.coalesce(at(c), F.lit("")) == ""
    url = lambda c: at(c).rlike(r"(?i)^\s*(?:(?:https?|wss?|ftp):[/\\]*[^\s/\\?#@:]+|(?!(?:https?|wss?|ftp):)[a-z][a-z0-9+.-]*:)")
    checks = [F.when(empty(c), f"{c} is missing") for c in ("id", "name", "domain", "base_url")]
    checks.append(F.when(~empty("base_url") & ~url("base_url"), "base_url is not a URL"))
    checks.append(F.when(empty("engine"), "engine is missing").when(~at("engine").isin(*ENGINES), "engine is unknown"))
    checks.append(F.when(~url("hybris_api_base"), "hybris_api_base is not a URL"))
    checks += [F.when(~(at(c, "double") > 0), f"{c} is not positive") for c in ("rate_limit_rps", "max_product_pages")]
    checks.append(F.when(~at("status").isin(*CATALOGUE_STATUSES), "status is unknown"))
    return F.array_compact(F.array(*checks))


def accepted(entries: DataFrame) -> DataFrame:
    """Of (place, id, domain): those that are taken one after the other, each id and each domain once.

    An entry that is refused takes neither, so that a later one may.  In each round, those go
    in that come first among what is left of both their id and their domain; what shares
    either with them goes.  The first of what is left always goes in, and mostly nearly all,
    so that the rounds are few.
    """
    left, chosen = saved(entries.select("place", "id", "domain")), None
    while not left.isEmpty():
        firsts = left.join(left.groupBy("id").agg(F.min("place").alias("of_id")), "id").join(left.groupBy("domain").agg(F.min("place").alias("of_domain")), "domain")
        now = saved(firsts.where("place = of_id and place = of_domain").select("place", "id", "domain"))
        chosen = now if chosen is None else chosen.unionByName(now)
        left = saved(left.join(now.select("id"), "id", "left_anti").join(now.select("domain"), "domain", "left_anti"))
    return left if chosen is None else chosen


def validate_catalogue(entries: DataFrame) -> DataFrame:
    """Entries (place, id, name, domain, base_url, engine, status, enabled, ...) with all their errors, and ``error``, the first.

    Places differ.  Entries that don't fit the schema, or may not be crawled, take nothing; of
    the others, in the order of their places, an entry is refused whose id or else whose
    domain an accepted one has taken before it.
    """
    rows = entries.withColumn("errors", schema_errors(entries))
    crawled = F.coalesce("enabled", F.lit(True)) & F.lower("domain").isin(*NO_CRAWL)
    rows = saved(rows.withColumn("__crawled", F.coalesce(crawled, F.lit(False))))
    chosen = accepted(rows.where("size(errors) = 0 and not __crawled"))
    rows = rows.join(chosen.select("id", F.col("place").alias("__of_id")), "id", "left").join(chosen.select("domain", F.col("place").alias("__of_domain")), "domain", "left")
    late = F.when(F.col("__of_id") < F.col("place"), "duplicate id").when(F.col("__of_domain") < F.col("place"), "duplicate domain").when(F.col("__crawled"), "must not be crawled")
    rows = rows.withColumn("errors", F.when(F.size("errors") == 0, F.array_compact(F.array(late))).otherwise(F.col("errors")))
    return rows.withColumn("error", F.get("errors", F.lit(0))).select(*entries.columns, "errors", "error")


def runnable(catalogue: DataFrame) -> DataFrame:
    return catalogue.where("error is null and coalesce(enabled, true) and coalesce(status, 'unverified') <> 'blocked'")


def coverage(catalogue: DataFrame, facet: DataFrame) -> DataFrame:
    """Every retailer of the catalogue (slug, covered_by, enabled, status) with its deals and a label; ``facet`` counts by merchant."""
    counts = facet.select(F.col("value").alias("slug"), F.col("count").alias("deals"))
    label = F.lit("Unknown")
    for status, text in STATUS_LABELS.items():
        label = F.when(F.col("status") == status, F.lit(text)).otherwise(label)
    rows = catalogue.join(counts, "slug", "left").withColumn("deals", F.coalesce("deals", F.lit(0)))
    said = F.when(F.col("deals") > 0, "Live").when(F.col("covered_by").isNotNull(), "Dedicated adapter").when(~F.coalesce("enabled", F.lit(True)), "Not yet live").otherwise(label)
    return rows.withColumn("coverage", said)


def drift(catalogue: DataFrame, detected: DataFrame) -> DataFrame:
    """id, engine, detected, result: whether the platform found on a retailer's page is the one configured."""
    rows = catalogue.select("id", "engine").join(detected.select("id", F.col("platform").alias("detected")), "id", "left")
    result = F.when(F.col("detected").isNull(), "unreachable").when(F.col("detected") == F.col("engine"), "ok").otherwise("MISMATCH")
    return rows.withColumn("result", result)


def sync_stores(stores: DataFrame, directory: DataFrame, lat: float, lng: float, km: float = 25.0) -> DataFrame:
    """The stores after those of a directory within reach were added or brought up to date."""
    near = directory.where("lat is not null and lng is not null").where(haversine_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= km)
    return mutations.upsert_stores(stores, near)
