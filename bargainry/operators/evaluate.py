"""Evaluation of an assistant on labelled cases: recall, questions asked, violations, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col

TOP = 6
#: What a model has to reach.
RECALL_FLOOR, CLARIFY_FLOOR = 0.85, 0.8


def first_hits(surfaced: DataFrame, acceptable: DataFrame) -> DataFrame:
    """case_id, rank: the place of the first acceptable deal, deals in the order they first came up.

    ``surfaced`` has case_id, pos, deal_id; ``acceptable`` has case_id, deal_id.  Cases
    without an acceptable deal among those surfaced have a null rank.
    """
    ranked = placed(surfaced)
    wanted = acceptable.select("case_id", "deal_id").distinct().withColumn("wanted", F.lit(True))
    return ranked.join(wanted, ["case_id", "deal_id"], "left").groupBy("case_id").agg(F.min(F.when(F.col("wanted"), F.col("place"))).cast("long").alias("rank"))


def placed(surfaced: DataFrame) -> DataFrame:
    """case_id, deal_id, place: each deal once, in the order they first came up."""
    first = surfaced.groupBy("case_id", "deal_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.dense_rank().over(Window.partitionBy("case_id").orderBy("pos"))).drop("pos")


def recall(hits: DataFrame, k: int = TOP) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(F.col("rank") <= k, 1)).alias("found"))


def label_ids(labels: DataFrame, deals: DataFrame) -> DataFrame:
    """Labels (case_id, source_id, kind) with the id that the deal has now; labels of unknown deals go."""
    return labels.join(deals.select("source_id", F.col("id").alias("deal_id")).distinct(), "source_id").select("case_id", "kind", "deal_id").distinct()


def assistant_text(events: DataFrame) -> DataFrame:
    """case_id, text: what the assistant wrote, in order.  A row holds one conversation."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    return events.where("type = 'text'").groupBy("case_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def asks(text: Column | str) -> Column:
    """Whether a reply asks something: a question at its end, or before more words."""
    return F.coalesce(F.trim(F.regexp_replace(col(text), r"^\s+|\s+$", "")).rlike(r"\?\s*$|\?[\"'”)]?\s*$|\?\s+\S"), F.lit(False))


def cost_cents(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost_cents by the rates (cents a million tokens) of each model; null for a model without rates.

    ``rates`` lists the models one by one: model, input_rate, output_rate, cache_rate, write_rate.
    """
    kinds = {"input_tokens": "input_rate", "output_tokens": "output_rate", "cache_read_tokens": "cache_rate", "cache_creation_tokens": "write_rate"}
    cost = sum((F.col(rate) * F.coalesce(F.col(tokens), F.lit(0)) / 1_000_000 for tokens, rate in kinds.items()), F.lit(0.0))
    return usage.join(rates, "model", "left").withColumn("cost_cents", cost).drop(*kinds.values())


def score_cases(cases: DataFrame, surfaced: DataFrame, labels: DataFrame, texts: DataFrame, top: int = TOP) -> DataFrame:
    """Cases (case_id, kind, split) with hit_rank, surfaced, violations, clarified and passed.

    ``labels`` has case_id, deal_id and kind: acceptable or forbidden.  A forbidden deal among the
    first ``top`` fails the case, whatever else it found.
    """
    ranked = placed(surfaced)
    shown = ranked.groupBy("case_id").agg(F.count(F.lit(1)).alias("surfaced"))
    known = ranked.where(F.col("place") <= top).join(labels.select("case_id", "deal_id", F.col("kind").alias("label")).distinct(), ["case_id", "deal_id"])
    met = known.groupBy("case_id").agg(F.min(F.when(F.col("label") == "acceptable", F.col("place"))).cast("long").alias("hit_rank"), F.count_if(F.col("label") == "forbidden").alias("violations"))
    out = cases.join(shown, "case_id", "left").join(met, "case_id", "left").join(texts.select("case_id", asks("text").alias("clarified")), "case_id", "left")
    out = out.fillna(0, ["surfaced", "violations"]).fillna(False, ["clarified"])
    passed = (F.col("violations") == 0) & F.when(F.col("kind") == "clarify", F.col("clarified")).otherwise(F.col("hit_rank").isNotNull())
    return out.withColumn("passed", passed)


def report(scored: DataFrame) -> DataFrame:
    """A row per model of scored cases with model, cost_cents and tool_calls."""
    rate = lambda among: F.coalesce(F.avg(F.when(among, F.col("passed").cast("int"))), F.lit(0.0))
    find = F.col("kind") == "find"
    out = scored.groupBy("model").agg(
        rate(find).alias("recall"), rate(find & (F.col("split") == "test")).alias("recall_test"), rate(F.col("kind") == "clarify").alias("clarify_rate"),
        F.sum("violations").alias("violations"), F.when(F.count("cost_cents") == F.count(F.lit(1)), F.avg("cost_cents")).alias("mean_cost_cents"), F.avg("tool_calls").alias("mean_tool_calls"),
    )
    return out


def best_model(reports: DataFrame) -> DataFrame:
    """The cheapest model that reaches both floors; if none does, the one of best recall."""
    passing = (F.col("recall") >= RECALL_FLOOR) & (F.col("clarify_rate") >= CLARIFY_FLOOR)
    order = [passing.desc(), F.when(passing, F.col("mean_cost_cents")).asc_nulls_last(), F.when(~passing, -F.col("recall")), F.asc("model")]
    return reports.orderBy(*order).limit(1).withColumn("passing", passing)
