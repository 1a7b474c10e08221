"""How often rows are shuffled and texts are parsed."""

import re

import pytest
from pyspark.sql import functions as F

from bargainry.operators import dealquery, dedupe, verify
from bargainry.plans import mart, pages

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_deals_are_shuffled_once_for_window_and_products(spark, no_broadcast):
    assert exchanges(mart.deals(spark, SF)) == 2  # the offers and the products


def test_deals_lie_by_product_for_their_rivals_and_history(spark, no_broadcast):
    deals = dedupe.saved(mart.deals(spark, SF))
    assert exchanges(verify.verify(deals, mart.price_points(spark, SF), mart.now())) == 12  # 13 if the history moves the deals again


def test_few_merchants_are_broadcast(spark, no_broadcast, monkeypatch):
    deals, merchants = mart.offers(spark, SF), mart.merchants(spark, SF)
    assert exchanges(dealquery.with_relations(deals, merchants)) == 0
    monkeypatch.setattr(dealquery, "BROADCAST_ROWS", 0)
    assert exchanges(dealquery.with_relations(deals, merchants)) > 0


def test_serialized_deals_are_parsed_once(spark):
    plan = pages._serialized(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json") == 1


def test_kept_deals_are_the_same(spark):
    shown = pages._shown(spark, SF)
    kept = pages._kept(shown)
    assert kept.columns == shown.columns and kept.exceptAll(shown).isEmpty() and shown.exceptAll(kept).isEmpty()
    assert kept.where(F.col("quality_note").isNull() | F.col("slug").isNull()).isEmpty()
