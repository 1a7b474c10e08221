"""SQL functions against the column functions of the same names, and table functions on awkward texts."""

import itertools

import pytest
from pyspark.sql import functions as F

from bargainry import sql
from bargainry.functions import scalars
from bargainry.sources import storefronts


@pytest.fixture(scope="module")
def known(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


def test_scalars(known):
    cents = [None, 0, -1, 1, 999, 1000, 100000, 123456789]
    rows = known.createDataFrame(list(itertools.product(cents, cents)), "now long, was long")
    got = known.sql("SELECT now, was, discount_pct(now, was) AS pct, format_cents(now) AS said FROM {rows}", rows=rows)
    want = rows.select("now", "was", scalars.discount("now", "was")["pct"].alias("pct"), scalars.format_cents("now").alias("said"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    halves = known.createDataFrame([(x / 8, d) for x in range(-40, 40) for d in (0, 1)], "x double, d int")
    got = known.sql("SELECT x, d, half_up(x, d) AS y FROM {halves}", halves=halves)
    assert {(r.x, r.d): r.y for r in got.collect()} == {(r.x, r.d): r.y for r in halves.select("x", "d", F.when(F.col("d") == 0, scalars.half_up("x").cast("double")).otherwise(scalars.half_up("x", 1)).alias("y")).collect()}
    spots = known.createDataFrame([(0.0, 0.0, 0.0, 180.0), (90.0, 3.0, -90.0, 7.0), (43.6, -79.4, 45.5, -73.6), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    for r in known.sql("SELECT *, distance_km(a, b, c, d) AS km FROM {spots}", spots=spots).withColumn("plain", scalars.haversine_km(*map(F.col, "abcd"))).collect():
        assert r.km == pytest.approx(r.plain, rel=1e-12)


def test_table_functions(known):
    pages = known.createDataFrame([(1, "<p class=a>x<b>y</b></p><p class=a>z"), (2, ""), (3, None)], "id int, html string")
    got = known.sql("SELECT id, t.* FROM {pages}, LATERAL html_select(html, 'p.a') t", pages=pages).collect()
    assert [(r.id, r.place, r.text, r.attributes) for r in got] == [(1, 0, "xy", {"class": "a"}), (1, 1, "z", {"class": "a"})]
    feeds = known.createDataFrame([(1, '﻿A,b,\n1,"x\ny",9\n,,\n2\n'), (2, ""), (3, None), (4, "a\tb,c\n1\t2")], "id int, text string")
    got = known.sql("SELECT id, t.* FROM {feeds}, LATERAL feed_rows(text) t", feeds=feeds).collect()
    assert sorted((r.id, r.row, tuple(sorted(r.fields.items()))) for r in got) == [(1, 0, (("a", "1"), ("b", "x\ny"))), (1, 1, (("a", "2"),)), (4, 0, (("a\tb", "1\t2"),))]


def test_lists_at_any_depth(spark):
    texts = ['{"x": {"items": [{"n": 1, "items": [{"n": 2}]}, 5, null]}, "a": [[{"items": [{"n": 3}]}]]}', '{"d": {"d": {"items": [{"n": 4}]}}}', "[]", "{bad", "7", None, '{"items": {"n": 9}}', '[{"items": [{"n": 5}]}]']
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, payload string")
    found = lambda depth, below: [(r.source, r.item) for r in storefronts.objects_under(rows, ("items",), depth, below).orderBy("source", "place").collect()]
    one = '{"items":[{"n":2}],"n":1}'
    assert found(3, False) == [("0", '{"n":3}'), ("0", one), ("1", '{"n":4}'), ("7", '{"n":5}')]
    assert found(1, False) == [("0", one), ("7", '{"n":5}')]
    assert [x for x in found(6, True) if x[0] == "0"] == [("0", '{"n":3}'), ("0", one), ("0", '{"n":2}')]
    assert found(0, True) == []
    assert "Python" not in storefronts.objects_under(rows, ("items",), 3, True)._jdf.queryExecution().toString()
