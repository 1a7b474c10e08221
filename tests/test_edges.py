"""A pair that rounds to the distance, rows of one small file dealt to all cores, and selectors that test few elements."""

from bargainry.plans import mart, queries, ranges  # noqa: F401  ranges adds to the queries
from bargainry.sources import selectors


def test_a_pair_that_rounds_to_the_distance(spark, tmp_path):
    """250.00047 km apart, which the SQL rounds to 250 before it compares."""
    spark.createDataFrame([(917,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(3829, "x", "y")], "c_custkey long, c_mktsegment string, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["q26b_depots_near_all_stores"](spark, str(tmp_path)).collect()
    assert [(r.id, r.depot, r.distance_km) for r in got] == [("3829", "917", 250.0)]


def test_parts_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = [n for n in mart.parts(spark, str(tmp_path)).rdd.glom().map(len).collect() if n]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 1000 / spark.sparkContext.defaultParallelism and sum(sizes) == 1000


def test_selectors_test_few_elements(monkeypatch):
    tiles = "".join(f"<div class='tile x'><p>t<b class=price>{i}</b></div>" for i in range(300))
    page = selectors.Page(f"<i class=price>out</i>{tiles}<b class=y></b>")
    calls, fits = [], selectors.Compound.fits
    monkeypatch.setattr(selectors.Compound, "fits", lambda self, page, e: calls.append(e) or fits(self, page, e))
    rows, price, none = (selectors.Selector(s) for s in (".tile", "p .price, b.y", ".none"))
    found = [selectors.found_in(page, e, "first", [price, none]) for e in page.matches(rows)]
    assert [page.text(f[0]) for f in found] == [str(i) for i in range(300)] and all(f[1] is None for f in found)
    assert selectors.found_in(page, None, "every", [price])[-1] == len(page.tags) - 1
    assert len(calls) < 4 * len(page.tags)
    for s in ("[class]", "*", "p > b", "div:nth-child(3)", ".x, .price", "#no", "b:first-child"):
        chosen = selectors.Selector(s)
        assert page.matches(chosen) == [e for e in range(len(page.tags)) if chosen.fits(page, e)], s
