"""The edges of words mean the same in both ways of writing them."""

import re

from pyspark.sql import functions as F

from bargainry.functions import rules


def test_edges_of_words(spark):
    """The short edge stands only before what starts with a letter or digit that has to be there."""
    assert rules.ascii_words(r"\b(lego|duplo)\b").startswith("(?iu)" + rules._START)
    for pattern in (r"\b[eé]cran\b", r"\b(?:[eé]cran|tv)\b", r"\b(a?b|c)\b", r"\b(ab)?c\b", r"\b(ab|c)|\bé\b", r"\b(?=a)\b"):
        assert rules.ascii_words(pattern) == "(?iu)" + pattern.replace(r"\b", rules._EDGE), pattern
    texts = ["LEGO", "xlego", "élego", "lego-duplo", "legos", "a_duplo", "ſlego", "Duplo!"]
    found = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rules.matches(F.col("t"), r"\b(lego|duplo)\b").alias("x")).collect()]
    plain = [bool(re.search(r"(?<![A-Za-z0-9_ſ])(?:lego|duplo)(?![A-Za-z0-9_])", t, re.I)) for t in texts]
    assert found == plain


def test_short_ways_read_the_same(spark):
    """Plain prices, dates and canonical addresses skip the general rules, and anything near them does not."""
    from bargainry.functions import scalars, text

    prices = [("12", 1200), ("12.5", 1250), ("12.50", 1250), ("1.234", 123400), ("12345678", None), ("10000000", 1_000_000_000), ("0", 0), ("007.10", 710), ("12.50\n", 1250), ("", None)]
    got = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(prices)], "i int, p string").select("i", scalars.price_to_cents("p").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c for _, c in prices]
    urls = [
        ("https://x.ca/p/1", "https://x.ca/p/1"), ("https://x.ca/", "https://x.ca/"), ("https://x.ca", "https://x.ca/"), ("https://x.ca/p/", "https://x.ca/p"), ("https://www.x.ca/p", "https://x.ca/p"),
        ("https://x.ca:8080/p", "https://x.ca:8080/p"), ("https://X.ca/p", "https://x.ca/p"), ("https://u@x.ca/p", "https://x.ca/p"), ("https://x.ca/p#a", "https://x.ca/p"), ("https://x.ca/p?gclid=1", "https://x.ca/p"),
        ("https://go.redirectingat.com/?url=https%3A%2F%2Fgoogleadservices.com%2Fa%3Fadurl%3Dhttp%253A%252F%252Fy.ca%252Fq%252F", "https://y.ca/q"), ("https://x.ca/" + "a/" * 5000, "https://x.ca/" + "a/" * 4999 + "a"), (" https://x.ca/p ", "https://x.ca/p"),
    ]
    got = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, u string").select("i", text.canonical_url("u").alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [u for _, u in urls]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("1704164645",), ("1.7e9",), ("2024-01",)], "t string").select(text.timestamp_of("t").cast("string").alias("t")).collect()
    assert [r.t for r in times] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2023-11-14 22:13:20", "2024-01-01 00:00:00"]
