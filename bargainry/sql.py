"""The engine from SQL: functions over prices and places, and table functions over pages and feeds.

    from bargainry import sql
    sql.register(spark)
    spark.sql("SELECT format_cents(price_now), discount_pct(price_now, price_was) FROM {deals}", deals=deals)
    spark.sql("SELECT url, t.text FROM {pages}, LATERAL html_select(html, 'ul.products a[href]') t", pages=pages)

The scalar functions are SQL, which Catalyst inlines; the table functions read one text at a time.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.scalars import EARTH_KM
from .sources.delimited import shape
from .sources.selectors import Page, Selector

#: Name, parameters, result and body; the same as the column functions of the name.
SCALARS = (
    ("half_up", "x DOUBLE, digits INT", "DOUBLE", "floor(x * power(10, digits) + 0.5) / power(10, digits)"),
    ("discount_pct", "now BIGINT, was BIGINT", "DOUBLE", "CASE WHEN was > now AND was > 0 AND now >= 0 AND (was - now) / was * 100 < 99.5 THEN floor((was - now) / was * 100 * 10 + 0.5) / 10 END"),
    ("format_cents", "cents BIGINT", "STRING", "CASE WHEN cents IS NULL THEN '—' WHEN cents = 0 THEN 'Free' ELSE concat('$', format_number(cents / 100, 2)) END"),
    (
        "distance_km", "lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE",
        f"2 * {EARTH_KM}D * asin(least(1D, sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2))))",
    ),
)


@F.udtf(returnType="place: int, text: string, attributes: map<string,string>")
class HtmlSelect:
    """The elements of a page that a selector finds, in order; none of a null page."""

    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        if html is None or selector is None:
            return
        page, chosen = Page(html), Selector(selector)
        found = (e for e in range(len(page.tags)) if chosen.fits(page, e))
        for place, element in enumerate(found):
            yield place, page.text(element), page.attributes[element]


@F.udtf(returnType="row: int, fields: map<string,string>")
class FeedRows:
    """The rows of a delimited text with a header: column names in small letters, trimmed values, empty ones left out."""

    def eval(self, text: str) -> Iterator[tuple]:
        lines = (text or "").lstrip("﻿")
        if not lines.strip():
            return
        delimiter, names = shape(lines.split("\n", 1)[0].rstrip("\r"))
        rows = csv.reader(io.StringIO(lines, newline=""), delimiter=delimiter)
        next(rows)
        number = 0
        for values in rows:
            fields = {n: v.strip() for n, v in zip(names, values, strict=False) if n and v.strip()}
            if fields:
                yield number, fields
                number += 1


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, in place of any of their names."""
    for name, parameters, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("html_select", HtmlSelect)
    spark.udtf.register("feed_rows", FeedRows)
