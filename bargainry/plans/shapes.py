"""Queries on JSON of any shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from . import mart
from .markup import _filled, _id
from .queries import query

_SHAPES = ['" X@ "', "@", '["", {"name": [null, "X@"]}, "no"]', '{"name": null, "url": "X@", "@id": "no"}', '{"@id": {"name": "X@"}}', '{"name": "  "}', "[]", "{}", "null", "true", "{broken", "", '[[["X@"]]]', '{"url": 7.5}']
_FOUND = "CASE WHEN p_partkey % 14 IN (0, 2, 3, 4, 12) THEN 'X' || p_partkey WHEN p_partkey % 14 = 1 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 14 = 13 THEN '7.5' END"


@query("q124b_first_strings", f"SELECT p_partkey, {_FOUND} AS found FROM part")
def _first(spark, sf_dir):
    json = F.replace(F.get(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % len(_SHAPES)).cast("int")), F.lit("@"), _id())
    json = F.when(F.col("p_partkey") % len(_SHAPES) == 4, _filled('{"@id": {"name": "X', _id(), '"}}')).when(F.col("p_partkey") % len(_SHAPES) == 3, _filled('{"name": null, "url": "X', _id(), '", "@id": "no"}')).otherwise(json)
    return mart.parts(spark, sf_dir).select("p_partkey", nested.first_string(F.try_parse_json(json)).alias("found"))


@query(
    "q124c_json_lists",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a|' || p_partkey || '|null|{"k":1}' WHEN 1 THEN '' END AS said, CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 0 END AS n FROM part""",
)
def _lists(spark, sf_dir):
    shapes = [_filled('["a", ', _id(), ', null, {"k": 1}]'), F.lit(" [] "), F.lit('{"a": []}'), F.lit("[1,"), F.lit("  "), F.lit(None).cast("string")]
    rows = mart.parts(spark, sf_dir).select("p_partkey", nested.json_list(F.get(F.array(*shapes), (F.col("p_partkey") % 6).cast("int"))).alias("l"))
    return rows.select("p_partkey", F.array_join("l", "|").alias("said"), F.when(F.col("l").isNotNull(), F.size("l")).alias("n"))
