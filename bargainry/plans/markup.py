"""Queries on HTML as it comes: fragments, nested and broken markup, other selectors than the usual ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import grids, payloads
from . import mart
from .more import _size
from .queries import query


def _key():
    return F.col("p_partkey")


def _id():
    return _key().cast("string")


def _priced(df: DataFrame, *more: str) -> DataFrame:
    return df.select("source_id", "title", F.col("price").cast("double").alias("price"), F.col("price_was").cast("double").alias("price_was"), *more)


def _filled(*pieces) -> F.Column:
    """Texts and columns put together."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


@query(
    "q128b_grid_fragments",
    """SELECT 's.ca:' || CASE WHEN p_partkey % 6 = 5 THEN 'https://s.ca/p/' || p_partkey ELSE 'P' || p_partkey END AS source_id, CASE p_partkey % 6 WHEN 4 THEN trim(p_name) || ' > b' WHEN 3 THEN trim(p_name) || ' & co' ELSE trim(p_name) END AS title,
        CASE WHEN p_partkey % 6 = 5 THEN p_size + 0.5 ELSE p_size END::DOUBLE AS price, p_size + 1.0::DOUBLE AS price_was, 'https://s.ca/p/' || p_partkey AS url, CASE WHEN p_partkey % 6 = 1 THEN 'Ac me' END AS brand, p_partkey % 6 <> 2 AS in_stock FROM part
       UNION ALL SELECT 's.ca:Q' || p_partkey, 'Second', p_size + 2, p_size + 3, 'https://s.ca/q/' || p_partkey, NULL, true FROM part WHERE p_partkey % 6 = 3""",
)
def _fragments(spark, sf_dir):
    """By the key's remainder: nothing before the tile and markup in its price; wrappers; ids inside; comments, capitals and open paragraphs; marks in attributes; unreadable content."""
    anchor = _filled("<a class=link href=/p/", _id(), ">", F.col("p_name"), "</a>")
    plain = _filled("<s class=strike-through><em class='value' content=", _size(1), "></em></s>")
    shapes = [
        _filled("<div class='product-tile' data-pid=P", _id(), ">", anchor, plain, "<span class='sales'><span class='value'><b>$<i>", _size(), "</i></b>.00</span></span></div>"),
        _filled("<div data-pid='P", _id(), "'><section><div class=\"a grid-tile\">", anchor, plain, "<p class='price-sales'><b class=value content='", _size(), "'></b></p><b class=brand> Ac\n<i>me</i></b></div></section></div>"),
        _filled("<li class=product-tile><i data-pid='P", _id(), "'></i>", anchor, plain, "<u class=sales>", _size(), " $</u><p>Sold <b>out</b></li>"),
        _filled(
            "text first<!-- <div class='product-tile'>", anchor, " --><DIV CLASS='product-tile' data-pid='P", _id(), "'><P>open<A CLASS='name-link' HREF='/p/", _id(), "'>", F.col("p_name"), " &amp; co</A>", plain, "<B class=sales>", _size(), "</B></DIV>",
            "<script>\"<div class='product-tile'>\"</script><div class='product-tile' data-pid='Q", _id(), "'><a class=link href='/q/", _id(), "'>Second</a><s class='list'><b class='value'>", _size(3), "</b></s><b class=sales>", _size(2), "</b></div>",
        ),
        _filled("<div class='product-tile' data-pid='P", _id(), "' title='a > b'><a href='/p/", _id(), "'><img alt='", F.col("p_name"), " > b' src=x></a>", plain, "<b class=sales>", _size(), "</b></div>"),
        _filled("<div class='product-tile'>", anchor, plain, "<b class=sales content=none><i class=value content='0'>free</i>", _size(), ",50 $</b></div>"),
    ]
    html = F.get(F.array(*shapes), (_key() % len(shapes)).cast("int"))
    tiles = mart.parts(spark, sf_dir).select(_id().alias("source"), html.alias("payload"))
    return _priced(grids.grid(tiles, "https://s.ca", "s.ca"), "url", "brand", "in_stock")


_STORES = "CASE p_partkey % 4 WHEN 0 THEN 'walmart' WHEN 1 THEN 'marks' WHEN 2 THEN 'corner-shop' END"


@query(
    "q125b_store_clearance",
    f"""WITH items AS (SELECT *, {_STORES} AS chain, 'https://t.ca/clearance/S%2F' || p_partkey AS page FROM part)
        SELECT 'S/' || p_partkey || ':' || rtrim(substr(ltrim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '') AS source_id, trim(p_name) AS title, '$' || p_size AS price, (p_size + 1) || '.00' AS price_was,
            CASE WHEN p_partkey % 2 = 0 THEN 'https://c.ca/' || p_partkey ELSE page END AS url, CASE chain WHEN 'walmart' THEN 'walmart.ca' WHEN 'marks' THEN 'marks.com' ELSE 'stocktrack.ca' END AS merchant_domain,
            p_partkey % 3 > 0 AS in_stock, (p_partkey % 3) || ' left in stock' || CASE WHEN p_partkey % 5 > 0 THEN ' · Aisle 7' ELSE '' END AS stock_note FROM items
        UNION ALL SELECT 'S/' || p_partkey || ':no-more', 'No more!', NULL, NULL, page, CASE chain WHEN 'walmart' THEN 'walmart.ca' WHEN 'marks' THEN 'marks.com' ELSE 'stocktrack.ca' END, true, NULL FROM items""",
)
def _store_clearance(spark, sf_dir):
    """Tables without bodies, rows without ends, items outside of tables, by a configuration's selectors."""
    link = _filled("<a href='", F.when(_key() % 2 == 0, _filled("https://c.ca/", _id())).otherwise("/i/x"), "'>see</a>")
    aisle = F.when(_key() % 5 > 0, "7").otherwise(" ")
    row = _filled("<tr class=item><td class=t> ", F.col("p_name"), "<td>", link, "<td>$", _size(), "<td><b>", _size(1), "</b>.00<td>", (_key() % 3).cast("string"), " left<td>", aisle)
    html = _filled("<table><tr><th>Item<th>x<tr><td class=t>ab<td>", row, "</table><div class='clearance-item'><h3 class='item-name'>No more!</h3></div>")
    chain = F.get(F.array(F.lit("walmart"), F.lit("marks"), F.lit("corner-shop"), F.lit(None).cast("string")), (_key() % 4).cast("int"))
    pages = mart.parts(spark, sf_dir).select(F.lit("in-store").alias("source"), _filled("S/", _id()).alias("store_id"), chain.alias("chain"), html.alias("payload"))
    shifted = {"title": "td.t, .item-name", "price": "tr > td:nth-child(3)", "regular": "td:nth-child(4)", "quantity": "td:nth-child(5)", "aisle": "td:nth-child(6)"}
    out = payloads.store_clearance(pages, "https://t.ca/", selectors=shifted)
    return out.select("source_id", "title", "price", "price_was", "url", "merchant_domain", "in_stock", "stock_note")


@query(
    "q62b_links_by_selector",
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS place, link FROM (SELECT page_id, 0 AS place, 'https://h.ca/p-' || page_id AS link FROM pages
        UNION ALL SELECT page_id, 1, 'https://h.ca/x/p-' || page_id || '?a=1&b=2' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 2, 'https://o.ca/p-1' FROM pages WHERE page_id % 3 = 0)""",
)
def _selected(spark, sf_dir):
    page = F.col("page_id").cast("string")
    lists = _filled(
        "<ul class='menu'><li><a href='/p-0'>no</a></ul><ul class='x product-list'><li><b><a href='/p-", page, "'>1</a></b><li><a name=p>none</a><a href='/q-1'>other</a><li><a href='/p-", page, "'>again</a>",
        F.when(F.col("page_id") % 2 == 0, _filled("<li><a class='big' href=' p-", page, "?a=1&amp;b=2 '>2</a>")).otherwise(""), F.when(F.col("page_id") % 3 == 0, "<li><ol><li><a href=//o.ca/p-1>3</a></ol>").otherwise(""), "</ul><a href='/p-9'>out</a>",
    )
    html = _filled(lists, F.col("html"))
    pages = mart.table(spark, sf_dir, "pages").select(page.alias("source"), F.lit("https://h.ca/x/list").alias("url"), html.alias("payload"))
    out = payloads.selected_links(pages, "ul.product-list a[href*='p-']")
    return out.select(F.col("source").cast("long").alias("page_id"), "place", "link")


@query(
    "q134c_club_reads_the_pool",
    """SELECT 'S' || p_partkey || ':thing-' || p_partkey AS source_id, 'in-store' AS source_path FROM part WHERE p_partkey % 4 = 0
       UNION ALL SELECT 'page' || p_partkey, 'native' FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 <> 0 UNION ALL SELECT 'page' || p_partkey, 'native' FROM part WHERE p_partkey % 12 = 0""",
)
def _pool(spark, sf_dir):
    """The clearance source fills the run's pool; the club takes its own stores' from there after its pages."""
    part = mart.parts(spark, sf_dir)
    html = _filled("<div class=clearance-item><i class=item-name>Thing ", _id(), "</i><b class=clearance-price>", _size(), "</b><a href='https://", F.when(_key() % 4 == 0, "walmart.ca").otherwise("other.ca"), "/c/", _id(), "'>x</a></div>")
    chain = F.when(_key() % 4 == 0, "walmart").otherwise("marks")
    pool = payloads.store_clearance(part.select(F.lit("in-store").alias("source"), _filled("S", _id()).alias("store_id"), chain.alias("chain"), html.alias("payload")))
    pages = payloads.as_raw(part.where("p_partkey % 3 = 0"), source=F.lit("page"), source_id=_filled("page", _id()), url=_filled("https://walmart.ca/ip/", _id()))
    none = pages.where("false")
    return grids.club(pages, none, none, pool, "walmart.ca", ("walmart",))[0].select("source_id", "source_path")
