"""Elements of broken and nested HTML, selectors, and the parsers that use them."""

import pytest

from bargainry.sources import grids, payloads
from bargainry.sources.selectors import Page, Selector, around, every, first, select


def texts(html, selector):
    page = Page(html)
    chosen = Selector(selector)
    return [page.text(e) for e in range(len(page.tags)) if chosen.fits(page, e)]


@pytest.mark.parametrize(
    ("html", "selector", "want"),
    [
        ("<p>a<p>b<div>c</div>d", "p", ["a", "b"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "ul > li", ["abc", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "table tbody tr td:nth-child(1)", ["1", "3"]),
        ("<table><tbody><tr><td><table><tr><td>in</table>out</table>", "td > table td", ["in"]),
        ("<table><thead><tr><th>h<tbody><tr><td>x</table>", "tbody td, thead th", ["h", "x"]),
        ("<a href=x>1<a href=y>2</a>", "a[href=y]", ["2"]),
        ("<b class='a  b\nc'>x</b><b class=ab>y</b>", ".a.c", ["x"]),
        ("<i id=k data-x>1</i><i data-x='7'>2</i>", "#k, [data-x='7']", ["1", "2"]),
        ("<i data-x='abc'>1</i>", "[data-x^=ab][data-x$=bc][data-x*=b]", ["1"]),
        ("<i data-x='abc'>1</i>", "[data-x^='']", []),
        ("<i lang=fr-CA rel='x y'>1</i>", "[lang|=fr][rel~=y]", ["1"]),
        ("<!-- <b>no</b> --><b>1<!-- x -->2</b><![CDATA[<b>no</b>]]>", "b", ["12"]),
        ("<script>if (a<b) '<b>x</b>'</script><b>y</b>", "b", ["y"]),
        ("<title>a &amp; <b>b</b></title>", "title", ["a & <b>b</b>"]),
        ("<img alt='x > y'><br/>tail<b title=\"'>\">z</b>", "b", ["z"]),
        ("<DIV CLASS=Up>a</dIV>", "div.Up", ["a"]),
        ("<b>never closed", "b", ["never closed"]),
        ("</b></p>stray<b>x</b>", "b", ["x"]),
        ("a < b and <c", "c", []),
        ("<b class=\"x>y</b><i>z</i>", "i", ["z"]),
        ("&lt;b&gt;<b>&eacute;&#233;&nosuch;</b>", "b", ["éé&nosuch;"]),
        ("<div><span><b>1</b></span><b>2</b></div>", "div > b", ["2"]),
        ("<div class=o><div class=i><b>1</b></div></div>", ".o .i > b:first-child", ["1"]),
        ("", "b", []),
    ],
)
def test_page(html, selector, want):
    assert texts(html, selector) == want


@pytest.mark.parametrize("bad", ["", "  ", ">", "a >", "a,", "a:hover", "[", "a b >", ".", "a..b"])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError):
        Selector(bad)


def test_long_and_deep_pages_take_time_in_proportion():
    assert len(Page("<div>" * 20000).tags) == 20000
    assert len(Page("<a '" * 20000).tags) == len(Page("</a <b" * 20000).tags) == len(Page("<a =\"" * 20001).tags) == 0
    assert texts("x" * 3_000_000 + "<b>y</b>", "b") == ["y"]


def table(spark, *html):
    return spark.createDataFrame([("s", h, "a", 1) for h in html], "source string, payload string, place string, n int")


def test_select(spark):
    rows = select(table(spark, "<p class=r><b>1</b><b>2</b></p><p class=r><i>3</i></p>", None, "none"), "payload", ".r", {"b": first("b", "i"), "all": every("b"), "up": around("p")}, ("source", "n"))
    assert rows.columns == ["source", "n", "place", "row", "b", "all", "up"]
    assert [(r.place, r.row.text, [m and m.text for m in r.b], [m.text for m in r["all"]], [m.attributes["class"] for m in r.up]) for r in rows.collect()] == [
        (0, "12", ["1", None], ["1", "2"], ["r"]), (1, "3", [None, "3"], [], ["r"])
    ]
    whole = select(table(spark, "a<b x=1>b</b>", ""), "payload", None, {"b": every("b")}, ())
    assert sorted((r.row.text, [m.attributes for m in r.b]) for r in whole.collect()) == [("", []), ("ab", [{"x": "1"}])]


def prices(df):
    return [(r.source_id, r.title, float(r.price), float(r.price_was)) for r in df.collect()]


def test_the_first_tile_of_a_fragment_counts(spark):
    tile = "<div class='product-tile' data-pid='{0}'><a class='link' href='/{0}'>T{0}</a><span class='sales'><span class='value'>{1}</span></span><s class='strike-through'><i class='value' content='9'></i></s></div>"
    one = grids.grid(table(spark, tile.format("A", "$5.00")), "https://s.ca", "s.ca")
    assert prices(one) == [("s.ca:A", "TA", 5.0, 9.0)]
    nested = grids.grid(table(spark, tile.format("A", "<b>$5.<i>25</i></b>") + tile.format("B", "<b>1 2,50&nbsp;$</b>")), "https://s.ca", "s.ca")
    assert sorted(prices(nested)) == [("s.ca:A", "TA", 5.25, 9.0)]  # B costs 12.50, more than before
    assert grids.grid(table(spark, "", None, "<div class=product-tile></div>"), "https://s.ca", "s.ca").count() == 0


def test_a_tile_inside_a_wrapper_counts_once(spark):
    html = "<div class='product' data-pid='W'><div class='product-tile'><a class=link href='/x'>T</a><b class=sales>5</b><b class=list><i class=value>7</i></b></div></div>"
    assert prices(grids.grid(table(spark, html), "https://s.ca", "s.ca")) == [("s.ca:W", "T", 5.0, 7.0)]


def test_clearance_by_other_selectors(spark):
    html = "<dl class=x><dt>Lamp</dt><dd>$5</dd><dd>0 left</dd></dl><dl class=x><dt>ab</dt></dl>"
    chosen = {"row": "dl.x", "title": "dt", "price": "dd:nth-child(2)", "regular": None, "quantity": "dd:nth-child(3)", "aisle": None}
    pages = table(spark, html).selectExpr("source", "payload", "'k 1' AS store_id", "'marks' AS chain")
    (row,) = payloads.store_clearance(pages, selectors=chosen).collect()
    assert (row.source_id, row.price, row.price_was, row.in_stock, row.stock_note, row.url, row.merchant_domain) == (
        "k 1:lamp", "$5", None, False, "0 left in stock", "https://stocktrack.ca/clearance/k+1", "marks.com"
    )


def test_links_by_selector(spark):
    pages = table(spark, "<ul class=p><li><a href='/a'>x</a><li><a href=''>y</a><a>z</a><li><b><a href='//o.ca/b'>w</a></b></ul><a href=c>n</a>").selectExpr("source", "payload", "'https://h.ca/l' AS url")
    assert [r.link for r in payloads.selected_links(pages, ".p a[href]").collect()] == ["https://h.ca/a", "https://o.ca/b"]


def test_xml():
    page = Page("<r><Item/><item a='1'><b:t>x</b:t><t>a<![CDATA[<i>&amp;</i>]]>&lt;</t><link>l</link></item></r>", xml=True)
    found = {s: [page.text(e) for e in range(len(page.tags)) if Selector(s, xml=True).fits(page, e)] for s in ("item > t", "b|t", "Item", "item[a='1'] link", "i", "T")}
    assert found == {"item > t": ["a<i>&amp;</i><"], "b|t": ["x"], "Item": [""], "item[a='1'] link": ["l"], "i": [], "T": []}


def test_broken_feeds(spark):
    feed = "<rss><item><title>A & B</title><link>u</link><guid/></item><item><title>open<link>v</link></item><item><title></title></item>"
    got = payloads.rss(table(spark, feed, "no feed", "", None)).select("title", "url", "source_id").collect()
    assert sorted(map(tuple, got), key=str) == [("A & B", "u", "u"), ("openv", "v", "v")]
