"""Titles, descriptions, coupon texts and addresses that reach every alternative of the rules, for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import mart


#: Stands for one character of a class.
_CLASSES = {"d": "7", "s": " ", "w": "w"}
_ATOM = re.compile(r"\\(?P<escaped>.)|\[(?P<set>\^?\]?[^\]]*)\]|\((?P<group>\?(?:[:=!]|<[=!]))?|(?P<plain>[^|)])", re.DOTALL)
_TIMES = re.compile(r"([?*+])\??|\{(\d+)(?:,\d*)?\}\??")


def _spell(pattern: str, at: int = 0) -> tuple[list[str], int]:
    """Texts that fit a pattern's alternatives from ``at`` on, and where these end: each part's alternatives once, beside the first ones of the others."""
    out: list[str] = []
    parts: list[list[str]] = []

    def put_together() -> None:
        out.append("".join(p[0] for p in parts))
        for i, part in enumerate(parts):
            out.extend("".join(x if j == i else p[0] for j, p in enumerate(parts)) for x in part[1:])

    while at < len(pattern) and pattern[at] != ")":
        if pattern[at] == "|":
            put_together()
            parts, at = [], at + 1
            continue
        found = _ATOM.match(pattern, at)
        at = found.end()
        if found["escaped"]:
            texts = [""] if found["escaped"] in "bB" else [_CLASSES.get(found["escaped"].lower(), found["escaped"])]
        elif found["set"] is not None:
            texts = list(dict.fromkeys(_CLASSES.get(a[1:], a[-1]) if a[0] == "\\" else a[0] for a in re.findall(r"\\.|.-.|.", found["set"])))
        elif found["plain"]:
            texts = [""] if found["plain"] in "^$." else [found["plain"]]
        else:
            texts, at = _spell(pattern, at)
            at += 1
            if found["group"] and found["group"] != "?:":
                texts = [" " + x for x in texts] if found["group"] == "?=" else [""]
        times = _TIMES.match(pattern, at)
        if times:
            least = int(times[2]) if times[2] else int(times[1] == "+")
            texts, at = [x * max(1, least) for x in texts] + [""] * (least == 0), times.end()
        parts.append(texts)
    put_together()
    return out, at


def spelled(*tables: tuple[str, ...]) -> list[str]:
    found = (x.strip() for table in tables for pattern in table for x in _spell(pattern)[0])
    return list(dict.fromkeys(found))


CATEGORY_TEXTS = ["plain thing", "mystery object", "spare part", *spelled(*[p for _, _, p in rules.CATEGORY_RULES])]
DEPARTMENT_TEXTS = ["plain thing", "mystery object", "spare part", "box", *spelled(*[p for _, p in rules.DEPARTMENT_RULES])]
DEPARTMENT_HINTS = ["", "", "", *spelled(*[(p,) for _, p in rules.DEPARTMENT_HINTS])]
KEYWORD_TEXTS = spelled(*rules.KEYWORDS.values())
MERCHANTS = ["elsewhere", "penningtons", "moores", *[slugs[0] for slugs in rules.MERCHANT_HINTS.values()]]
COUPON_TEXTS = [
    "Save 10% with promo code: fall20 today", "Use code SAVE-10", "use the code 15OFF now", "with coupon code  HELLO_5 only", "Apply code BUNDLE2 in cart", "Enter code ABC",
    "CODE: XMAS24!", "code FREE at checkout", "code WINTER9 at checkout", "Take 5 off, SPRING25 at checkout", "coupon = LUCKY7", "no code needed, use code FAKE1",
    "Automatically applied. code: NOPE1", "use code AND", "use code the", "promo code 12345 then use code REAL5", "voucher code: SM-1234A or code: SECOND2", "postal code V5K 0A1", "",
    "  ", "rien du tout", "code WORD at checkout with code ÉTÉ20", "No coupon; code: X10", "code not required: use code ZZ9",
]
TITLE_MARKS = ["", "[EXPIRED] ", "Hot: ", "DEAL — ", "*** ", "🔥🔥 ", "  sale  ", "Update - ", "[ymmv] ", "dead ", "Expired: [dead] ", "© ", "★ best "]
ENDINGS = ["", " [Expired]", " ***", " ™", "  —", " :", " (QN55X90) 4K", " 256GB", " with MODEL-X1 kit", " Crème brûlée à l'été", " 12 pk", " n° 5"]
DESCRIPTIONS = [
    None, "", "A rectangular coffee table. Fits any room.", "<p>Warm &amp; soft</p> duvet", "Tea &lt;3&nbsp;cups", "Plain words without a stop " * 4, "x" * 300, "word " * 60, "<b></b>",
    "Ends here! Then a sofa.", "It's &quot;great&quot; &#39;now&#39; &amp;lt;ok&amp;gt; " + "and more of it " * 15,
]


def pick(texts: list[str | None], key: str, step: int = 1) -> Column:
    """The text that a number points to."""
    place = F.col(key) if step == 1 else F.floor(F.col(key) / step)
    return F.get(F.array(*[F.lit(x).cast("string") for x in texts]), (place % len(texts)).cast("int"))


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listed(texts) -> str:
    return "[" + ", ".join(map(quoted, texts)) + "]"


def pick_sql(texts: list[str | None], key: str, step: int = 1) -> str:
    return f"({listed(texts)})[CAST(floor({key} / {step}) % {len(texts)} AS INTEGER) + 1]"


def parts(spark, sf_dir: str, texts: list[str]) -> DataFrame:
    """p_partkey, p_brand, title, description, hint, merchant; the title names one of ``texts``."""
    title = F.concat(pick(TITLE_MARKS, "p_partkey", 7), F.col("p_name"), F.lit(" "), pick(texts, "p_partkey"), pick(ENDINGS, "p_partkey", 5))
    return mart.parts(spark, sf_dir).select(
        "p_partkey", "p_brand", title.alias("title"), pick(DESCRIPTIONS, "p_partkey", 3).alias("description"),
        pick(DEPARTMENT_HINTS, "p_partkey", 2).alias("hint"), pick(MERCHANTS, "p_partkey").alias("merchant"),
    )


def parts_sql(texts: list[str]) -> str:
    return f"""SELECT p_partkey, p_brand, {pick_sql(TITLE_MARKS, "p_partkey", 7)} || p_name || ' ' || {pick_sql(texts, "p_partkey")} || {pick_sql(ENDINGS, "p_partkey", 5)} AS title,
        {pick_sql(DESCRIPTIONS, "p_partkey", 3)} AS description, {pick_sql(DEPARTMENT_HINTS, "p_partkey", 2)} AS hint, {pick_sql(MERCHANTS, "p_partkey")} AS merchant FROM part"""


#: Ways to write an address; {} stands for the page's own, {e} for it with its marks encoded.
ADDRESSES = [
    "{}", " {}?utm_source=x&b=2&a=1&a=0 ", "{}/?ref=1", "https://go.redirectingat.com/?id=1&url={e}", "{}#part", "{}?flag&q=a=b&&UTM_ID=3", "HTTP://WWW.amazon.ca/dp/B000000000?tag=t&k=v&TH=1",
    "https://shop.bestbuy.ca:443/en/p/?icmp=1&intl=2&sku=3", "http://example.org:8080/", "no address", "ftp://example.org/file", "https://www.redflagdeals.com/out?url=https%3A%2F%2Fwww.walmart.ca%2Fip%2F1%3Fathbdg%3D1%26x%3D2",
    "https://redflagdeals.com/out?url=not-one", "https://notamazon.ca/?tag=kept", "https://dpbolvw.net/click?url=https%3A%2F%2Flinksynergy.com%2Ffs%3Fmurl%3Dhttps%253A%252F%252Fa.ca%252Fb%252F", "https://a.ca/b/?z=1/",
]


def addresses(spark, sf_dir: str) -> DataFrame:
    address = F.replace(F.replace(pick(ADDRESSES, "page_id"), F.lit("{e}"), F.url_encode("url")), F.lit("{}"), F.col("url"))
    return mart.table(spark, sf_dir, "pages").select("page_id", address.alias("url"))


ADDRESSES_SQL = f"SELECT page_id, replace(replace({pick_sql(ADDRESSES, 'page_id')}, '{{e}}', url_encode(url)), '{{}}', url) AS url FROM pages"

#: Marks and anchors put after a page's own text.
MARKS = [
    "", "cdn.shopify.com/s", "x.demandware.static/", "/_ui/responsive/theme", "/static/version12/frontend", "/wp-json/", "<script type='application/ld+json'>{}</script>", "mage/cookies and Shopify.theme",
]
ANCHORS = [
    "", "<a href='/a/b'>x</a><A class=c HREF = \"//cdn.ca/x\">y</A>", "<a href=\"c?d=1\">z</a><a href='#top'>t</a><a href='mailto:a@b.ca'>m</a>",
    "<a\nhref='https://other.ca/p#frag'>o</a><a href='/a/b'>again</a><a href='/a/b'>again</a>", "<link href='/style.css'><a name='x'>n</a><a href=' d '>d</a>",
]


def pages(spark, sf_dir: str) -> DataFrame:
    html = F.concat("html", pick(MARKS, "page_id"), pick(ANCHORS, "page_id", 3))
    return mart.table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


PAGES_SQL = f"SELECT page_id, url, html || {pick_sql(MARKS, 'page_id')} || {pick_sql(ANCHORS, 'page_id', 3)} AS html FROM pages"
