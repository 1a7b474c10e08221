"""Elements of HTML by CSS selectors, a row per match.

Pages are tokenized in Arrow batches (Spark bounds these at 64 MB), a page at a time, into a
table of elements: tag, attributes, parent, and where an element's text begins and ends.  A
selector is compiled once and tested, once a page, against the elements that have its tag,
class or attribute.  What comes out are texts and
attributes of the matches; what they mean is said by column expressions of the parsers.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

# Elements without content, of which the text is not markup, and what the start of an element ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TEXT = frozenset("script style textarea title".split())
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "a": ("a",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
ENDED_BY |= {t: ("td", "th", "tr", "tbody", "thead", "tfoot") for t in ("tbody", "thead", "tfoot")} | {t: ("p",) for t in _BLOCKS.split()}
#: Beyond these, the start of an element ends no other.
FENCES = {"li": ("ul", "ol"), "a": ("td", "th")} | {t: ("table",) for t in ("td", "th", "tr", "tbody", "thead", "tfoot", "p")}

#: Each alternative ends at its mark or with the page, so that reading takes time in proportion; a tag that has no end is none.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<written>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)(?P<mark>>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Page:
    """The elements of a page or fragment, in document order; of XML, where nothing is implied and case and CDATA count, if ``xml``."""

    def __init__(self, text: str, xml: bool = False):
        self.xml = xml
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.ends: list[int] = []  # the element after the last one inside
        self.begins: list[int] = []  # of the texts
        self.stops: list[int] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._counts: Counter[str] = Counter()  # of the open ones
        self._named: dict[tuple[str, str], list[int]] | None = None
        self._places: list[int] | None = None
        self._matches: dict[Selector, list[int]] = {}
        at = 0
        while found := _TOKEN.search(text, at):
            self._say(text[at : found.start()])
            at = found.end()
            if found["end"]:
                self._end(found["end"] if xml else found["end"].lower())
            elif found["mark"]:
                at = self._start(found["start"] if xml else found["start"].lower(), found["written"], text, at)
            elif xml and found["cdata"]:
                self.texts.append(found["cdata"])
        self._say(text[at:])
        self._close(0)

    def _say(self, text: str) -> None:
        if text:
            self.texts.append(html.unescape(text) if "&" in text else text)

    def _start(self, tag: str, written: str, text: str, at: int) -> int:
        ended = [] if self.xml else [t for t in ENDED_BY.get(tag, ()) if self._counts[t]]
        for place in range(len(self._open) - 1, -1, -1) if ended else ():
            over = self.tags[self._open[place]]
            if over in ended:
                self._close(place)
                if over == tag:
                    break
            elif over in FENCES.get(tag, ("table",)):
                break
        if tag == "tr" and not self.xml and self._open and self.tags[self._open[-1]] == "table":
            self._add("tbody", {})
        attributes: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(written):
            value = "".join(values)
            attributes.setdefault(name if self.xml else name.lower(), html.unescape(value) if "&" in value else value)
        self._add(tag, attributes)
        if self.xml:
            if written.endswith("/"):
                self._close(len(self._open) - 1)
            return at
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b", re.IGNORECASE).search(text, at)
            stop = end.start() if end else len(text)
            if stop > at:
                self.texts.append(html.unescape(text[at:stop]) if tag in ("textarea", "title") else text[at:stop])
            return stop
        if tag in VOID:
            self._close(len(self._open) - 1)
        return at

    def _add(self, tag: str, attributes: dict[str, str]) -> None:
        self.parents.append(self._open[-1] if self._open else -1)
        self._open.append(len(self.tags))
        self._counts[tag] += 1
        self.tags.append(tag)
        self.attributes.append(attributes)
        self.begins.append(len(self.texts))
        self.ends.append(0)
        self.stops.append(0)

    def _end(self, tag: str) -> None:
        for place in range(len(self._open) - 1, -1, -1) if self._counts[tag] else ():
            if self.tags[self._open[place]] == tag:
                self._close(place)
                return

    def _close(self, place: int) -> None:
        for element in self._open[place:]:
            self.ends[element], self.stops[element] = len(self.tags), len(self.texts)
            self._counts[self.tags[element]] -= 1
        del self._open[place:]

    def text(self, element: int) -> str:
        return "".join(self.texts[self.begins[element] : self.stops[element]])

    def place(self, element: int) -> int:
        """Which child of its parent it is, from 1."""
        if self._places is None:
            counts: Counter[int] = Counter()
            self._places = []
            for parent in self.parents:
                counts[parent] += 1
                self._places.append(counts[parent])
        return self._places[element]

    def named(self, kind: str, name: str) -> list[int]:
        """The elements with a tag, a class or an attribute, in document order."""
        if self._named is None:
            self._named = defaultdict(list)
            for e, (tag, own) in enumerate(zip(self.tags, self.attributes, strict=True)):
                self._named["tag", tag].append(e)
                for a in own:
                    self._named["attribute", a].append(e)
                for c in set(own["class"].split()) if "class" in own else ():
                    self._named["class", c].append(e)
        return self._named.get((kind, name), [])

    def matches(self, selector: Selector) -> list[int]:
        """What a selector selects, in document order; found once a page."""
        found = self._matches.get(selector)
        if found is None:
            found = self._matches[selector] = selector.all(self)
        return found


# Selectors --------------------------------------------------------------------------------------

_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*(?:\|[\w-]+)?|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:nth-child\((\d+)\)|:(first-child)""")
_BETWEEN = re.compile(r"\s*([>,])\s*|\s+")

_HAS = {
    "=": lambda a, b: a == b,
    "~=": lambda a, b: b in a.split(),
    "^=": lambda a, b: bool(b) and a.startswith(b),
    "$=": lambda a, b: bool(b) and a.endswith(b),
    "*=": lambda a, b: bool(b) and b in a,
    "|=": lambda a, b: a == b or a.startswith(f"{b}-"),
}


@dataclass(frozen=True)
class Compound:
    """Conditions on one element."""

    tag: str | None
    classes: tuple[str, ...]
    id: str | None
    attributes: tuple[tuple[str, str | None, str], ...]
    nth: int | None

    def fits(self, page: Page, element: int) -> bool:
        if self.tag and page.tags[element] != self.tag:
            return False
        own = page.attributes[element]
        if self.classes and not set(self.classes).issubset(own.get("class", "").split()):
            return False
        if self.id and own.get("id") != self.id:
            return False
        for name, how, value in self.attributes:
            if name not in own or (how and not _HAS[how](own[name], value)):
                return False
        return self.nth is None or page.place(element) == self.nth

    def candidates(self, page: Page) -> list[int] | range:
        """Elements of which those that fit are some."""
        if self.classes:
            return page.named("class", self.classes[0])
        if self.id:
            return page.named("attribute", "id")
        if self.attributes:
            return page.named("attribute", self.attributes[0][0])
        return page.named("tag", self.tag) if self.tag else range(len(page.tags))


class Selector:
    """Alternatives of compounds, each behind an ancestor or parent; what can't be read is a ValueError.

    Tags, classes, ids, attributes (with all comparisons), nth-child of a number, first-child,
    descendants, children and commas.  In XML, case counts, and ``a|b`` is the tag ``a:b``.
    """

    def __init__(self, written: str, xml: bool = False):
        self.written, self.xml = written, xml
        self.alternatives: list[list[tuple[str, Compound]]] = [[]]
        at, how, text = 0, " ", written.strip()
        while at < len(text):
            compound, at = self._compound(text, at)
            self.alternatives[-1].append((how, compound))
            if at == len(text):
                return
            between = _BETWEEN.match(text, at)
            if not between or between.end() == len(text):
                raise ValueError(f"no selector: {written}")
            at, how = between.end(), between[1] or " "
            if how == ",":
                self.alternatives.append([])
                how = " "
        raise ValueError(f"no selector: {written}")

    def _compound(self, text: str, at: int) -> tuple[Compound, int]:
        tag, classes, id, attributes, nth, start = None, [], None, [], None, at
        while found := _SIMPLE.match(text, at):
            if found[1]:
                if at > start:
                    break
                tag = None if found[1] == "*" else found[1].replace("|", ":") if self.xml else found[1].lower()
            elif found[2]:
                classes.append(found[2])
            elif found[3]:
                id = found[3]
            elif found[4]:
                attributes.append((found[4] if self.xml else found[4].lower(), found[5], found[6] or found[7] or found[8] or ""))
            else:
                nth = int(found[9] or 1)
            at = found.end()
        if at == start:
            raise ValueError(f"no selector: {self.written}")
        return Compound(tag, tuple(classes), id, tuple(attributes), nth), at

    def all(self, page: Page) -> list[int]:
        """The elements that fit, in document order."""
        found = [[e for e in steps[-1][1].candidates(page) if self._fits(page, e, steps, len(steps) - 1)] for steps in self.alternatives]
        return found[0] if len(found) == 1 else sorted(set().union(*found))

    def fits(self, page: Page, element: int) -> bool:
        return any(self._fits(page, element, steps, len(steps) - 1) for steps in self.alternatives)

    def _fits(self, page: Page, element: int, steps: list[tuple[str, Compound]], last: int) -> bool:
        how, compound = steps[last]
        if not compound.fits(page, element):
            return False
        if last == 0:
            return True
        above = page.parents[element]
        while above >= 0:
            if self._fits(page, above, steps, last - 1):
                return True
            if how == ">":
                return False
            above = page.parents[above]
        return False


@dataclass(frozen=True)
class Field:
    """What to look for in a row's element: the first match of each selector, every match, or the nearest element around."""

    kind: str
    selectors: tuple[str, ...]


def first(*selectors: str) -> Field:
    """For each selector, in this order, its first match, or null."""
    return Field("first", selectors)


def every(selector: str) -> Field:
    """All matches, in document order."""
    return Field("every", (selector,))


def around(selector: str) -> Field:
    """The nearest match among the element itself and its ancestors; empty without one."""
    return Field("around", (selector,))


def found_in(page: Page, element: int | None, kind: str, selectors: list[Selector]) -> list[int | None]:
    """Elements; ``element`` None is the whole page."""
    if kind == "around":
        while element is not None and element >= 0 and not selectors[0].fits(page, element):
            element = page.parents[element]
        return [] if element is None or element < 0 else [element]
    start, end = (0, len(page.tags)) if element is None else (element + 1, page.ends[element])
    if kind == "every":
        found = page.matches(selectors[0])
        return found[bisect_left(found, start) : bisect_left(found, end)]
    out: list[int | None] = []
    for s in selectors:
        found = page.matches(s)
        at = bisect_left(found, start)
        out.append(found[at] if at < len(found) and found[at] < end else None)
    return out


_MATCH = "struct<text:string,attributes:map<string,string>>"
_MATCH_ARROW = pa.struct([("text", pa.string()), ("attributes", pa.map_(pa.string(), pa.string()))])


def select(pages: DataFrame, payload: str, rows: str | None, fields: dict[str, Field], keep: tuple[str, ...], xml: bool = False) -> DataFrame:
    """``keep``, place, row (text and attributes), and each field as an array of matches.

    A row per element that ``rows`` selects, in document order, ``place`` counting from 0; one
    per page without ``rows``.  Null payloads give no rows; texts are those of the elements
    with entities resolved, without comments.
    """
    about = StructType([*(pages.schema[k] for k in keep), StructField("__html", StringType())])
    source = pages.select(*keep, pages[payload].alias("__html")).where("__html is not null")
    compiled = {name: (f.kind, [Selector(s, xml) for s in f.selectors]) for name, f in fields.items()}
    wanted = Selector(rows, xml) if rows else None
    names = [*keep, "place", "row", *fields]
    kinds = [pa.int32(), _MATCH_ARROW, *[pa.list_(_MATCH_ARROW) for _ in fields]]

    def match(page: Page, element: int | None) -> dict | None:
        return None if element is None else {"text": page.text(element), "attributes": list(page.attributes[element].items())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], [[] for _ in kinds]
            for i, text in enumerate(batch.column("__html").to_pylist()):
                page = Page(text, xml)
                elements = page.matches(wanted) if wanted else [None]
                for place, element in enumerate(elements):
                    at.append(i)
                    values = [place, match(page, element) or {"text": "".join(page.texts), "attributes": []}]
                    values += [[match(page, e) for e in found_in(page, element, *f)] for f in compiled.values()]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kept = batch.take(pa.array(at, pa.int64()))
            columns = [kept.column(k) for k in keep] + [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType(about.fields[:-1])
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["place int", f"row {_MATCH}", *[f"`{n}` array<{_MATCH}>" for n in fields]])
    return source.mapInArrow(run, shape)
