"""Pages as arrays of nodes, and the extractors that project addresses out of them.

One Arrow pass turns HTML into an array of nodes per page; everything after it is one expression over that
array, so a plan parses each page once however many extractors or link rules read it. A node carries the last
of its descendants: "inside" is an interval test within the page, without a join along the tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from letterbox.functions import patterns as P
from letterbox.functions import rows as R
from letterbox.functions.clean import let
from letterbox.functions.text import detector_suite, find_all, none, normalize_text, pattern_suite

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening tag of the values ends an open one of the key
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option", "optgroup"]),
}
#: elements nested deeper become siblings at this depth, as in browsers; nothing of them is lost
DEEPEST = 512
NODE = "struct<node_id:int,parent_id:int,last:int,tag:string,attrs:map<string,string>,text:string,lines:array<string>,kids:string,leaves:array<string>>"
_KIND = pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("lines", pa.list_(pa.string())), ("kids", pa.string()), ("leaves", pa.list_(pa.string()))]))
#: what a text without any form of an address does not have
_SIGN = re.compile(r"(?i)@|[\[({<\s]at[\])}>\s]|&#|&commat;|fromCharCode|unescape|atob|email")
_BREAK = "\0"


class _Tree(HTMLParser):
    """Nodes in document order; unclosed elements end with their parent or the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.comments: list[str] = []

    def updatepos(self, i, j):  # lines and columns are not asked for
        return j

    def _node(self, tag: str, attrs) -> int:
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k.lower(), v or "")
        self.nodes.append({"node_id": len(self.nodes), "parent_id": self.open[-1] if self.open else -1, "tag": tag, "attrs": known, "from": len(self.pieces)})
        return len(self.nodes) - 1

    def _end(self, down_to: int) -> None:
        for k in self.open[down_to:]:
            self.nodes[k] |= {"last": len(self.nodes) - 1, "to": len(self.pieces)}
        del self.open[down_to:]

    def handle_starttag(self, tag, attrs):
        while self.open and tag in CLOSED_BY.get(self.nodes[self.open[-1]]["tag"], ()):
            self._end(len(self.open) - 1)
        if len(self.open) >= DEEPEST:
            self._end(len(self.open) - 1)
        at = self._node(tag, attrs)
        if tag == "br":
            self.pieces.append(_BREAK)
        if tag in VOID:
            self.nodes[at] |= {"last": at, "to": self.nodes[at]["from"]}
        else:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                self._end(k)
                return

    def handle_data(self, data):
        self.pieces.append(data.replace(_BREAK, "�"))

    def handle_comment(self, data):
        self.comments.append(data)


def json_leaves(raw: str) -> list[str]:
    """The string values of a JSON text, not its keys; none where it is no JSON."""
    try:
        todo = [json.loads(raw)]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, (list, dict)):
            todo += list(x.values() if isinstance(x, dict) else x)[::-1]
    return out


def parse(html: str | None, every_text: bool = True) -> tuple[list[dict], list[str]]:
    """(nodes, comments) of a page; never fails, an empty page has none.

    ``every_text`` off: only texts that links, buttons and scripts have, or that show a sign of an address.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._end(0)
    children: dict[int, list[int]] = {}
    for n in tree.nodes:
        children.setdefault(n["parent_id"], []).append(n["node_id"])
    whole = ["".join(tree.pieces[n.pop("from") : n.pop("to")]) for n in tree.nodes]
    for n, raw in zip(tree.nodes, whole, strict=True):
        text = raw.replace(_BREAK, "")
        shown = every_text or n["tag"] in ("a", "button", "script") or "btn" in n["attrs"].get("class", "") or "button" in n["attrs"].get("class", "") or _SIGN.search(raw)
        n["text"] = text if shown else None
        n["lines"] = raw.split(_BREAK) if shown and _BREAK in raw else None
        own = children.get(n["node_id"], ())
        n["kids"] = joined if len(own) >= 3 and "@" in text and "@" in (joined := "".join(whole[k].replace(_BREAK, "").strip() for k in own)) else None
        n["leaves"] = json_leaves(text) if n["tag"] == "script" and n["attrs"].get("type") == "application/ld+json" else None
    return tree.nodes, tree.comments


def parse_dom(pages: DataFrame, every_text: bool = True) -> DataFrame:
    """page_id, url, html, nodes, comments of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                both = [parse(x, every_text) for x in part.column(2).to_pylist()]
                nodes = pa.array([[{**n, "attrs": list(n["attrs"].items())} for n in x] for x, _ in both], _KIND)
                yield pa.RecordBatch.from_arrays([*part.columns, nodes, pa.array([c for _, c in both], pa.list_(pa.string()))], ["page_id", "url", "html", "nodes", "comments"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id long, url string, html string, nodes array<{NODE}>, comments array<string>")


def nodes(dom: DataFrame) -> DataFrame:
    """One row per node: page_id and the node's fields."""
    return dom.select("page_id", F.explode("nodes").alias("n")).select("page_id", "n.*")


def attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


class Node:
    """The fields of one node in an expression over the array of nodes."""

    def __init__(self, x: Column):
        self.x, self.id, self.tag, self.parent, self.last = x, x["node_id"], x["tag"], x["parent_id"], x["last"]
        self.text = F.coalesce(x["text"], F.lit(""))
        self.lines = F.coalesce(x["lines"], F.array(self.text))

    def attr(self, name: str) -> Column:
        return F.try_element_at(self.x["attrs"], F.lit(name))

    def value(self, name: str) -> Column:
        return F.coalesce(self.attr(name), F.lit(""))

    def has(self, name: str, parts: list[str]) -> Column:
        """Whether the attribute contains one of ``parts``."""
        return self.value(name).rlike("|".join(re.escape(x) for x in parts))

    @staticmethod
    def array_of(value: Column) -> Column:
        return F.array_compact(F.array(value))

    def values(self, *names: str) -> Column:
        return F.array_compact(F.array(*[self.attr(n) for n in names]))


def _em(*columns: Column) -> Column:
    return F.concat(*[find_all(c, P.EM) for c in columns])


def _raws(suite: Column) -> Column:
    return F.transform(suite, lambda x: x["raw"])


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _has_at(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


def _mailto(n: Node) -> Column:
    rest = F.regexp_replace(n.attr("href"), "^mailto:", "")
    return F.when((n.tag == "a") & F.startswith(n.attr("href"), F.lit("mailto:")), F.array(_trim(F.substring_index(F.substring_index(rest, "?", 1), "#", 1))))


def _block_text(n: Node, compat: bool) -> Column:
    """Lines of text blocks; line breaks part them."""
    found = F.flatten(F.transform(F.transform(n.lines, normalize_text), lambda line: _raws(pattern_suite(line, compat))))
    return F.when(n.tag.isin("p", "div", "span", "td", "th", "li", "section") & n.text.rlike(r"(?i)@|\bat\b"), found)


def _attributes(n: Node) -> Column:
    hit = F.map_filter(n.x["attrs"], lambda k, v: k.isin(*P.ATTRIBUTES) & _has_at(v))
    return F.flatten(F.transform(F.map_values(hit), lambda v: find_all(v, P.EM)))


def _meta(n: Node) -> Column:
    content = n.attr("content")
    named = F.when(F.contains(n.attr("property"), F.lit("email")), F.array(content)).otherwise(none())
    return F.when((n.tag == "meta") & content.isNotNull(), F.concat(_em(content), named))


def _json_ld(n: Node) -> Column:
    leaves = F.filter(n.x["leaves"], lambda x: x.rlike(P.WHOLE))
    return F.when(n.x["leaves"].isNotNull(), F.concat(leaves, find_all(n.text, P.EM)))


def _hidden(n: Node, compat: bool) -> Column:
    found = F.concat(let(normalize_text(n.text), lambda text: _raws(pattern_suite(text, compat))), n.values("data-email", "data-contact", "data-mail"))
    return F.when(n.value("style").rlike(r"display: ?none|visibility: ?hidden"), found)


def _split_element(n: Node) -> Column:
    halves = F.split(_trim(n.text), "@")
    whole = F.concat(_trim(F.get(halves, F.lit(0))), F.lit("@"), _trim(F.get(halves, F.lit(1))))
    return F.when(_has_at(n.text), F.filter(F.array(F.when(F.size(halves) == 2, whole)), lambda x: x.rlike(P.WHOLE)))


def _named_element(n: Node) -> Column:
    words = ["email", "mail", "contact"]
    return F.when(n.has("class", words) | n.has("id", words), _em(n.text, n.attr("data-email"), n.attr("data-contact"), n.attr("title"), n.attr("alt")))


def _form_control(n: Node) -> Column:
    field = (n.tag == "textarea") | ((n.tag == "input") & ((n.value("type") == "email") | n.has("name", ["email"]) | n.has("id", ["email"])))
    return F.when(field, _em(n.attr("value"), n.attr("placeholder")))


def _of_node(n: Node, compat: bool) -> dict[str, Column]:
    """Extractor name -> what it finds in one node (null: nothing)."""
    return {
        "mailto": _mailto(n),
        "data attribute": n.values("data-email", "data-contact", "data-mail"),
        "block text": _block_text(n, compat),
        "attribute": _attributes(n),
        "meta": _meta(n),
        "json-ld": _json_ld(n),
        "hidden": _hidden(n, compat),
        "split element": _split_element(n),
        "split siblings": find_all(n.x["kids"], P.EM),
        "named element": _named_element(n),
        "iframe": F.when(n.tag == "iframe", _em(n.attr("src"))),
        "form control": _form_control(n),
        "link rel": F.when((n.tag == "link") & n.has("rel", ["contact", "email"]), _em(n.attr("href"))),
    }


def _root_text(compat: bool) -> Column:
    roots = F.filter("nodes", lambda x: x["parent_id"] == -1)
    return normalize_text(F.array_join(F.transform(roots, lambda x: F.coalesce(x["text"] if compat else F.array_join(x["lines"], " "), x["text"], F.lit(""))), " "))


def _named(name: str, raws: Column) -> Column:
    good = F.filter(F.coalesce(raws, none()), lambda x: x.isNotNull() & (x != ""))
    return F.transform(good, lambda x: F.struct(F.lit(name).alias("extractor"), x.alias("raw")))


def _named_finds(found: dict[str, Column]) -> Column:
    return F.concat(*[_named(name, raws) for name, raws in found.items()])


def finds(compat: bool = False) -> Column:
    """Over the columns of ``parse_dom``: all candidates of a page, an array of (extractor, raw)."""
    page = let(_root_text(compat), lambda text: _named_finds({"page text": _raws(pattern_suite(text, compat)), "detector": _raws(detector_suite(text, compat))}))
    comments = _named_finds({"comment": F.flatten(F.transform("comments", lambda c: find_all(c, P.EM)))})
    return F.concat(page, comments, F.flatten(F.transform("nodes", lambda x: _named_finds(_of_node(Node(x), compat)))))


def extract(dom: DataFrame, compat: bool = False) -> DataFrame:
    """All candidates: page_id, extractor, raw; every extractor reads the same parsed page."""
    return dom.select("page_id", F.explode(finds(compat)).alias("c")).select("page_id", "c.extractor", "c.raw")


# The same in the pass that parses: what a run asks of each of its pages, without the nodes leaving Python.

_TRIM = re.compile(rf"\A{R.SPACE}+|{R.SPACE}+{R.END}")
_OWN = ("data-email", "data-contact", "data-mail")
_BLOCKS = frozenset(["p", "div", "span", "td", "th", "li", "section"])
_NEAR_AT = re.compile(r"(?i)@|\bat\b")
_UNSEEN = re.compile("display: ?none|visibility: ?hidden")
_NAMED = ("email", "mail", "contact")


def _any(value: str, parts: tuple[str, ...]) -> bool:
    return any(x in value for x in parts)


def _finds_of_node(n: dict, compat: bool, suite: Callable[[str], list[str]]) -> Iterator[tuple[str, str | None]]:
    """``_of_node`` of one node, as pairs of extractor and find."""
    tag, attrs, text = n["tag"], n["attrs"], n["text"] or ""
    if attrs:
        own = [x for k in _OWN if (x := attrs.get(k))]
        href, style, content = attrs.get("href", ""), attrs.get("style", ""), attrs.get("content")
        if tag == "a" and href.startswith("mailto:"):
            yield "mailto", _TRIM.sub("", href[7:].split("?", 1)[0].split("#", 1)[0])
        yield from (("data attribute", x) for x in own)
        for k, v in attrs.items():
            if "@" in v and k in _ATTRIBUTES:
                yield from (("attribute", x) for x in R.emails(v))
        if tag == "meta" and content is not None:
            yield from (("meta", x) for x in R.emails(content))
            if "email" in attrs.get("property", ""):
                yield "meta", content
        if style and _UNSEEN.search(style):
            yield from (("hidden", x) for x in suite(R.normalize_text(text)))
            yield from (("hidden", x) for x in own)
        if _any(attrs.get("class", ""), _NAMED) or _any(attrs.get("id", ""), _NAMED):
            yield from (("named element", x) for v in (text, attrs.get("data-email"), attrs.get("data-contact"), attrs.get("title"), attrs.get("alt")) for x in R.emails(v))
        if tag == "iframe":
            yield from (("iframe", x) for x in R.emails(attrs.get("src")))
        if tag == "textarea" or (tag == "input" and (attrs.get("type") == "email" or "email" in attrs.get("name", "") or "email" in attrs.get("id", ""))):
            yield from (("form control", x) for k in ("value", "placeholder") for x in R.emails(attrs.get(k)))
        if tag == "link" and _any(attrs.get("rel", ""), ("contact", "email")):
            yield from (("link rel", x) for x in R.emails(href))
    if text:
        if tag in _BLOCKS and _NEAR_AT.search(text):
            yield from (("block text", x) for line in (n["lines"] if n["lines"] is not None else [text]) for x in suite(R.normalize_text(line)))
        if text.count("@") == 1:
            a, b = (_TRIM.sub("", x) for x in _TRIM.sub("", text).split("@"))
            if R.whole(f"{a}@{b}"):
                yield "split element", f"{a}@{b}"
    if n["leaves"] is not None:
        yield from (("json-ld", x) for x in n["leaves"] if R.whole(x))
        yield from (("json-ld", x) for x in R.emails(text))
    if n["kids"]:
        yield from (("split siblings", x) for x in R.emails(n["kids"]))


_ATTRIBUTES = frozenset(P.ATTRIBUTES)


def page_finds(nodes: list[dict], comments: list[str], compat: bool = False) -> list[tuple[str, str]]:
    """``finds`` of one parsed page: all (extractor, raw)."""
    seen: dict[str, list[str]] = {}

    def suite(text: str) -> list[str]:  # elements around each other often have one text
        if text not in seen:
            seen[text] = [x for _, x in R.pattern_suite(text, compat)]
        return seen[text]

    def shown(n: dict) -> str:
        return (n["text"] if compat or n["lines"] is None else " ".join(n["lines"])) or ""

    text = R.normalize_text(" ".join(shown(n) for n in nodes if n["parent_id"] == -1))
    out: list[tuple[str, str | None]] = [("page text", x) for x in suite(text)] + [("detector", x) for _, x in R.detector_suite(text, compat)]
    out += [("comment", x) for c in comments for x in R.emails(c)]
    for n in nodes:
        out += _finds_of_node(n, compat, suite)
    return [x for x in out if x[1]]


def read_pages(pages: DataFrame, columns: dict[str, str], run: Callable[[list[dict], list[str], str | None, str | None], dict], every_text: bool = False) -> DataFrame:
    """page_id, url and ``columns`` (name -> type) of what ``run`` makes of the nodes, comments, source and URL of a page."""
    schema = "page_id long, url string, " + ", ".join(f"{k} {v}" for k, v in columns.items())
    kinds = [to_arrow_type(v.dataType) for v in _parse_datatype_string(schema).fields[2:]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [run(*parse(x, every_text), x, url) for url, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *[pa.array([m[k] for m in made], kind) for k, kind in zip(columns, kinds, strict=True)]], ["page_id", "url", *columns])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(each, schema)


def extract_pages(pages: DataFrame, compat: bool = False, every_text: bool = True) -> DataFrame:
    """``extract`` of pages that are not parsed yet."""

    def run(nodes: list[dict], comments: list[str], html: str | None, url: str | None) -> dict:
        return {"c": [{"extractor": k, "raw": x} for k, x in page_finds(nodes, comments, compat)]}

    found = read_pages(pages, {"c": "array<struct<extractor:string,raw:string>>"}, run, every_text)
    return found.select("page_id", F.explode("c").alias("c")).select("page_id", "c.extractor", "c.raw")
