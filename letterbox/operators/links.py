"""Finding a site's contact page: link rules over nodes, guesses, and a ranking that takes one."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterbox.functions import rows as R
from letterbox.functions.clean import let
from letterbox.functions.text import find_all, none
from letterbox.functions.validate import CONTACT_SUFFIXES, bad_contact_url
from letterbox.operators.dom import Node, read_pages

#: words for "contact" in a dozen languages; a longer lexicon is a parameter (see sources.lexicons)
KEYWORDS = ("contact", "kontakt", "contacto", "contato", "contatti", "contattaci", "contactez", "kapcsolat", "iletisim", "yhteystiedot", "impressum", "about", "support", "reach us", "get in touch", "feedback", "help", "контакт", "お問い合わせ", "联系", "문의")
#: guesses are every prefix before every word
GUESS_PREFIXES = ("", "en/", "de/", "fr/", "es/", "it/", "pt/", "pages/", "about/", "company/")
GUESS_WORDS = ("contact", "contact-us", "contactus", "kontakt", "contacto", "contato", "contatti", "contactez-nous", "kapcsolat", "iletisim", "impressum", "about", "about-us")
#: fixed values: classes and ids of page regions; a bare word is also an element name
REGIONS = {
    "footer": (("footer",), ("footer", "site-footer", "main-footer", "page-footer", "footer-menu", "footer-nav", "footer-links", "footer-bottom", "footer-top", "footer-main"), ("footer",)),
    "nav": (("nav",), ("nav", "navigation", "menu", "main-nav", "primary-nav", "header-nav", "top-nav", "main-menu", "primary-menu", "navbar", "nav-menu", "site-nav", "header-menu", "top-menu", "main-navigation"), ()),
    "header": (("header",), ("header", "site-header", "main-header", "top-header", "header-menu", "header-nav", "header-links"), ("header",)),
    "sidebar": ((), ("sidebar", "side-nav", "side-menu", "widget", "sidebar-widget", "side-widget", "sidebar-menu", "side-navigation", "sidebar-nav"), ("sidebar",)),
    "breadcrumb": ((), ("breadcrumb", "breadcrumbs", "breadcrumb-nav"), ()),
}
#: fixed values: where structured data names a contact page
JSON_URLS = (
    r'"url"\s*:\s*"([^"]*contact[^"]*)"', r'"contactPoint"\s*:\s*\{[^}]*"url"\s*:\s*"([^"]*)"', r'"contact"\s*:\s*\{[^}]*"url"\s*:\s*"([^"]*)"',
    r'"sameAs"\s*:\s*"([^"]*contact[^"]*)"', r'"url"\s*:\s*"([^"]*kontakt[^"]*)"', r'"url"\s*:\s*"([^"]*contacto[^"]*)"',
)


def mentions(words: Sequence[str], *columns: Column) -> Column:
    """Whether any column contains one of the words, in any case."""
    pattern = "|".join(re.escape(w.lower()) for w in words if w)
    return F.lower(F.concat_ws("\n", *columns)).rlike(pattern)


def absolute(base: Column, url: Column) -> Column:
    """``url`` where it starts with http, else behind the base with one slash between."""
    slash = F.when(F.endswith(base, F.lit("/")) | F.startswith(url, F.lit("/")), "").otherwise("/")
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(base, slash, url))


def _classes(n: Node) -> Column:
    return F.split(n.value("class"), r"\s+")


def _region(n: Node, name: str) -> Column:
    tags, classes, ids = REGIONS[name]
    found = F.arrays_overlap(_classes(n), F.array(*[F.lit(c) for c in classes]))
    if tags:
        found = found | n.tag.isin(*tags)
    return found | n.value("id").isin(*ids) if ids else found


def _outer() -> Column:
    """For each kind of enclosing element that a rule asks for, the spans (node_id, last) of its nodes."""

    def spans(test) -> Column:
        return F.transform(F.filter("nodes", lambda x: test(Node(x))), lambda x: F.struct(x["node_id"].alias("a"), x["last"].alias("b")))

    def region(name: str) -> Column:
        return spans(lambda n: _region(n, name))

    typed = {
        "organization": spans(lambda n: n.has("itemtype", ["schema.org/Organization"])),
        "rdfa organization": spans(lambda n: n.has("typeof", ["Organization", "LocalBusiness"])),
        "typed item": spans(lambda n: n.has("itemtype", ["ContactPage", "Organization"])),
        "typed resource": spans(lambda n: n.has("typeof", ["ContactPage", "Organization"])),
    }
    return F.struct(*[v.alias(k) for k, v in (typed | {k: region(k) for k in REGIONS}).items()])


def _of_node(n: Node, outer: Column, keywords: Sequence[str]) -> dict[str, Column]:
    """Rule -> the URLs it takes from one node, as written (null: none)."""
    href, content, text, title = n.attr("href"), n.attr("content"), n.text, n.attr("title")
    rel, name, prop = n.value("rel"), n.value("name"), n.value("property")
    is_meta, is_link, anchor = n.tag == "meta", n.tag == "link", (n.tag == "a") & href.isNotNull()
    contact_names = ["contact", "contact-url", "contact-page", "contact-us", "contactus"]
    json = (n.tag == "script") & (n.value("type") == "application/ld+json")
    button = (n.tag == "button") | F.arrays_overlap(_classes(n), F.array(F.lit("btn"), F.lit("button")))
    onclick, data_href = n.attr("onclick"), n.attr("data-href")
    up = F.get(F.col("nodes"), n.parent)
    one, either = F.array(href), n.values("href", "content")

    def inside(which: str) -> Column:
        return F.exists(outer[which], lambda o: (o["a"] < n.id) & (n.id <= o["b"]))

    def link(test: Column, urls: Column = one) -> Column:
        return F.when(test, urls)

    about = mentions(keywords, href, text, title)
    regions = {k: link(anchor & (mentions(keywords, href, text) if k == "breadcrumb" else about) & inside(k)) for k in REGIONS}
    return {
        "organization": link(n.value("itemprop").isin("contactPoint", "contactPage") & inside("organization"), either),
        "json contact point": link(json, n.array_of(F.get_json_object(text, "$.contactPoint.url"))),
        "rdfa organization": link((prop == "contactPoint") & inside("rdfa organization"), either),
        "meta name": link(is_meta & F.contains(name, F.lit("contact")) & content.isNotNull(), F.array(content)),
        "link relation": link(is_link & F.contains(rel, F.lit("contact")) & href.isNotNull()),
        "contact page type": link(n.has("itemtype", ["ContactPage"]), either),
        "anchor": link(anchor & about),
        "meta url": link(is_meta & (name.isin(*contact_names) | prop.isin(*contact_names)) & F.startswith(content, F.lit("http")), F.array(content)),
        "json url": link(json, F.concat(*[find_all(text, p, 1) for p in JSON_URLS])),
        **regions,
        "button onclick": link(button & onclick.isNotNull() & mentions(keywords, onclick), F.slice(find_all(onclick, r"""['"]([^'"]*contact[^'"]*)['"]""", 1), 1, 1)),
        "button link": link(button & data_href.isNotNull() & mentions(keywords, data_href), F.array(data_href)),
        "button parent": link(button & (up["tag"] == "a") & mentions(keywords, text), F.array_compact(F.array(F.try_element_at(up["attrs"], F.lit("href"))))),
        "form action": link((n.tag == "form") & n.attr("action").isNotNull() & mentions(keywords, n.attr("action")), F.array(n.attr("action"))),
        "data attribute": n.values("data-contact", "data-contact-url", "data-contact-page"),
        "link contact": link(is_link & rel.isin("contact", "contact-page") & href.isNotNull()),
        "og url": link(is_meta & (prop == "og:url") & mentions(keywords, content), F.array(content)),
        "card url": link(is_meta & (name == "twitter:url") & mentions(keywords, content), F.array(content)),
        "canonical": link(is_link & (rel == "canonical") & mentions(keywords, href)),
        "alternate": link(is_link & (rel == "alternate") & mentions(keywords, href)),
        "typed item": link(anchor & mentions(keywords, href) & inside("typed item")),
        "item property": link(n.value("itemprop").isin("url", "contactPoint") & href.isNotNull() & mentions(keywords, href)),
        "typed resource": link(anchor & mentions(keywords, href) & inside("typed resource")),
    }


def found_links(keywords: Sequence[str] = KEYWORDS) -> Column:
    """Over the columns of ``parse_dom``: array of (rule, node_id, url as written) of every rule but the guesses."""

    def by(rule: str, n: Node, urls: Column) -> Column:
        good = F.filter(F.coalesce(urls, none()), lambda u: u.isNotNull() & (u != ""))
        return F.transform(good, lambda u: F.struct(F.lit(rule).alias("rule"), n.id.alias("node_id"), u.alias("url")))

    def rules(n: Node, outer: Column) -> Column:
        return F.concat(*[by(rule, n, urls) for rule, urls in _of_node(n, outer, keywords).items()])

    # the spans of regions are bound once for all nodes
    return let(_outer(), lambda outer: F.flatten(F.transform("nodes", lambda x: rules(Node(x), outer))))


# The same in the pass that parses (see ``dom.read_pages``).

_BLANKS = re.compile(f"{R.SPACE}+")
_CONTACT_NAMES = frozenset(["contact", "contact-url", "contact-page", "contact-us", "contactus"])
_ONCLICK = re.compile(r"""['"]([^'"]*contact[^'"]*)['"]""")
_CLASSES = {k: frozenset(v[1]) for k, v in REGIONS.items()}


def page_links(nodes: list[dict], keywords: Sequence[str] = KEYWORDS) -> list[tuple[str, int, str]]:
    """``found_links`` of one parsed page, (rule, node_id, url), without "json contact point" (``link_columns``)."""
    words = [w.lower() for w in keywords if w]

    def about(*values: str | None) -> bool:
        low = "\n".join(v for v in values if v is not None).lower()
        return not words or any(w in low for w in words)

    spans: dict[str, list[tuple[int, int]]] = {}
    classes_of: list[list[str]] = []
    for n in nodes:
        get, span = n["attrs"].get, (n["node_id"], n["last"])
        classes = _BLANKS.split(get("class")) if get("class") else []
        classes_of.append(classes)
        kinds = [k for k, (tags, _, ids) in REGIONS.items() if n["tag"] in tags or get("id", "") in ids or not _CLASSES[k].isdisjoint(classes)]
        if kind := get("itemtype"):
            kinds += ["organization"] * ("schema.org/Organization" in kind) + ["typed item"] * ("ContactPage" in kind or "Organization" in kind)
        if kind := get("typeof"):
            kinds += ["rdfa organization"] * ("Organization" in kind or "LocalBusiness" in kind) + ["typed resource"] * ("ContactPage" in kind or "Organization" in kind)
        for k in kinds:
            spans.setdefault(k, []).append(span)
    out: list[tuple[str, int, str]] = []
    for n, classes in zip(nodes, classes_of, strict=True):
        tag, attrs, at = n["tag"], n["attrs"], n["node_id"]
        button = tag == "button" or "btn" in classes or "button" in classes
        if not (attrs or button):
            continue
        get, text = attrs.get, n["text"] or ""
        href, content = get("href"), get("content")

        def add(rule: str, *urls: str | None, at: int = at) -> None:
            out.extend((rule, at, u) for u in urls if u)

        def inside(which: str, at: int = at) -> bool:
            return any(a < at <= b for a, b in spans.get(which, ()))

        if tag == "a" and href is not None:
            if near := about(href, text, get("title")):
                add("anchor", href)
            said = about(href, text)
            for k in REGIONS:
                if (said if k == "breadcrumb" else near) and inside(k):
                    add(k, href)
            if about(href):
                for k in ("typed item", "typed resource"):
                    if inside(k):
                        add(k, href)
        elif tag == "meta":
            name, prop = get("name", ""), get("property", "")
            if content is not None:
                if "contact" in name:
                    add("meta name", content)
                if (name in _CONTACT_NAMES or prop in _CONTACT_NAMES) and content.startswith("http"):
                    add("meta url", content)
                if prop == "og:url" and about(content):
                    add("og url", content)
                if name == "twitter:url" and about(content):
                    add("card url", content)
        elif tag == "link" and href is not None:
            rel = get("rel", "")
            if "contact" in rel:
                add("link relation", href)
            if rel in ("contact", "contact-page"):
                add("link contact", href)
            if rel in ("canonical", "alternate") and about(href):
                add(rel, href)
        elif tag == "script" and get("type") == "application/ld+json":
            add("json url", *[x for p in JSON_URLS for x in R.find_all(text, p)])
        elif tag == "form" and get("action") is not None and about(get("action")):
            add("form action", get("action"))
        if item := get("itemprop"):
            if item in ("contactPoint", "contactPage") and inside("organization"):
                add("organization", href, content)
            if item in ("url", "contactPoint") and href is not None and about(href):
                add("item property", href)
        if get("property") == "contactPoint" and inside("rdfa organization"):
            add("rdfa organization", href, content)
        if "ContactPage" in get("itemtype", ""):
            add("contact page type", href, content)
        if button:
            if get("onclick") is not None and about(get("onclick")):
                add("button onclick", *_ONCLICK.findall(get("onclick"))[:1])
            if get("data-href") is not None and about(get("data-href")):
                add("button link", get("data-href"))
            if n["parent_id"] >= 0 and nodes[n["parent_id"]]["tag"] == "a" and about(text):
                add("button parent", nodes[n["parent_id"]]["attrs"].get("href"))
        add("data attribute", get("data-contact"), get("data-contact-url"), get("data-contact-page"))
    return out


#: what ``link_columns`` makes of a page: its links, and texts in which Spark's own JSON functions look
LINK_COLUMNS = {"links": "array<struct<rule:string,node_id:int,url:string>>", "json": "array<struct<node_id:int,text:string>>"}


def link_columns(nodes: list[dict], keywords: Sequence[str] = KEYWORDS) -> dict:
    return {"links": [{"rule": k, "node_id": at, "url": u} for k, at, u in page_links(nodes, keywords)], "json": _json_texts(nodes)}


def _json_texts(nodes: list[dict]) -> list[dict]:
    return [{"node_id": n["node_id"], "text": n["text"]} for n in nodes if n["tag"] == "script" and n["text"] and n["attrs"].get("type") == "application/ld+json"]


_BASE, _LAST_BREAK = re.compile("https?://[^/?#]+"), re.compile(r"(?:\r\n|[\n\r\x85\u2028\u2029])\Z")


def best_link_columns(nodes: list[dict], url: str | None, keywords: Sequence[str] = KEYWORDS, suffixes: Sequence[str] = CONTACT_SUFFIXES) -> dict:
    """``link_columns`` with the one link that ``best_url`` puts before the page's other ones; the rest cannot win."""
    base, best, bad = (m[0] if (m := _BASE.match(url or "")) else ""), None, tuple(s for s in suffixes)
    for rule, at, u in page_links(nodes, keywords) if base else ():
        full = u if u.startswith("http") else f"{base}{u}" if u.startswith("/") or base.endswith("/") else f"{base}/{u}"
        if _LAST_BREAK.sub("", full).endswith(bad) or full.endswith(bad):
            continue
        rank = ("contact" not in full.lower(), len(full.encode()), at, full)
        if best is None or rank < best[0]:
            best = rank, {"rule": rule, "node_id": at, "url": u}
    return {"links": [best[1]] if best else [], "json": _json_texts(nodes)}


def read_links() -> Column:
    """Over ``LINK_COLUMNS``: what ``found_links`` gives."""
    made = F.transform("json", lambda x: F.struct(F.lit("json contact point").alias("rule"), x["node_id"].alias("node_id"), F.get_json_object(x["text"], "$.contactPoint.url").alias("url")))
    return F.when(F.size("json") == 0, F.col("links")).otherwise(F.concat("links", F.filter(made, lambda x: x["url"] != "")))


def rules_of_pages(pages: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """``link_rules`` of pages that are not parsed yet."""
    found = read_pages(pages, LINK_COLUMNS, lambda nodes, comments, html, url: link_columns(nodes, keywords))
    return found.select("page_id", F.explode(read_links()).alias("l")).select("page_id", "l.rule", "l.node_id", "l.url")


def link_rules(dom: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """page_id, rule, node_id, url (as written) of every rule but the guesses; the page is parsed once."""
    return dom.select("page_id", F.explode(found_links(keywords)).alias("l")).select("page_id", "l.rule", "l.node_id", "l.url")


def guess_paths(prefixes: Sequence[str] = GUESS_PREFIXES, words: Sequence[str] = GUESS_WORDS) -> list[str]:
    return [f"/{p}{w}" for p in prefixes for w in words]


def guesses(paths: Sequence[str] | None = None) -> Column:
    return F.array(*[F.lit(p) for p in (paths or guess_paths())])


def base_of(url: Column) -> Column:
    """Scheme and host of a URL, empty where it has none."""
    return F.regexp_extract(url, "^(https?://[^/?#]+)", 1)


def contact_candidates(bases: DataFrame, rules: DataFrame | None = None, with_guesses: bool = True, paths: Sequence[str] | None = None) -> DataFrame:
    """page_id, url (absolute), pos, is_guess: distinct, without files; ``bases`` has page_id and base.

    The whole list, for inspection; ``best_url`` takes the best of a page without listing the guesses.
    """
    parts = []
    if rules is not None:
        parts.append(rules.join(bases, "page_id").select("page_id", absolute(F.col("base"), F.col("url")).alias("url"), F.col("node_id").alias("pos"), F.lit(False).alias("is_guess")))
    if with_guesses:
        parts.append(bases.select("page_id", "base", F.posexplode(guesses(paths)).alias("pos", "path")).select("page_id", absolute(F.col("base"), F.col("path")).alias("url"), "pos", F.lit(True).alias("is_guess")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.filter(~bad_contact_url(F.col("url")))
    return out.groupBy("page_id", "url").agg(F.min(F.struct("is_guess", "pos")).alias("f")).select("page_id", "url", "f.pos", "f.is_guess")


def _rank(url: Column, is_guess: Column, pos: Column, prefer_links: bool) -> list[Column]:
    keys = [F.when(F.contains(F.lower(url), F.lit("contact")), 0).otherwise(1).alias("k"), F.octet_length(url).alias("n"), is_guess.alias("guess"), pos.alias("pos")]
    return [is_guess.alias("late"), *keys] if prefer_links else keys


def best_contact(candidates: DataFrame, prefer_links: bool = False) -> DataFrame:
    """The first of each page: "contact" in it, then the shortest in bytes, then the earliest."""
    best = F.min(F.struct(*_rank(F.col("url"), F.col("is_guess"), F.col("pos"), prefer_links), "url")).alias("b")
    return candidates.groupBy("page_id").agg(best).select("page_id", "b.url", "b.pos", F.col("b.guess").alias("is_guess"))


def best_url(base: Column, links: Column, prefer_links: bool = False, paths: Sequence[str] | None = None, suffixes: Sequence[str] = CONTACT_SUFFIXES) -> Column:
    """The URL that ``best_contact`` takes from ``links`` (array of (node_id, url)) and the guesses, within the row.

    Of guesses with one base only two can win: the shortest, and the shortest that says "contact".
    """
    every = [(len(p.encode()), i, p) for i, p in enumerate(paths or guess_paths())]
    guessed = {min(every), *([min(said)] if (said := [g for g in every if "contact" in g[2].lower()]) else [])} if every else set()
    own = F.transform(links, lambda u: F.struct(absolute(base, u["url"]).alias("url"), F.lit(False).alias("is_guess"), u["node_id"].alias("pos")))
    made = F.array(*[F.struct(absolute(base, F.lit(p)).alias("url"), F.lit(True).alias("is_guess"), F.lit(i).alias("pos")) for _, i, p in sorted(guessed)]) if guessed else F.slice(own, 1, 0)
    good = F.filter(F.concat(own, made), lambda u: ~bad_contact_url(u["url"], suffixes))
    ranked = F.transform(good, lambda u: F.struct(*_rank(u["url"], u["is_guess"], u["pos"], prefer_links), u["url"].alias("url")))
    return F.when(base != "", F.array_min(ranked)["url"])
