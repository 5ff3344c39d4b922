"""Feeds derived from the standard tables, by SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "translate(CAST(c_custkey AS STRING), '0123456789', 'klmnopqrst')"
TLD = "CASE c_nationkey % 5 WHEN 0 THEN 'com' WHEN 1 THEN 'org' WHEN 2 THEN 'de' WHEN 3 THEN 'fr' ELSE 'net' END"
#: one form of an address per row: plain, shouted, written out, scripted, escaped, glued to page text, or bad
RAW = """CASE form
 WHEN 0 THEN loc || '@' || dom WHEN 1 THEN upper(loc || '@' || dom) WHEN 2 THEN loc || ' [at] ' || seg || ' [dot] ' || tld
 WHEN 3 THEN loc || ' at ' || seg || ' dot ' || tld WHEN 4 THEN '"' || loc || '" + "@" + "' || seg || '" + "." + "' || tld || '"'
 WHEN 5 THEN 'unescape("' || loc || '%40' || dom || '")' WHEN 6 THEN '3801' || loc || '@' || dom WHEN 7 THEN '9am-5pm' || loc || '@' || dom
 WHEN 8 THEN '2021-23.info@' || dom WHEN 9 THEN '%20' || loc || '@' || dom WHEN 10 THEN 'einfo@' || dom WHEN 11 THEN dom || 'office@' || dom
 WHEN 12 THEN substr(loc, 1, 1) || '.' || loc || '@gmail.com' WHEN 13 THEN loc || '+tag@' || dom WHEN 14 THEN 'noreply-' || loc || '@' || dom
 WHEN 15 THEN loc || '@mailtrash.' || tld WHEN 16 THEN loc || '@photo.png' WHEN 17 THEN loc || '..x@' || dom WHEN 18 THEN repeat('a', 65) || '@' || dom
 WHEN 19 THEN 'sales.' || loc || '@' || dom WHEN 20 THEN 'helpdesk-' || loc || '@' || dom WHEN 21 THEN 'legal.counsel.' || loc || '@' || dom ELSE 'roma12345' || loc || '@' || dom END"""
FORMS = 23
FEED_SQL = f"""
SELECT cand_id, form, loc, seg, tld, dom, {RAW} AS raw FROM (
 SELECT cand_id, form, loc, seg, tld, seg || '.' || tld AS dom FROM (
  SELECT c_custkey AS cand_id, CAST(c_custkey % {FORMS} AS INT) AS form, {LOCAL} AS loc, lower(c_mktsegment) AS seg, {TLD} AS tld FROM customer) a) b
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cand_id, form, loc, seg, tld, dom, raw: one per customer."""
    base = spark.read.parquet(f"{sf_dir}/customer.parquet")
    base = base.select(F.col("c_custkey").alias("cand_id"), F.expr(f"CAST(c_custkey % {FORMS} AS INT)").alias("form"), F.expr(LOCAL).alias("loc"), F.expr("lower(c_mktsegment)").alias("seg"), F.expr(TLD).alias("tld"))
    return base.withColumn("dom", F.expr("seg || '.' || tld")).withColumn("raw", F.explode(F.array(F.expr(RAW))))  # the explode keeps the CASE from being copied into filters


def spread(feed: DataFrame) -> DataFrame:
    """The feed dealt out by its key: a small file is one task, however much is made of each of its rows."""
    spark = feed.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return feed.repartition(parts, "cand_id")


#: a third of the domains each accept mail, refuse it, or are unknown
MX_SQL = "SELECT dom AS domain, length(dom) % 3 = 0 AS has_mx FROM (SELECT DISTINCT dom FROM feed) WHERE length(dom) % 3 < 2"
DISPOSABLE_SQL = "SELECT DISTINCT 'mailtrash.' || tld AS domain FROM feed WHERE tld <> 'fr'"


def mx_snapshot(feed: DataFrame) -> DataFrame:
    return feed.select("dom").distinct().filter(F.length("dom") % 3 < 2).select(F.col("dom").alias("domain"), (F.length("dom") % 3 == 0).alias("has_mx"))


def disposable_domains(feed: DataFrame) -> DataFrame:
    return feed.filter("tld <> 'fr'").select(F.concat(F.lit("mailtrash."), "tld").alias("domain")).distinct()


IMAGES_SQL = """
SELECT p_partkey % 50 AS page_id, p_partkey AS pos, '/img/' || CASE WHEN p_partkey % 37 = 0 THEN 'contact-' ELSE '' END || CAST(p_size AS STRING) || '.png' AS url,
 CASE WHEN p_partkey % 11 = 0 THEN 'Our Email' ELSE p_brand END AS alt FROM part
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select((F.col("p_partkey") % 50).alias("page_id"), F.col("p_partkey").alias("pos"), F.expr("'/img/' || CASE WHEN p_partkey % 37 = 0 THEN 'contact-' ELSE '' END || CAST(p_size AS STRING) || '.png'").alias("url"), F.expr("CASE WHEN p_partkey % 11 = 0 THEN 'Our Email' ELSE p_brand END").alias("alt"))


def _at(mark: str) -> str:
    return f"'{mark}' || loc || '@' || dom"


#: a page for each row of the feed with a find for every extractor, and elements that only look like one
SNIPPETS = [
    f"""'<a href="mailto:' || {_at('m1')} || '?subject=x#y">write</a><a href="tel:555">call</a>'""",
    f"""'<i data-mail="' || {_at('d2')} || '"></i><i data-mail=""></i>'""",
    f"""'<p>Contact Details<br>' || {_at('b3')} || '</p>'""",
    f"""'<b aria-label="write ' || {_at('a4')} || ' or ' || {_at('a5')} || '">x</b><b lang="' || {_at('z0')} || '">y</b>'""",
    f"""'<meta content="' || {_at('m6')} || '"><meta property="og:email" content="Mail ' || {_at('m7')} || '"><meta name="x">'""",
    f"""'<script type="application/ld+json">{{"a":[{{"contactPoint":{{"email":"' || {_at('j8')} || '"}}}}],"' || {_at('k9')} || '":"none"}}</script>'""",
    f"""'<!-- ops ' || {_at('c10')} || ' -->'""",
    f"""'<p style="display: none">' || {_at('h11')} || '</p><p style="color: red">x</p>'""",
    """'<div><span>s12' || loc || '</span>@<span>' || seg || '</span>.<span>' || tld || '</span></div>'""",
    """'<ul><b>t13' || loc || '</b><b>@' || seg || '</b><b>.' || tld || '</b></ul>'""",
    f"""'<i class="my-email">' || {_at('n14')} || '</i>'""",
    f"""'<iframe src="/f?to=' || {_at('i15')} || '"></iframe>'""",
    f"""'<input type="email" placeholder="' || {_at('f16')} || '"><input type="text" value="' || {_at('f17')} || '">'""",
    f"""'<link rel="contact" href="mailto:' || {_at('l18')} || '"><link rel="icon" href="x">'""",
]
HTML = " || chr(10) || ".join(SNIPPETS)
_LD = f"""'{{"a":[{{"contactPoint":{{"email":"' || {_at('j8')} || '"}}}}],"' || {_at('k9')} || '":"none"}}'"""
#: the texts of the page's outermost elements, joined by blanks
PAGE_TEXT = " || ' ' || ".join(["'write'", "'call'", "''", "''", "'Contact Details'", _at("b3"), "'x'", "'y'", "''", "''", "''", _LD, _at("h11"), "'x'", _at("s12"), _at("t13"), _at("n14")])
#: extractor -> what it finds, as often as it does
FOUND = {
    "mailto": [_at("m1")], "data attribute": [_at("d2")],
    "attribute": [_at(k) for k in ("m1", "d2", "a4", "a5", "m6", "m7", "f16", "f17", "l18")],
    "meta": [_at("m6"), _at("m7"), f"'Mail ' || {_at('m7')}"], "json-ld": [_at("j8"), _at("j8"), _at("k9")], "comment": [_at("c10")],
    "split element": [_at(k) for k in ("h11", "s12", "t13", "n14")], "split siblings": [_at("t13")], "named element": [_at("n14")],
    "iframe": [_at("i15")], "form control": [_at("f16")], "link rel": [_at("l18")],
}
#: texts that two extractors read through the pattern suite
SUITED = {"block text": [_at("b3"), _at("h11"), _at("s12")], "hidden": [_at("h11")]}

#: a page with a link for every rule, and links that no rule takes
LINKS = [
    """'<footer><a href="/kontakt/' || loc || '">K</a><a href="/x">y</a></footer>'""",
    """'<div class="top menu"><ul><li><a href="/n/' || loc || '">Contact</a></ul></div>'""",
    """'<header><a href="/h/' || loc || '" title="Support">x</a></header>'""",
    """'<div class="widget"><a href="/s/' || loc || '">help</a></div>'""",
    """'<p class="breadcrumb"><a href="/contact-x/' || loc || '">x</a><a href="/q" title="contact">x</a></p>'""",
    """'<meta name="contact-url" content="https://a.org/' || loc || '"><meta name="contact" content="/rel">'""",
    """'<script type="application/ld+json">{"contactPoint":{"url":"https://a.org/cp/' || loc || '"}}</script>'""",
    """'<script type="application/ld+json">{"sameAs":"https://a.org/contact/' || loc || '","url":"https://a.org/kontakt/' || loc || '"}</script>'""",
    """'<button onclick="go(&quot;/contact-go/' || loc || '&quot;)">x</button>'""",
    """'<i class="btn" data-href="/contact-b/' || loc || '">x</i>'""",
    """'<a href="/bp/' || loc || '"><button>Contact</button></a>'""",
    """'<form action="/contact/send/' || loc || '"></form><form action="/go"></form>'""",
    """'<i data-contact-url="/dc/' || loc || '"></i>'""",
    """'<link rel="contact" href="/lc/' || loc || '">'""",
    """'<meta property="og:url" content="https://a.org/contact/og' || loc || '">'""",
    """'<meta name="twitter:url" content="https://a.org/contact/tw' || loc || '">'""",
    """'<link rel="canonical" href="https://a.org/contact/ca' || loc || '"><link rel="canonical" href="/zz">'""",
    """'<link rel="alternate" href="/kontakt/al' || loc || '">'""",
    """'<div itemtype="https://schema.org/Organization"><a itemprop="contactPoint" href="/o/' || loc || '">x</a><a href="/contact-t/' || loc || '">x</a></div>'""",
    """'<div itemtype="x/ContactPage" content="/cpt/' || loc || '"><p><a href="/x2">x</a></p></div>'""",
    """'<a itemprop="url" href="/contact-ip/' || loc || '">x</a>'""",
    """'<div typeof="LocalBusiness"><i property="contactPoint" content="/rd/' || loc || '"></i></div>'""",
    """'<div typeof="Organization"><a href="/contact-tr/' || loc || '">x</a></div><a href="/none">z</a>'""",
]
LINK_HTML = " || chr(10) || ".join(LINKS)
#: rule -> beginnings of its URLs, behind which the row's name stands; behind = a whole URL
RULED = {
    "footer": ["/kontakt/"], "nav": ["/n/"], "header": ["/h/"], "sidebar": ["/s/"], "breadcrumb": ["/contact-x/"],
    "anchor": ["/kontakt/", "/n/", "/h/", "/s/", "/contact-x/", "=/q", "/bp/", "/contact-t/", "/contact-ip/", "/contact-tr/"],
    "meta url": ["https://a.org/"], "meta name": ["https://a.org/", "=/rel"], "json contact point": ["https://a.org/cp/"],
    "json url": ["https://a.org/cp/", "https://a.org/contact/", "https://a.org/kontakt/"], "button onclick": ["/contact-go/"], "button link": ["/contact-b/"],
    "button parent": ["/bp/"], "form action": ["/contact/send/"], "data attribute": ["/dc/"], "link contact": ["/lc/"], "link relation": ["/lc/"],
    "og url": ["https://a.org/contact/og"], "card url": ["https://a.org/contact/tw"], "canonical": ["https://a.org/contact/ca"], "alternate": ["/kontakt/al"],
    "organization": ["/o/"], "typed item": ["/contact-t/"], "contact page type": ["/cpt/"], "item property": ["/contact-ip/"],
    "rdfa organization": ["/rd/"], "typed resource": ["/contact-tr/"],
}


def ruled(urls: list[str]) -> list[str]:
    return [f"'{u[1:]}'" if u.startswith("=") else f"'{u}' || loc" for u in urls]


#: a frame around an address for every pattern of the suites
FRAMES = " || chr(10) || ".join([
    f"""'mailto:' || {_at('a')} || ' mailto=' || {_at('b')} || ' mail to:' || {_at('c')}""",
    f"""'email: ' || {_at('d')} || ' contact=' || {_at('e')} || ' alt="x ' || {_at('f')} || '" title="' || {_at('g')} || ' y"'""",
    f"""'<i data-email="' || {_at('h')} || '" x-mail="' || {_at('i')} || '" data-contact="' || {_at('j')} || '">'""",
    f"""'{{"email": "' || {_at('k')} || '", "contact": "' || {_at('l')} || '"}}'""",
    f"""'{{"@type":"ContactPoint","email":"' || {_at('m')} || '"}}'""",
    f"""'itemprop="email" content="' || {_at('n')} || '" property="og:email" content="' || {_at('o')} || '"'""",
    f"""'p:after {{ content: "' || {_at('p')} || '" }} var x = "' || {_at('q')} || '"; const y = "' || {_at('r')} || '"'""",
    f"""'<!-- ' || {_at('s')} || ' --> /* ' || {_at('t')} || ' */ // ' || {_at('u')} || ' <!-- a@b ' || {_at('v')} || ' -->'""",
    "loc || ' [at] ' || seg || ' [dot] ' || tld || ', ' || loc || '{at}' || seg || '{dot}' || tld || ', ' || loc || ' (at) ' || seg || ' (dot) ' || tld",
    "loc || ' <at> ' || seg || ' <dot> ' || tld || ', ' || loc || ' at ' || seg || ' dot ' || tld || ', ' || loc || ' AT ' || seg || ' DOT ' || tld",
    "loc || '&#64;' || seg || '&#46;' || tld || ' ' || loc || '&commat;' || seg || '&period;' || tld || ' ' || loc || '&#x40;' || seg || '&#x2e;' || tld",
    """'"' || loc || '" + "@" + "' || seg || '" + "." + "' || tld || '" ' || loc || ' @ ' || seg || ' . ' || tld""",
    """'String.fromCharCode(97, 64,98,46,100,101) unescape("' || loc || '%40' || dom || '") ' || 'atob("aW5mb0BhLmRl") atob("!!")'""",
    f"""'email("' || {_at('w')} || '") email="' || {_at('x')} || '" email: "' || {_at('y')} || '" ${{user.email + 1}} xinfo@' || dom""",
    "'é' || loc || '@' || dom || ' QUJDREVGR0hJSktMTU5PUFFS=@' || dom || ' ' || loc || '@' || seg || '.co.' || tld",
])

#: sites of the feed: homepages, contact pages for even forms, a second homepage without TLS; form 0 has none
HOME = f"""CASE WHEN form IN (1, 2) THEN '<p>nothing</p>' ELSE '<p>' || {_at('a1')} || ' noreply@' || dom || '</p><a href="/contact">c</a>' END"""
CONTACT = f"'<p>' || {_at('a1')} || ' ' || {_at('b2')} || '</p>'"


def made_pages(feed: DataFrame, html: str) -> DataFrame:
    return feed.select(F.col("cand_id").alias("page_id"), F.expr("'https://' || dom || '/'").alias("url"), F.expr(html).alias("html"))


def site_pages(feed: DataFrame) -> DataFrame:
    def some(rows: str, first: int, url: str, html: str) -> DataFrame:
        return feed.filter(rows).select((F.col("cand_id") + first).alias("page_id"), F.expr(url).alias("url"), F.expr(html).alias("html"))

    home = some("form > 0", 0, "'https://' || loc || '.' || dom || '/'", HOME)
    contact = some("form > 2 AND form % 2 = 0", 100_000_000, "'https://' || loc || '.' || dom || '/contact'", CONTACT)
    return home.unionByName(contact).unionByName(some("form > 2 AND form % 5 = 0", 200_000_000, "'http://' || loc || '.' || dom || '/'", f"'<p>' || {_at('c3')} || '</p>'"))
