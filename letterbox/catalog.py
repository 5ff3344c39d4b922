"""All queries of the package with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterbox import oracle as O
from letterbox.functions import clean as C
from letterbox.functions import patterns as P
from letterbox.functions import text as T
from letterbox.functions import validate as V
from letterbox.functions.categorize import CATEGORIES, categorize
from letterbox.functions.ocr_text import KNOWN, MISREAD, ocr_emails
from letterbox.operators import dom as D
from letterbox.operators import emails as E
from letterbox.operators import links as L
from letterbox.operators import metrics as M
from letterbox.plans import feeds, pipeline
from letterbox.sources.tables import host

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


FEED = f"WITH feed AS ({feeds.FEED_SQL}) "
_EMAILS = FEED + ", e AS (SELECT *, lower(trim(raw)) AS email FROM feed WHERE length(raw) - length(replace(raw, '@', '')) = 1 AND raw NOT LIKE '% %') "
_LOCAL, _DOMAIN = "split_part(email, '@', 1)", "split_part(email, '@', 2)"


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.candidates(spark, sf_dir).filter(C.one_at(F.col("raw")) & ~F.contains("raw", F.lit(" ")))
    return feed.withColumn("email", F.lower(F.trim("raw")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate address of the documents, with the reason for its verdict."""
    found = pipeline.judge_texts(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "email", "raw", F.array_join("extractors", ",").alias("extractors"), F.coalesce("reason", F.lit("accepted")).alias("verdict"))


FLAGSHIP = flagship


@_query(f"SELECT doc_id, raw, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{P.EM}')) AS raw FROM documents) GROUP BY ALL")
def email_scan_documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.explode(T.find_all(F.col("text"), P.EM)).alias("raw")).groupBy("doc_id", "raw").agg(F.count("*").alias("n"))


@_query(f"SELECT page_id, raw, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{P.EM}')) AS raw FROM pages) GROUP BY ALL")
def email_scan_pages(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").filter(F.contains("html", F.lit("@")))
    return pages.select("page_id", F.explode(T.find_all(F.col("html"), P.EM)).alias("raw")).groupBy("page_id", "raw").agg(F.count("*").alias("n"))


@_query(f"SELECT conv_id, turn, {O.normalized('text')} AS text FROM conversations")
def text_normalize(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize_text(F.col("text")).alias("text"))


_DOCS = f"SELECT doc_id, {O.normalized('text')} AS t FROM documents"
_DOC_FINDS = O.finds(f"({_DOCS})", "doc_id", "t")


@_query(_DOC_FINDS)
def text_candidates(spark, sf_dir):
    return pipeline.text_candidates(_read(spark, sf_dir, "documents"))


@_query(f"WITH {O.judged(_DOC_FINDS, 'SELECT doc_id, text AS body FROM documents', 'doc_id')} SELECT * FROM judged")
def document_verdicts(spark, sf_dir):
    return flagship(spark, sf_dir)


@_query(FEED + O.finds(f"(SELECT cand_id, {O.normalized(feeds.FRAMES)} AS t FROM feed)", "cand_id", "t"))
def framed_candidates(spark, sf_dir):
    feed = feeds.spread(feeds.candidates(spark, sf_dir)).withColumn("text", F.expr(feeds.FRAMES))
    return pipeline.text_candidates(feed, "cand_id")


def _clean_query(name, step):
    def run(spark, sf_dir):
        feed = feeds.candidates(spark, sf_dir)
        return feed.select("cand_id", "raw", step(F.col("raw")).alias("cleaned"))

    run.__name__ = f"clean_{name}" if name != "domain" else "clean_domain_prefix"
    _query(FEED + f"SELECT cand_id, raw, {O.cleaned('raw', name)} AS cleaned FROM feed")(run)


for _name, _step in (("phone", C.strip_phone), ("hours", C.strip_hours), ("year", C.strip_year), ("percent", C.strip_percent), ("letter", C.strip_letter), ("domain", C.strip_domain)):
    _clean_query(_name, _step)


def _decode_query(name, find, text):
    def run(spark, sf_dir):
        feed = feeds.candidates(spark, sf_dir).withColumn("text", F.expr(text))
        return feed.select("cand_id", F.explode(find(F.col("text"))).alias("email"))

    run.__name__ = name
    _query(FEED + "SELECT cand_id, loc || '@' || dom AS email FROM feed")(run)


_decode_query("decode_brackets", T.written_out, "loc || ' [at] ' || seg || ' [dot] ' || tld")
_decode_query("decode_at_dot", T.written_out, "'write to ' || loc || ' at ' || seg || ' dot ' || tld || ' now'")
_decode_query("decode_js_concat", T.scripts, """'x = "' || loc || '" + "@" + "' || seg || '" + "." + "' || tld || '"'""")
_decode_query("decode_unescape", T.scripts, """'unescape("' || loc || '%40' || dom || '")'""")
_decode_query("decode_char_codes", T.scripts, "'String.fromCharCode(' || array_join(transform(filter(split(loc || '@' || dom, ''), c -> c <> ''), c -> CAST(ascii(c) AS STRING)), ', ') || ')'")
_decode_query("decode_base64", T.scripts, "'atob(\\'' || base64(CAST(loc || '@' || dom AS BINARY)) || '\\')'")
_decode_query("decode_entities", T.entities, "loc || '&#64;' || seg || '&#46;' || tld")
_decode_query("decode_spaced", T.spaced, "loc || ' @ ' || seg || ' . ' || tld")


@_query(FEED + "SELECT cand_id, translate(raw, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS twin FROM feed")
def decode_rot13(spark, sf_dir):
    return feeds.candidates(spark, sf_dir).select("cand_id", T.rot13(F.col("raw")).alias("twin"))


_KEY = f"CASE WHEN {_DOMAIN} IN ('gmail.com', 'googlemail.com') THEN replace({_LOCAL}, '.', '') || '@' || {_DOMAIN} ELSE email END"


@_query(_EMAILS + f"SELECT k AS email, count(*) AS n, min(raw) AS raw FROM (SELECT {_KEY} AS k, raw FROM e) GROUP BY k")
def normalize_first(spark, sf_dir):
    rows = _emails(spark, sf_dir).withColumn("key", C.dedup_key(F.col("raw")))
    return rows.groupBy(F.col("key").alias("email")).agg(F.count("*").alias("n"), F.min("raw").alias("raw"))


@_query(
    f"WITH m AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{P.EM}'))) AS email, {O._bytes('lower(text)')} AS low FROM documents)"
    f" SELECT doc_id, email, {O.example('low', 'email')} AS example FROM m"
)
def context_filter(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@")))
    rows = docs.select("doc_id", "text", F.explode(F.array_distinct(F.transform(T.find_all(F.col("text"), P.EM), F.lower))).alias("email"))
    return rows.select("doc_id", "email", V.in_example_context(F.col("email"), F.col("text")).alias("example"))


_SUFFIX = O.SUFFIX
_DIMS = f", mx AS ({feeds.MX_SQL}), dis AS ({feeds.DISPOSABLE_SQL}) "
_REASON = O.reason("dis.domain IS NOT NULL", "has_mx")
_JUDGED = _EMAILS + _DIMS + f", j AS (SELECT cand_id, email, {_REASON} AS reason FROM e LEFT JOIN dis ON dis.domain = {_DOMAIN} LEFT JOIN mx ON mx.domain = {_DOMAIN}) "


def _judged(spark, sf_dir):
    feed = feeds.candidates(spark, sf_dir)
    rows = E.mx_lookup(E.disposable_lookup(_emails(spark, sf_dir), feeds.disposable_domains(feed)), feeds.mx_snapshot(feed))
    reason = V.rejection_reason(F.col("email"), F.col("disposable"), F.col("has_mx"))
    return rows.select("cand_id", "email", F.coalesce(reason, F.lit("accepted")).alias("reason"))


@_query(_JUDGED + "SELECT cand_id, email, reason FROM j")
def validation_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir)


@_query(_JUDGED + "SELECT reason, count(*) AS n FROM j GROUP BY reason")
def validation_funnel(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@_query(_EMAILS + _DIMS + f"SELECT cand_id, email FROM e WHERE {_DOMAIN} NOT IN (SELECT domain FROM dis)")
def disposable_anti(spark, sf_dir):
    feed = feeds.candidates(spark, sf_dir)
    rows = _emails(spark, sf_dir).withColumn("domain", C.domain_part(F.col("email")))
    return rows.join(feeds.disposable_domains(feed), "domain", "left_anti").select("cand_id", "email")


@_query(_EMAILS + _DIMS + f"SELECT cand_id, email, CASE WHEN has_mx IS NULL THEN 'unknown' WHEN has_mx THEN 'yes' ELSE 'no' END AS mx FROM e LEFT JOIN mx ON mx.domain = {_DOMAIN}")
def mx_lookup(spark, sf_dir):
    rows = E.mx_lookup(_emails(spark, sf_dir), feeds.mx_snapshot(feeds.candidates(spark, sf_dir)))
    return rows.select("cand_id", "email", F.when(F.col("has_mx").isNull(), "unknown").when(F.col("has_mx"), "yes").otherwise("no").alias("mx"))


@_query(_EMAILS + f"SELECT cand_id, email FROM e WHERE {_SUFFIX}")
def bad_suffix(spark, sf_dir):
    return _emails(spark, sf_dir).filter(V.bad_suffix(F.col("email"))).select("cand_id", "email")


@_query(_EMAILS + f"SELECT cand_id, email FROM e WHERE lower(regexp_extract(email, '([^.]*)$', 1)) IN ({','.join(repr(x) for x in V.FILE_SUFFIXES)}, 'fr')")
def suffix_join(spark, sf_dir):
    dim = spark.createDataFrame([(x,) for x in [*V.FILE_SUFFIXES, "fr"]], "suffix string")
    return E.suffix_matches(_emails(spark, sf_dir).select("cand_id", "email"), dim)


def _category_sql() -> str:
    return _EMAILS + f", c AS (SELECT cand_id, email, {O.category('email')} AS category FROM e) "


@_query(_category_sql() + "SELECT cand_id, email, category FROM c")
def categorize_argmax(spark, sf_dir):
    return _emails(spark, sf_dir).select("cand_id", "email", categorize(F.col("email")).alias("category"))


@_query(_category_sql() + "SELECT category, count(*) AS n FROM c GROUP BY ROLLUP (category)")
def category_rollup(spark, sf_dir):
    return M.category_counts(categorize_argmax(spark, sf_dir))


@_query(_category_sql() + "SELECT category, count(DISTINCT email) AS n, string_agg(DISTINCT email, chr(10) ORDER BY email) AS emails FROM c GROUP BY category")
def category_listing(spark, sf_dir):
    return M.category_listing(categorize_argmax(spark, sf_dir))


@_query("SELECT page_id, " + " + ".join(f"CAST(contains(lower(html), '{w}') AS INT)" for w in P.CHALLENGE) + " AS hits FROM pages")
def challenge_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", V.challenge_hits(F.col("html")).alias("hits"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def anchor_links(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(T.find_all(F.col("html"), '<a href="([^"]*)"', 1)).alias("href"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def dom_anchors(spark, sf_dir):
    n = D.nodes(D.parse_dom(_read(spark, sf_dir, "pages")))
    return n.filter((F.col("tag") == "a") & D.attr("href").isNotNull()).select("page_id", D.attr("href").alias("href"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<meta charset=\"([^\"]*)\"', 1)) AS charset FROM pages")
def dom_attributes(spark, sf_dir):
    n = D.nodes(D.parse_dom(_read(spark, sf_dir, "pages")))
    return n.filter((F.col("tag") == "meta") & D.attr("charset").isNotNull()).select("page_id", D.attr("charset").alias("charset"))


@_query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n_items, len(regexp_extract_all(html, '<div[ >]')) AS n_blocks FROM pages")
def dom_tag_counts(spark, sf_dir):
    n = D.nodes(D.parse_dom(_read(spark, sf_dir, "pages")))
    return n.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("n_items"), F.count_if(F.col("tag") == "div").alias("n_blocks"))


@_query()
def dom_candidates(spark, sf_dir):
    return D.extract_pages(_read(spark, sf_dir, "pages"))


@_query()
def dom_verdicts(spark, sf_dir):
    found = pipeline.judge_pages(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "email", "raw", F.array_join("extractors", ",").alias("extractors"), F.coalesce("reason", F.lit("accepted")).alias("verdict"))


_FOUND = " UNION ALL ".join(
    [f"SELECT page_id, '{k}' AS extractor, {v} AS raw FROM made" for k, vs in feeds.FOUND.items() for v in vs]
    + [f"SELECT page_id, '{k}' AS extractor, unnest({O.raws(O.pattern_families('t'))}) AS raw FROM (SELECT page_id, {v} AS t FROM made)" for k, vs in feeds.SUITED.items() for v in vs]
    + [f"SELECT page_id, '{k}' AS extractor, unnest({O.raws(f('t'))}) AS raw FROM (SELECT page_id, {O.normalized(feeds.PAGE_TEXT)} AS t FROM made)" for k, f in (("page text", O.pattern_families), ("detector", O.detector_families))]
)
_MADE = FEED + ", made AS (SELECT cand_id AS page_id, * FROM feed) "


def _made(spark, sf_dir, html):
    return feeds.made_pages(feeds.spread(feeds.candidates(spark, sf_dir)), html)


@_query(_MADE + _FOUND)
def page_extractors(spark, sf_dir):
    return D.extract_pages(_made(spark, sf_dir, feeds.HTML), every_text=False)


_PAGE_JUDGED = _MADE + ", " + O.judged(_FOUND, f"SELECT page_id, {feeds.HTML} AS body FROM made", "page_id")


@_query(_PAGE_JUDGED + " SELECT * FROM judged")
def page_verdicts(spark, sf_dir):
    found = pipeline.judge_pages(_made(spark, sf_dir, feeds.HTML))
    return found.select("page_id", "email", "raw", F.array_join("extractors", ",").alias("extractors"), F.coalesce("reason", F.lit("accepted")).alias("verdict"))


@_query(_PAGE_JUDGED + f" SELECT page_id, email, {O.category('email')} AS category FROM judged WHERE verdict = 'accepted'")
def page_categories(spark, sf_dir):
    return pipeline.extract(_made(spark, sf_dir, feeds.HTML)).select("page_id", "email", "category")


@_query(_MADE + f"SELECT extractor, page_id, count(DISTINCT raw) AS n FROM ({_FOUND} UNION ALL SELECT page_id, 'source', {feeds._at('l18')} FROM made) GROUP BY ALL")
def extractor_report(spark, sf_dir):
    return pipeline.extractor_report(_made(spark, sf_dir, feeds.HTML))


_RULED = " UNION ALL ".join(f"SELECT page_id, '{k}' AS rule, {v} AS url FROM made" for k, vs in feeds.RULED.items() for v in feeds.ruled(vs))


@_query(_MADE + _RULED)
def page_links(spark, sf_dir):
    return L.rules_of_pages(_made(spark, sf_dir, feeds.LINK_HTML)).select("page_id", "rule", "url")


@_query()
def dom_links(spark, sf_dir):
    return L.rules_of_pages(_read(spark, sf_dir, "pages"), keywords=("the", "and", "contact"))


_GUESSES = "[" + ",".join(f"'/{p}{w}'" for p in L.GUESS_PREFIXES for w in L.GUESS_WORDS) + "]"
_RANK = f"""
WITH b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, html FROM pages),
c AS (SELECT page_id, CASE WHEN starts_with(u, 'http') THEN u ELSE base || CASE WHEN ends_with(base, '/') OR starts_with(u, '/') THEN '' ELSE '/' END || u END AS url, g FROM (
 SELECT page_id, base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS u, 0 AS g FROM b
 UNION ALL SELECT page_id, base, unnest({_GUESSES}) AS u, 1 AS g FROM b)),
d AS (SELECT page_id, url, min(g) AS g FROM c WHERE NOT regexp_matches(url, '(?:{V.any_of(V.CONTACT_SUFFIXES)})$') GROUP BY page_id, url)
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN contains(lower(url), 'contact') THEN 0 ELSE 1 END, strlen(url), g, url) AS r FROM d) WHERE r = 1
"""


@_query(_RANK)
def contact_rank_top1(spark, sf_dir):
    hrefs = F.transform(T.find_all(F.col("html"), '<a href="([^"]*)"', 1), lambda u: F.struct(F.lit(0).alias("node_id"), u.alias("url")))
    best = L.best_url(L.base_of(F.col("url")), hrefs)
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_compact(F.array(best))).alias("url"))


@_query()
def contact_pages(spark, sf_dir):
    return pipeline.contact_pages(_read(spark, sf_dir, "pages"))


def _best_sql(prefer: str) -> str:
    absolute = "CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://' || dom || CASE WHEN starts_with(u, '/') THEN '' ELSE '/' END || u END"
    links = "[" + ", ".join(v for vs in feeds.RULED.values() for v in feeds.ruled(vs)) + "]"
    return (
        _MADE + f"SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY {prefer} CASE WHEN contains(lower(url), 'contact') THEN 0 ELSE 1 END, strlen(url), g) AS r FROM"
        f" (SELECT page_id, {absolute} AS url, g FROM (SELECT page_id, dom, unnest({links}) AS u, 0 AS g FROM made UNION ALL SELECT page_id, dom, unnest({_GUESSES}) AS u, 1 AS g FROM made))"
        f" WHERE NOT regexp_matches(url, '(?:{V.any_of(V.CONTACT_SUFFIXES)})$')) WHERE r = 1"
    )


@_query(_best_sql(""))
def page_contacts(spark, sf_dir):
    return pipeline.contact_pages(_made(spark, sf_dir, feeds.LINK_HTML))


@_query(_best_sql("g,"))
def page_contacts_by_link(spark, sf_dir):
    return pipeline.contact_pages(_made(spark, sf_dir, feeds.LINK_HTML), prefer_links=True)


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@_query(f"SELECT page_id, {_HOST} AS host FROM pages")
def url_hosts(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))


@_query(f"SELECT host, page_id FROM (SELECT {_HOST} AS host, page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY CASE WHEN starts_with(url, 'https:') THEN 0 ELSE 1 END, page_id) AS r FROM pages) WHERE r = 1")
def homepages(spark, sf_dir):
    from letterbox.sources.tables import pages_of_domains

    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    domains = pages.select(host(F.col("url")).alias("domain")).distinct()
    return pages_of_domains(domains, pages).select(F.col("domain").alias("host"), "page_id")


_SITES = (
    FEED + f", w AS (SELECT form, loc || '.' || dom AS domain, {feeds._at('a1')} AS a, {feeds._at('b2')} AS b FROM feed),"
    " x AS (SELECT domain, a AS email FROM w WHERE form > 2 UNION ALL SELECT domain, b FROM w WHERE form > 2 AND form % 2 = 0),"
    f" y AS (SELECT domain, count(*) FILTER ({O.reason()} = 'accepted') AS n FROM x GROUP BY domain),"
    " o AS (SELECT w.domain, coalesce(n, 0) AS n_emails, CASE WHEN form = 0 THEN 'unresolved' WHEN coalesce(n, 0) > 0 THEN 'success' ELSE 'no email' END AS outcome FROM w LEFT JOIN y USING (domain)) "
)


def _sites(spark, sf_dir):
    feed = feeds.spread(feeds.candidates(spark, sf_dir))
    return pipeline.run_sites(feed.select(F.concat_ws(".", "loc", "dom").alias("domain")), feeds.site_pages(feed))


@_query(_SITES + "SELECT domain, outcome, n_emails FROM o")
def run_sites(spark, sf_dir):
    return _sites(spark, sf_dir).select("domain", "outcome", "n_emails")


@_query(
    _SITES + "SELECT count(*) AS processed, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'unresolved') AS unresolved, count(*) FILTER (outcome = 'no email') AS no_email, CAST(sum(n_emails) AS BIGINT) AS emails,"
    " count(*) FILTER (outcome <> 'success') AS failed, 100.0 * count(*) FILTER (outcome = 'success') / count(*) AS success_pct, CAST(coalesce(sum(n_emails) / nullif(count(*) FILTER (outcome = 'success'), 0), 0) AS DOUBLE) AS emails_per_success FROM o"
)
def run_report(spark, sf_dir):
    return M.run_report(_sites(spark, sf_dir))


@_query(f"WITH i AS ({feeds.IMAGES_SQL}), p AS (SELECT *, CASE WHEN regexp_matches(lower(url), 'mail|email|contact|@') THEN 10 WHEN regexp_matches(lower(alt), 'mail|email|contact|@') THEN 5 ELSE 0 END AS priority FROM i),"
        " r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pos) AS rn FROM p) SELECT page_id, pos, priority, rn FROM r WHERE priority > 0 OR rn <= 20")  # fmt: skip
def image_selection(spark, sf_dir):
    return M.select_images(feeds.images(spark, sf_dir)).select("page_id", "pos", "priority", "rn")


_OCR = "loc || '@' || dom"
for _c in "uornaeid":
    _OCR = f"regexp_replace({_OCR}, '{_c}{{3,}}', '{_c}', 'g')"
for _old, _new in KNOWN:
    _OCR = f"replace({_OCR}, '{_old}', '{_new}')"
for _old, _new in MISREAD:
    _OCR = f"regexp_replace({_OCR}, '{_old}', '{_new.replace('$', chr(92))}', 'g')"


@_query(FEED + f"SELECT cand_id, {_OCR} AS email FROM feed")
def ocr_spaced(spark, sf_dir):
    text = F.concat(F.lit("see "), "loc", F.lit(" @ "), "seg", F.lit(" . "), "tld")
    return feeds.candidates(spark, sf_dir).select("cand_id", F.explode(ocr_emails(text)).alias("email"))


@_query(_EMAILS + f"SELECT {_DOMAIN} AS domain, count(*) AS n, count(DISTINCT {_KEY}) AS n_emails FROM e GROUP BY 1")
def domain_emails(spark, sf_dir):
    rows = _emails(spark, sf_dir).select(C.domain_part(F.col("email")).alias("domain"), C.dedup_key(F.col("raw")).alias("key"))
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_emails"))


@_query(FEED + "SELECT DISTINCT dom AS domain FROM feed WHERE strlen(dom) BETWEEN 1 AND 253 AND regexp_matches(dom, '^[a-z0-9.-]+$') AND contains(dom, '.')")
def valid_domains(spark, sf_dir):
    return feeds.candidates(spark, sf_dir).select(F.col("dom").alias("domain")).filter(V.valid_domain(F.col("domain"))).distinct()


@_query(FEED + ", a AS (SELECT dom AS host, loc AS email FROM feed WHERE form < 12), b AS (SELECT dom AS host, loc AS email FROM feed WHERE form > 7)"
        " SELECT host, email, CASE WHEN count(DISTINCT s) = 2 THEN 'homepage & contact' WHEN min(s) = 'a' THEN 'homepage' ELSE 'contact' END AS found_on FROM (SELECT host, email, 'a' AS s FROM a UNION ALL SELECT host, email, 'b' AS s FROM b) GROUP BY host, email")  # fmt: skip
def provenance(spark, sf_dir):
    feed = feeds.candidates(spark, sf_dir).select("form", F.col("dom").alias("host"), F.col("loc").alias("email"))
    return M.provenance(feed.filter("form < 12"), feed.filter("form > 7"))


@_query("SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s // 3600 AS VARCHAR) || 'h' || CAST(s % 3600 // 60 AS VARCHAR) || 'm' END AS took FROM (SELECT event_id, CAST(event_id % 10000 AS BIGINT) AS s FROM events)")
def durations(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", M.duration(F.col("event_id") % 10000).alias("took"))
