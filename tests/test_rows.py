"""Functions of one text against the column expressions they stand for, and how the work of a run is dealt out."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from letterbox.functions import clean as C
from letterbox.functions import patterns as P
from letterbox.functions import rows as R
from letterbox.functions import text as T
from letterbox.functions import validate as V
from letterbox.operators import dom as D
from letterbox.operators import links as L
from letterbox.plans import pipeline

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", "plain a@b.de, b.c@x.co.uk\nfoo.a@b.com-x@y.de 'q' + '@' + 'w' + '.' + 'org'", "john [at] acme [dot] com, jo at acme dot de AT x AT y DOT net john (at)\tw (dot) io",
    "é a@b.de ñandu@müller.example test@x.org  z @ w . com", "String.fromCharCode(97, 64,98,46,100,101,) String.fromCharCode(1 2,64)", "unescape('a%40b.de') unescape(\"x+y%4\") unescape('%C3%A9@x.de%E9')",
    "atob('aW5mb0BhLmRl') atob('aW5m\n b0BhLmRl') atob('aW5mb0BhLmR') atob('!!') atob('/0A=')", "x&#64;y&#46;de q&commat;r&period;org s&#x40;t&#x2e;com",
    "email('a@b.de') email=\"@\" ${user.email} data-contact=\"x@y\" <!-- a@b c@d.de --> <!-- k@m.org --> // z@z.io", "QUJDREVGR0hJSktMTU5PUFFS=@x.de İ@x.de 𝒳y@z.com ٣@x.de", "mailto:a@b.de?x mail to:c@d.org alt='call e@f.com now' \"contact\": \"g@h.net\" replace with g@h.net",
]
RAWS = ["9am-5pmjo@x.de", "3801-info@b.org", "info@x.org", "einfo@x.de", "2021-23.info@x.de", "%20%41ab@x.de", "x.deoffice@x.de", "www.x.desales@x.de", " A.B@GMail.com ", "@", "a@b@c", "", "+49 30 1ab@x.de", "verylongcompanynamemail@verylongcompanyname.de", "1:30 pm – 5 pmInfo@q.de"]
HTML = (
    "<footer><a href='/kontakt'>K</a></footer><div class='btn x' data-href='/contact-b' onclick=\"go('/contact-o')\">about</div><p>a@b.de<br>c at d dot org</p><b title='x@y.de, z@w.de' id=email>q <i>@</i> r.de</b>"
    "<script type='application/ld+json'>{\"contactPoint\": {\"url\": \"/cp\", \"email\": \"j@k.de\"}, \"url\": \"/my-contact\"}</script><a href='mailto: m@n.de ?s'><button>Help</button></a><textarea value='t@u.de'></textarea>"
    "<div itemtype='https://schema.org/Organization'><a itemprop=contactPoint href='/o' content='/oc'>contact</a></div><div typeof=LocalBusiness><i property=contactPoint content=/rd></i></div><ul><b>a</b><b>@c</b><b>.de</b></ul>"
    "<meta property=og:email content='mail m@m.de'><p style='display:none' data-mail='h@h.de'>x [at] y [dot] de</p><link rel='contact' href='/lc'><!-- c@c.de -->"
)
PAGES = [(1, "https://x.org/a", HTML), (2, "nothing", None), (3, "http://y.org", "<p>" + "</p><p>".join(TEXTS).replace("/0A=", "")), (4, "http://z.org", f"<html><body>{HTML}</body></html>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


@pytest.mark.parametrize("compat", [False, True])
def test_suites_and_keys(spark, compat):
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    body = T.normalize_text(F.col("t"))
    for r in df.select("t", T.pattern_suite(body, compat).alias("p"), T.detector_suite(body, compat).alias("d")).collect():
        text = R.normalize_text(r.t)
        assert sorted(map(tuple, r.p)) == sorted(R.pattern_suite(text, compat) + [("script", "�@")] * r.p.count(("script", "�@")))  # bytes that are no text are no find
        assert sorted(map(tuple, r.d)) == sorted(R.detector_suite(text, compat))
    keys = spark.createDataFrame([(x,) for x in RAWS], "raw string").select("raw", C.dedup_key(C.clean(F.col("raw"), compat)).alias("k")).collect()
    assert {r.raw: r.k for r in keys} == {x: R.key_of(x, compat) for x in RAWS}


def test_contexts(spark):
    pairs = [(e, t) for t in [*TEXTS, None, "é" * 40 + "Test x@y.de " + "ü" * 30 + " sample", "test " + "x" * 60 + " test a@b.de"] for e in ("a@b.de", "x@y.de", "test@x.org", "")]
    df = spark.createDataFrame(pairs, "e string, t string").select("e", "t", V.in_example_context(F.col("e"), F.col("t")).alias("near"))
    assert [r.near for r in df.collect()] == [R.Context(t).near_example(e) for e, t in pairs]


@pytest.mark.parametrize("compat", [False, True])
def test_pages(pages, compat):
    def rows(df):
        return sorted(map(tuple, df.collect()))

    assert rows(D.extract(D.parse_dom(pages, every_text=compat), compat)) == rows(D.extract_pages(pages, compat, every_text=compat))
    assert rows(L.link_rules(D.parse_dom(pages))) == rows(L.rules_of_pages(pages))


@pytest.mark.parametrize("prefer", [False, True])
def test_contact_pages(pages, prefer):
    """The pass hands one link of a page to the choice among all; the choice stays what the whole list gives."""
    dom = D.parse_dom(pages)
    bases = pages.select("page_id", L.base_of(F.col("url")).alias("base")).filter("base <> ''")
    every = L.best_contact(L.contact_candidates(bases, L.link_rules(dom)), prefer).select("page_id", "url")
    assert {r.page_id: r.url for r in pipeline.contact_pages(pages, prefer).collect()} == {r.page_id: r.url for r in every.collect()}
    read = D.read_pages(pages, L.LINK_COLUMNS, lambda nodes, comments, html, url: L.best_link_columns(nodes, url))
    assert max(r.n for r in read.select(F.size("links").alias("n")).collect()) == 1


def test_words_in_addresses(spark):
    emails = ["ROOT@x.de", "a@b.de", "no-reply@x.de", "x@y.root", "ann.spam@x.de", ""]
    df = spark.createDataFrame([(x,) for x in emails], "e string")
    found = [r.f for r in df.select(V.security_pattern(F.col("e")).alias("f")).collect()]
    assert found == [any(w in x.lower() for w in P.SECURITY_WORDS) for x in emails]


@pytest.mark.parametrize("name", ["framed_candidates", "page_extractors", "page_links"])
def test_a_small_file_is_more_than_one_task(spark, name):
    assert spark.read.parquet(f"{SF}/customer.parquet").rdd.getNumPartitions() == 1
    assert __spark_entry__.queries()[name](spark, SF).rdd.getNumPartitions() >= 4


def test_large_texts_cost_in_proportion(spark):
    """Every plain match was looked for again for each loose one."""
    import time

    def seconds(n: int) -> float:
        text = " ".join(f"user{k}@host{k}.com" for k in range(n))
        began = time.perf_counter()
        assert len(R.text_suite(text)) == 2 * n
        return time.perf_counter() - began

    seconds(10)
    assert seconds(4000) < 12 * seconds(1000)


def test_report(spark, pages):
    """Finds are counted where they are made: one row an extractor and page leaves the pass, not one a find."""
    report = pipeline.extractor_report(pages)
    found = D.extract(D.parse_dom(pages, every_text=False)).distinct().groupBy("page_id", "extractor").count().collect()
    assert {(r.page_id, r.extractor): r.n for r in report.collect() if r.extractor != "source"} == {tuple(r[:2]): r[2] for r in found}
    assert "transform(" not in report._jdf.queryExecution().optimizedPlan().toString()
