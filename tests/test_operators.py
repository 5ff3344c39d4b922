"""DOM extractors, link rules, joins, metrics, sources and streams."""

import gzip
import json
import time

import pytest
from pyspark.sql import functions as F

from letterbox.functions.categorize import categories_frame
from letterbox.operators import dom as D
from letterbox.operators import emails as E
from letterbox.operators import links as L
from letterbox.operators import metrics as M
from letterbox.plans import pipeline
from letterbox.sources import config, lexicons, sinks, tables

HTML = [
    ("mailto", '<a href="mailto:info@acme.org?subject=x#y">m</a>', "info@acme.org"),
    ("data attribute", '<i data-mail="office@acme.org"></i>', "office@acme.org"),
    ("block text", "<p>Contact Details<br>team@acme.org</p>", "team@acme.org"),
    ("attribute", '<b aria-label="write hello@acme.org">x</b>', "hello@acme.org"),
    ("meta", '<meta content="a@acme.org">', "a@acme.org"),
    ("json-ld", '<script type="application/ld+json">{"a":[{"contactPoint":{"email":"hr@acme.org"}}]}</script>', "hr@acme.org"),
    ("comment", "<!-- ops@acme.org --><p>x</p>", "ops@acme.org"),
    ("hidden", '<p style="display: none">staff@acme.org</p>', "staff@acme.org"),
    ("split element", "<div><span>info</span>@<span>acme</span>.<span>org</span></div>", "info@acme.org"),
    ("split siblings", "<div><b>info</b><b>@acme</b><b>.org</b></div>", "info@acme.org"),
    ("named element", '<i class="my-email">n@acme.org</i>', "n@acme.org"),
    ("iframe", '<iframe src="/f?to=i@acme.org"></iframe>', "i@acme.org"),
    ("form control", '<input type="email" placeholder="desk@acme.org">', "desk@acme.org"),
    ("link rel", '<link rel="contact" href="mailto:l@acme.org">', "l@acme.org"),
]
LINKS = [
    ("footer", '<footer><a href="/kontakt">K</a></footer>', "/kontakt"),
    ("nav", '<div class="top menu"><ul><li><a href="/c">Contact</a></ul></div>', "/c"),
    ("breadcrumb", '<p class="breadcrumb"><a href="/contact-x">x</a></p>', "/contact-x"),
    ("anchor", '<a href="/x" title="Contact us">x</a>', "/x"),
    ("meta url", '<meta name="contact-url" content="https://a.org/c">', "https://a.org/c"),
    ("json contact point", '<script type="application/ld+json">{"contactPoint":{"url":"https://a.org/cp"}}</script>', "https://a.org/cp"),
    ("button onclick", "<button onclick=\"go('/contact-go')\">x</button>", "/contact-go"),
    ("button parent", '<a href="/bp"><button>Contact</button></a>', "/bp"),
    ("form action", '<form action="/contact/send"></form>', "/contact/send"),
    ("og url", '<meta property="og:url" content="https://a.org/contact">', "https://a.org/contact"),
    ("canonical", '<link rel="canonical" href="https://a.org/contact">', "https://a.org/contact"),
    ("organization", '<div itemtype="https://schema.org/Organization"><a itemprop="contactPoint" href="/o">x</a></div>', "/o"),
    ("typed item", '<div itemtype="x/ContactPage"><p><a href="/contact-t">x</a></p></div>', "/contact-t"),
]


@pytest.fixture(scope="module")
def dom(spark):
    rows = [(i, "https://a.org/", h) for i, (_, h, _) in enumerate(HTML + LINKS)] + [(900, "u", None), (901, None, "")]
    return D.parse_dom(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_extractors(dom):
    found = {(r.page_id, r.extractor, r.raw) for r in D.extract(dom).collect()}
    for i, (name, _, email) in enumerate(HTML):
        assert (i, name, email) in found, name
    assert not [x for x in found if x[2] == "Detailsteam@acme.org"]


@pytest.mark.parametrize(
    "html",
    ['<a href="tel:info@acme">m</a>', '<i data-mail=""></i>', "<p>look at this dot</p>", '<b lang="x@acme.org">x</b>', "<meta content='no'>", '<script type="text/x">{"a":1}</script>',
     "<!-- at acme -->", '<p style="display: block">x</p>', "<div><span>info</span>@<span></span></div>", "<div><b>a</b><b>@acme</b></div>", '<input type="text" id="q">', '<link rel="icon" href="y">'],
)
def test_extractors_leave_the_rest_alone(spark, html):
    found = D.extract(D.parse_dom(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()
    assert found == []


def test_each_page_is_parsed_once(dom):
    for df in (D.extract(dom), L.link_rules(dom)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= 1 and "Exchange" not in plan


def test_deep_and_odd_pages():
    nodes, _ = D.parse("<div>" * 3000 + "x" * 100 + "</div>" * 3000)
    assert len(nodes) == 3000 and sum(len(n["text"]) for n in nodes) <= 100 * D.DEEPEST
    nodes, _ = D.parse("<p>a<b>b<br>c</b></p>\0")
    assert nodes[0]["lines"] == ["ab", "c"] and (nodes[0]["last"], nodes[1]["last"]) == (2, 2)
    assert D.json_leaves('{"a@b.de": ["x", {"k": "y"}], "n": 1}') == ["x", "y"] and D.json_leaves("{") == [] and D.json_leaves("[" * 100000) == []


def test_link_rules(dom):
    found = {(r.page_id, r.rule, r.url) for r in L.link_rules(dom).collect()}
    for i, (name, _, url) in enumerate(LINKS, len(HTML)):
        assert (i, name, url) in found, name


def test_best_contact(spark):
    bases = spark.createDataFrame([(1, "https://a.org")], "page_id long, base string")
    rules = spark.createDataFrame([(1, "anchor", 5, "/kontakt"), (1, "anchor", 7, "/our-contact"), (1, "anchor", 8, "/contact.pdf")], "page_id long, rule string, node_id int, url string")
    best = lambda **k: L.best_contact(L.contact_candidates(bases, rules), **k).first().url
    assert best() == "https://a.org/contact"
    assert best(prefer_links=True) == "https://a.org/our-contact"
    urls = bases.withColumn("links", F.expr("array(named_struct('node_id', 5, 'url', '/kontakt'), named_struct('node_id', 7, 'url', '/our-contact'), named_struct('node_id', 8, 'url', '/contact.pdf'))"))
    for prefer in (False, True):
        assert urls.select(L.best_url(F.col("base"), F.col("links"), prefer)).first()[0] == best(prefer_links=prefer)


def test_broken_html():
    nodes, _ = D.parse("<p>a<p>b<b>c<br><li>d<li>e</div></p")
    assert [n["tag"] for n in nodes] == ["p", "p", "b", "br", "li", "li"]
    assert all(n["node_id"] <= n["last"] < len(nodes) for n in nodes)
    assert D.parse(None) == ([], [])


def test_lookups(spark):
    e = spark.createDataFrame([("a@Bad.org",), ("b@good.org",), ("c@none.org",)], "email string")
    mx = E.usable_mx(spark.createDataFrame([("good.org", "mx.good.org.", 10), ("none.org", "localhost", 1)], "domain string, host string, pref int"))
    out = pipeline.judge(e, pipeline.Dims(spark.createDataFrame([("bad.org",)], "domain string"), mx))
    assert {r.email: r.reason and r.reason[:4] for r in out.collect()} == {"a@Bad.org": "Disp", "b@good.org": None, "c@none.org": "No M"}
    tails = E.suffix_matches(e.union(spark.createDataFrame([("x@y.de",)], "email string")), spark.createDataFrame([("de",)], "suffix string"))
    assert [r.email for r in tails.collect()] == ["x@y.de"]


def test_run(spark):
    pages = spark.createDataFrame([(1, "https://a.org/", '<p>anna@a-corp.org</p><a href="/contact">c</a>'), (2, "https://a.org/contact", "<p>bob@a-corp.org anna@a-corp.org</p>"), (3, "http://b.org/", "<p>nothing</p>")], "page_id long, url string, html string")
    domains = spark.createDataFrame([("a.org",), ("b.org",), ("c.org",)], "domain string")
    sites = pipeline.run_sites(domains, pages.filter("page_id <> 2").union(pages.filter("page_id = 2")))
    got = {r.domain: (r.outcome, r.n_emails) for r in sites.collect()}
    assert got["b.org"] == ("no email", 0) and got["c.org"] == ("unresolved", 0) and got["a.org"][0] == "success"
    report = M.run_report(sites, 75).first()
    assert (report.processed, report.success, report.failed, report.duration) == (3, 1, 2, "1m15s")
    why = {r.email: r.reason for r in pipeline.explain_page(pages, 1).collect()}
    assert why["anna@a-corp.org"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text(" a.org \n\nB.org\na.org\n")
    assert [r.domain for r in tables.read_domains(spark, str(tmp_path / "d.txt")).collect()] == ["a.org"]
    (tmp_path / "c.txt").write_text("# x\nsales|Buy| sell\n\nsales|deal\n")
    assert lexicons.category_dict(lexicons.categories(spark, str(tmp_path / "c.txt"))) == {"sales": ["deal"]}
    assert categories_frame(spark).count() == 9
    body = spark.createDataFrame([(bytearray(gzip.compress(b"hi")), None), (bytearray(b"\x1f\x8bxx"), None), (bytearray(b"yo"), "gzip"), (None, None)], "body binary, content_encoding string")
    assert [r.html for r in tables.inflate(body).collect()] == ["hi", None, "yo", None]
    refs = spark.createDataFrame([("https://a.org/x/y", "../z")], "base string, url string")
    assert tables.resolve_urls(refs).first().resolved == "https://a.org/z"
    (tmp_path / "c.json").write_text('{"pages": "p"}')
    assert config.load(str(tmp_path / "c.json"), output="o").output == "o"
    for bad in ({"files_a_batch": 0}, {"output": ""}, {"ocr": True, "ocr_seconds": 0}, {"timeout": 301}, {"concurrency": 0}, {"min_delay_between_requests": 2, "max_delay_between_requests": 1}, {"colour": 1}, {"max_retries_per_domain": 11}):
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "c.json"), **bad)
    assert config.load(str(tmp_path / "c.json"), output="x/out.txt", timeout=20).output == "x"
    assert config.output_folder("out.txt") == "output"


def test_run_of_the_command_line(spark, tmp_path):
    from letterbox import cli

    html = '<p>sales@acme-corp.org</p><a href="/wegweiser">zum Formular</a>'
    spark.createDataFrame([(1, "https://a.org/", html), (2, "https://a.org/wegweiser", "<p>bob@acme-corp.xyz9 eva@acme-corp.org</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    for name, text in {"words": "formular\n", "guess": "/none\n", "d": "a.org\n", "suffixes": "xyz\n", "c": "shop|sales\n"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    values = {"pages": "pages", "domains": "d.txt", "keywords": "words.txt", "guesses": "guess.txt", "suffixes": "suffixes.txt", "categories": "c.txt", "output": "out"}
    (tmp_path / "run.json").write_text(json.dumps({k: str(tmp_path / v) for k, v in values.items()}))
    conf = config.load(str(tmp_path / "run.json"))
    report = cli.run(spark, conf).first()
    assert (report.processed, report.success, report.emails) == (1, 1, 2)
    out = spark.read.parquet(f"{conf.output}/categorized")
    assert sorted((r.category, r.email) for r in out.collect()) == [("other", "eva@acme-corp.org"), ("shop", "sales@acme-corp.org")]
    assert {r.category: r.n for r in spark.read.parquet(f"{conf.output}/summary").collect()} == {None: 2, "other": 1, "shop": 1}
    assert [r.outcome for r in spark.read.parquet(f"{conf.output}/outcomes").collect()] == ["success"]


def test_recogniser(spark, tmp_path):
    from letterbox.sources import ocr

    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\ncase \"$*\" in *-l*) echo 'no such lang' >&2; exit 1;; esac\ncat >/dev/null\necho 'Write to Info @ acme . org'\n")
    tool.chmod(0o755)
    images = spark.createDataFrame([("a.png", bytearray(b"\x89PNG\r\n\x1a\n1")), ("b.png", None)], "path string, content binary")
    assert [(r.path, r.email) for r in ocr.image_emails(images, str(tool)).collect()] == [("a.png", "info@acme.org")]
    assert ocr.find_recogniser("no-such-tool", ()) is None and ocr.find_recogniser("no-such-tool", (str(tool),)) == str(tool)
    (tmp_path / "pics").mkdir()
    for name, data in {"a": b"\x89PNG\r\n\x1a\n1", "b": b"\xff\xd8\xff1", "c": b"GIF89a", "d": b"\xff\xd8\xff" + b"0" * 99}.items():
        (tmp_path / "pics" / name).write_bytes(data)
    assert {r.path[-1] for r in tables.read_images(spark, str(tmp_path / "pics"), 50).collect()} == {"a", "b"}


def test_progress(spark, tmp_path):
    from letterbox.streaming import progress
    from letterbox.streaming.dedup import mx_cache

    rows, seen = progress.observed(spark.range(7), "count", even=F.count_if(F.col("id") % 2 == 0))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7, "even": 4}
    answers = spark.createDataFrame([("a.org", True, 5), ("a.org", False, 9), ("b.org", True, 1)], "domain string, has_mx boolean, s int").select("domain", "has_mx", F.timestamp_seconds("s").alias("ts"))
    answers.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(answers.schema).parquet(str(tmp_path / "in"))
    told: list = []
    listener = progress.Progress(told.append)
    spark.streams.addListener(listener)
    query = mx_cache(stream).writeStream.outputMode("update").format("memory").queryName("mx").option("checkpointLocation", str(tmp_path / "ck")).start()
    until = time.time() + 60
    while spark.table("mx").count() < 2 and time.time() < until:  # state that can time out runs batches for ever
        time.sleep(0.2)
    assert not progress.asked_to_stop(spark, str(tmp_path / "stop"))
    (tmp_path / "stop").write_text("")
    progress.run_until_asked(query, str(tmp_path / "stop"), 0.2)
    assert not query.isActive
    got = {r.domain: (r.has_mx, r.h) for r in spark.table("mx").select("domain", "has_mx", ((F.col("valid_until").cast("long")) / 3600).cast("int").alias("h")).collect()}
    assert got == {"a.org": (False, 1), "b.org": (True, 24)}
    spark.streams.removeListener(listener)


def test_streamed_domains_and_other_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a.org\nBAD\n b.org \n")
    query = tables.stream_domains(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("domains").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.domain for r in spark.table("domains").collect()) == ["a.org", "b.org"]
    emails = spark.createDataFrame([("A@b.org ", "x"), ("a@b.org", "x")], "email string, category string")
    sinks.write_categorized(emails, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    sinks.compact(emails, str(tmp_path / "k"))
    assert [r.email for r in spark.read.parquet(str(tmp_path / "k")).collect()] == ["a@b.org"]


def test_sinks_and_streams(spark, tmp_path):
    from letterbox.streaming.dedup import start_compaction, stream_emails

    docs = spark.createDataFrame([(1, "anna@acme.org"), (2, "Anna@acme.org bob@acme.org"), (3, None)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_compaction(stream_emails(stream), str(tmp_path / "out"), str(tmp_path / "check"), 1).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.email for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["anna@acme.org", "bob@acme.org"]
    sinks.write_emails(spark.createDataFrame([("A@b.org",), ("a@b.org",)], "email string"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 1


def test_images(spark):
    rows = [(1, i, f"/{i}.png", None) for i in range(30)] + [(1, 99, "/mail.png", None), (1, 98, "/x.png", "Contact")]
    kept = M.select_images(spark.createDataFrame(rows, "page_id long, pos int, url string, alt string"))
    assert kept.count() == 20 and kept.filter("pos >= 98").count() == 2
    assert M.extractor_counts(spark.createDataFrame([(1, "a"), (1, "a")], "page_id int, extractor string")).first().n == 2
    assert spark.range(1).select(M.eta(F.lit(2), F.lit(4), F.lit(10))).first()[0] == 10


def test_written_out_in_capitals(spark):
    from letterbox.plans.pipeline import judge_texts

    docs = spark.createDataFrame([(1, "write to john AT acme DOT com now"), (2, "nothing here")], "doc_id long, text string")
    assert [(r.doc_id, r.email) for r in judge_texts(docs).select("doc_id", "email").collect()] == [(1, "john@acme.com")]
