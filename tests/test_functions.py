"""Golden vectors of the column functions."""

import pytest
from pyspark.sql import functions as F

from letterbox.functions import clean as C
from letterbox.functions import validate as V
from letterbox.functions.categorize import categorize
from letterbox.functions.ocr_text import fix_ocr, image_text_emails
from letterbox.functions.text import detector_suite, pattern_suite, rot13

CLEAN = [
    ("3801admin@x.org", "admin@x.org"),
    ("+30-210-898-2232info@x.org", "info@x.org"),
    ("351-214-693-329geral@x.org", "geral@x.org"),
    ("9am-5pmteam@x.org", "team@x.org"),
    ("10am-5pmteam@x.org", "team@x.org"),
    ("bikefactory.com.auoffice@bikefactory.com.au", "office@bikefactory.com.au"),
    ("whitiangainfo@physiofirstwhitianga.co.nz", "info@physiofirstwhitianga.co.nz"),
    ("2024info@x.org", "info@x.org"),
    ("2021-23.info@x.org", "info@x.org"),
    ("einfo@x.org", "info@x.org"),
    ("%20info@x.org", "info@x.org"),
    ("email@x.org", "email@x.org"),
    ("%20admin@x.org", "admin@x.org"),
    ("details@x.org", "details@x.org"),
    ("no at sign", "no at sign"),
]


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_clean(spark):
    got = column(spark, [a for a, _ in CLEAN], C.clean)
    assert got == [b for _, b in CLEAN]
    assert column(spark, got, C.clean) == got  # once more changes nothing


def test_clean_as_coded(spark):
    vectors = [("10am-5pmteam@x.org", "am-5pmteam@x.org"), ("email@x.org", "mail@x.org"), ("%20admin@x.org", "min@x.org")]
    assert column(spark, [a for a, _ in vectors], lambda c: C.clean(c, compat=True)) == [b for _, b in vectors]


def test_dedup_key(spark):
    assert column(spark, [" John.Doe+x@Gmail.com ", "a.b@x.org", "a@b@c"], C.dedup_key) == ["johndoe+x@gmail.com", "a.b@x.org", "a@b@c"]


@pytest.mark.parametrize(
    ("text", "email"),
    [
        ("write info@acme.org.", "info@acme.org"),
        ("info [at] acme [dot] org", "info@acme.org"),
        ("info(at)acme(dot)org", "info@acme.org"),
        ("info at acme dot org", "info@acme.org"),
        ("'info' + '@' + 'acme' + '.' + 'org'", "info@acme.org"),
        ("String.fromCharCode(97,64, 98,46,111,114,103)", "a@b.org"),
        ("unescape('info%40acme.org')", "info@acme.org"),
        ("atob('aW5mb0BhY21lLm9yZw==')", "info@acme.org"),
        ("info&#64;acme&#46;org", "info@acme.org"),
        ("info @ acme . org", "info@acme.org"),
        ("xinfo@a.org", "info@a.org"),
    ],
)
def test_patterns(spark, text, email):
    (found,) = column(spark, [text], pattern_suite)
    assert email in [x.raw for x in found]


def test_no_truncated_twins(spark):
    (found,) = column(spark, ["john+tag@x.org info@mail.acme.co.uk"], pattern_suite)
    assert {x.raw for x in found} == {"john+tag@x.org", "info@mail.acme.co.uk"}


def test_detector(spark):
    (found,) = column(spark, ["""data-contact="c@d.org" "contact": "e@f.org" email('g@h.org')"""], detector_suite)
    assert {"c@d.org", "e@f.org", "g@h.org"} <= {x.raw for x in found}
    assert column(spark, ["info@acme.org"], rot13) == ["vasb@npzr.bet"]


def test_nulls_and_empty(spark):
    assert column(spark, [None, ""], pattern_suite) == [[], []]
    assert column(spark, [None], C.clean) == [None]


def test_reasons(spark):
    cases = [
        ("a@b", "Invalid email syntax"), (".a@b.org", "Invalid email syntax"), ("no-reply@b.org", "Security/system email pattern"), ("a@photo.png", "Bad email extension/TLD"),
        ("a..b@c.org", "Failed additional validation checks"), ("a1234567@c.org", "Failed additional validation checks"), ("roma12345@d.it", "Failed additional validation checks"), ("anna@acme.org", None), ("x@acme.com", None),
    ]
    assert column(spark, [a for a, _ in cases], lambda c: V.rejection_reason(c, F.lit(False), F.lit(None).cast("boolean"))) == [b for _, b in cases]
    assert column(spark, ["a@b.org"], lambda c: V.rejection_reason(c, F.lit(True), F.lit(True))) == ["Disposable email domain"]
    assert column(spark, ["a@b.org"], lambda c: V.rejection_reason(c, F.lit(False), F.lit(False)))[0].startswith("No MX")
    assert column(spark, ["x@acme.com"], lambda c: V.bad_suffix(c, compat=True)) == [True]


def test_context(spark):
    rows = spark.createDataFrame([("info@acme.org", "for example info@acme.org"), ("info@acme.org", "an example. " + "x" * 60 + " info@acme.org"), ("a@b.org", "nothing"), ("latest@b.org", "latest@b.org")], "e string, t string")
    assert [r[0] for r in rows.select(V.in_example_context(F.col("e"), F.col("t"))).collect()] == [True, False, False, True]


def test_pages_and_domains(spark):
    assert column(spark, ["cf-ray and Just a Moment", "cf-ray", "", "var s,t,o,p,b,r,e,a,k,i,n,g,f"], V.is_challenge) == [True, False, False, True]
    assert column(spark, ["acme.org", "Acme.org", "acme", "a" * 254 + ".x"], V.valid_domain) == [True, False, False, False]
    assert column(spark, ["/a.pdf", "/contact"], V.bad_contact_url) == [True, False]


def test_categories(spark):
    assert column(spark, ["sales.order@x.org", "zzz@x.org", "helpdesk@x.org"], categorize) == ["sales", "other", "support"]


def test_ocr(spark):
    assert column(spark, ["orogettazione@d.it", "infooo@acme.org"], fix_ocr) == ["progettazione@d.it", "info@acme.org"]
    assert column(spark, ["sales @ acme . org", "sa|es@acme.org"], image_text_emails) == [["sales@acme.org"], ["sales@acme.org"]]
