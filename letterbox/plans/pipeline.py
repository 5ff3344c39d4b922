"""Whole runs: pages to verdicts, a page explained, domains to outcomes and a report."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from letterbox.functions import patterns as P
from letterbox.functions import rows as R
from letterbox.functions.validate import CONTACT_SUFFIXES, FILE_SUFFIXES
from letterbox.operators import dom as D
from letterbox.operators import links as L
from letterbox.operators.emails import FIRST, categorized, disposable_lookup, first_per_key, firsts, merge_firsts, mx_lookup, verdicts
from letterbox.operators.metrics import outcomes
from letterbox.sources.tables import pages_of_domains


@dataclass(frozen=True)
class Dims:
    """Look-up tables and word lists of a run; None or empty where it has none of its own."""

    disposable: DataFrame | None = None
    mx: DataFrame | None = None
    suffixes: tuple[str, ...] = tuple(FILE_SUFFIXES)
    keywords: tuple[str, ...] = L.KEYWORDS
    guesses: tuple[str, ...] | None = None
    page_suffixes: tuple[str, ...] = tuple(CONTACT_SUFFIXES)
    unknown_mx_passes: bool = True


def judge(emails: DataFrame, dims: Dims = Dims(), compat: bool = False) -> DataFrame:
    """Look-ups and verdicts; without a table its step rejects nothing."""
    emails = disposable_lookup(emails, dims.disposable) if dims.disposable is not None else emails.withColumn("disposable", F.lit(False))
    emails = mx_lookup(emails, dims.mx) if dims.mx is not None else emails.withColumn("has_mx", F.lit(None).cast("boolean"))
    return verdicts(emails, dims.unknown_mx_passes, compat, dims.suffixes)


#: a text without any of these has no form of an address
HINT = r"(?i)@|[\[({<\s]at[\])}>\s]|&#|&commat;|fromCharCode|unescape|atob|email"


def _of_texts(docs: DataFrame, by: str, text: str, kind: str, run: Callable[[str], list[dict]]) -> DataFrame:
    """``by`` and the fields of ``kind``, a row for each that ``run`` makes of a text with a hint of an address."""
    hinted = docs.filter(F.col(text).rlike(HINT)).select(F.col(by).alias(by), F.col(text).cast("string").alias("_body"))
    schema = StructType([hinted.schema[by], StructField("c", _parse_datatype_string(f"array<{kind}>"))])
    made = to_arrow_type(schema["c"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([run(x) for x in part.column(1).to_pylist()], made)], [by, "c"])

    return hinted.mapInArrow(each, schema).select(by, F.explode("c").alias("c")).select(by, "c.*")


def text_candidates(docs: DataFrame, by: str = "doc_id", text: str = "text", compat: bool = False) -> DataFrame:
    """``by``, extractor, raw of every pattern over a text column."""
    return _of_texts(docs, by, text, "struct<extractor:string,raw:string>", lambda x: [{"extractor": k, "raw": raw} for k, raw in R.text_suite(x, compat)])


def judge_texts(docs: DataFrame, by: str = "doc_id", text: str = "text", dims: Dims = Dims(), compat: bool = False) -> DataFrame:
    """Every candidate address of ``docs`` with its reason; null where it is accepted.

    The context of a candidate is judged beside its text, so texts are neither shuffled nor joined back.
    """
    found = _of_texts(docs, by, text, FIRST, lambda x: firsts(R.text_suite(x, compat), x, compat))
    return judge(merge_firsts(found, [by]), dims, compat)


def judge_pages(pages: DataFrame, dims: Dims = Dims(), compat: bool = False) -> DataFrame:
    """The same over HTML, through all DOM extractors; one parse of each page."""

    def run(nodes: list[dict], comments: list[str], html: str | None, url: str | None) -> dict:
        return {"c": firsts(D.page_finds(nodes, comments, compat), html, compat)}

    found = D.read_pages(pages, {"c": f"array<{FIRST}>"}, run, every_text=compat)
    return judge(merge_firsts(found.select("page_id", F.explode("c").alias("c")).select("page_id", "c.*"), ["page_id"]), dims, compat)


def extract(pages: DataFrame, dims: Dims = Dims(), categories: dict | None = None, compat: bool = False) -> DataFrame:
    """page_id, email, raw, extractors, category of the accepted addresses."""
    good = judge_pages(pages, dims, compat).filter(F.col("reason").isNull())
    return categorized(good.select("page_id", "email", "raw", "extractors"), categories)


def explain_page(pages: DataFrame, page_id: int, dims: Dims = Dims(), compat: bool = False) -> DataFrame:
    """All candidates of one page, rejected ones too, with extractors and reason."""
    return judge_pages(pages.filter(F.col("page_id") == page_id), dims, compat)


def extractor_report(pages: DataFrame, compat: bool = False) -> DataFrame:
    """page_id, extractor, n (distinct finds), and under "source" the mailto addresses only the HTML source shows."""

    def run(nodes: list[dict], comments: list[str], html: str | None, url: str | None) -> dict:
        found = set(D.page_finds(nodes, comments, compat))
        missed = {("source", x) for x in R.find_all(html, rf"(?i)mailto:({P.EM})") if ("mailto", x) not in found}
        return {"c": list(Counter(k for k, _ in found | missed).items())}

    counts = D.read_pages(pages, {"c": "map<string,long>"}, run, every_text=compat)
    each = counts.select("page_id", F.explode("c").alias("extractor", "n"))
    return each.groupBy("page_id", "extractor").agg(F.sum("n").alias("n"))


def _contact_url(dims: Dims, prefer_links: bool) -> Column:
    """Over the columns of ``links.best_link_columns``."""
    links = F.transform(L.read_links(), lambda x: F.struct(x["node_id"].alias("node_id"), x["url"].alias("url")))
    return L.best_url(L.base_of(F.col("url")), links, prefer_links, dims.guesses, dims.page_suffixes)


def contact_pages(pages: DataFrame, prefer_links: bool = False, dims: Dims = Dims()) -> DataFrame:
    """page_id and the URL chosen as its site's contact page; nothing is shuffled."""
    keywords, suffixes = dims.keywords, dims.page_suffixes
    read = D.read_pages(pages, L.LINK_COLUMNS, lambda nodes, comments, html, url: L.best_link_columns(nodes, url, keywords, suffixes))
    # a filter on the URL would be pushed below it and choose it twice; an explode is not
    return read.select("page_id", F.explode(F.array_compact(F.array(_contact_url(dims, prefer_links)))).alias("url"))


#: the candidates of a page with their addresses and contexts
_JUDGED = "array<struct<extractor:string,raw:string,email:string,example_context:boolean>>"


def _in_context(nodes: list[dict], comments: list[str], html: str | None, compat: bool) -> list[dict]:
    near = R.Context(html).near_example
    return [{"extractor": k, "raw": x, "email": (e := R.key_of(x, compat)), "example_context": near(e)} for k, x in D.page_finds(nodes, comments, compat)]


def _once(df: DataFrame) -> DataFrame:
    """Rows that several branches read: to the shared folder where spark.checkpoint.dir names one, else kept."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def run_sites(domains: DataFrame, pages: DataFrame, dims: Dims = Dims(), compat: bool = False) -> DataFrame:
    """domain, outcome, n_emails: homepage and contact page of every domain, addresses counted once a domain.

    Homepages are parsed once, for candidates and contact page together; what is kept of them is narrow.
    """
    sites = _once(pages_of_domains(domains, pages.select("page_id", "url"), compat).select("domain", "reached", "page_id"))
    home = sites.filter("reached").select(F.col("page_id").alias("_home"), "domain").join(pages.select("page_id", "url", "html"), F.col("_home") == F.col("page_id"))
    keywords, suffixes = dims.keywords, dims.page_suffixes

    def both_of(nodes: list[dict], comments: list[str], html: str | None, url: str | None) -> dict:
        return {"c": _in_context(nodes, comments, html, compat)} | L.best_link_columns(nodes, url, keywords, suffixes)

    read = D.read_pages(home.select("page_id", "url", "html").dropDuplicates(["page_id"]), {"c": _JUDGED} | L.LINK_COLUMNS, both_of, every_text=compat)
    first = read.select("page_id", "c", _contact_url(dims, prefer_links=not compat).alias("contact_url"))
    first = _once(first.select("page_id", "contact_url", F.explode_outer("c").alias("c")).select("page_id", "contact_url", "c.*"))
    chosen = first.select("page_id", "contact_url").distinct().filter(F.col("contact_url").isNotNull())
    second = pages.select(F.col("page_id").alias("contact_id"), F.col("url").alias("_url"), "html").join(chosen.select("contact_url").distinct(), F.col("_url") == F.col("contact_url"), "left_semi")
    second = second.select(F.col("contact_id").alias("page_id"), F.col("_url").alias("url"), "html")
    found = D.read_pages(second, {"c": _JUDGED}, lambda nodes, comments, html, url: {"c": _in_context(nodes, comments, html, compat)}, every_text=compat)
    found = found.select("page_id", "url", F.explode("c").alias("c")).select("page_id", "url", "c.*")
    found = found.join(chosen.select(F.col("page_id").alias("_home"), "contact_url"), F.col("url") == F.col("contact_url"))
    columns = [F.col("extractor"), F.col("raw"), F.col("email"), F.col("example_context")]
    both = first.filter(F.col("raw").isNotNull()).select(F.col("page_id").alias("_home"), *columns).unionByName(found.select("_home", *columns))
    owned = both.join(sites.select("domain", F.col("page_id").alias("_page")), F.col("_home") == F.col("_page")).drop("_home", "_page")
    good = judge(first_per_key(owned, ["domain"], compat), dims, compat).filter(F.col("reason").isNull())
    counted = good.groupBy("domain").agg(F.count("*").alias("n_emails"))
    return outcomes(sites.select("domain", "reached").join(counted, "domain", "left").withColumn("n_emails", F.coalesce("n_emails", F.lit(0))))
