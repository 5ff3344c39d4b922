"""Command line: a run over tables, one page explained, or a stream of texts.

    python -m letterbox.cli run settings.json --output out
    python -m letterbox.cli explain settings.json 42
    python -m letterbox.cli stream settings.json --stop out/stop
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterbox.operators.metrics import category_counts, run_report
from letterbox.plans.pipeline import Dims, explain_page, extract, extractor_report, run_sites
from letterbox.sources import config, lexicons, ocr, sinks, tables


def dims_of(spark: SparkSession, conf: config.Config) -> Dims:
    """Tables and word lists that the settings name; the package's own where they name none."""
    lists = {k: tuple(lexicons.keywords(spark, path)) for k, path in (("suffixes", conf.suffixes), ("page_suffixes", conf.page_suffixes), ("keywords", conf.keywords), ("guesses", conf.guesses)) if path}
    return Dims(
        lexicons.lines(spark, conf.disposable, "domain") if conf.disposable else None,
        spark.read.parquet(conf.mx) if conf.mx else None,
        unknown_mx_passes=conf.unknown_mx_passes,
        **lists,
    )


def run(spark: SparkSession, conf: config.Config) -> DataFrame | None:
    """Write addresses, categories, summary, and where domains are given, their outcomes; returns the report."""
    began, pages, dims = time.time(), tables.read_pages(spark, conf.pages), dims_of(spark, conf)
    categories = lexicons.category_dict(lexicons.categories(spark, conf.categories)) if conf.categories else None
    found = extract(pages, dims, categories, conf.compat)
    sinks.write_categorized(found, f"{conf.output}/categorized")
    known = spark.read.parquet(f"{conf.output}/categorized")
    sinks.write_emails(known, f"{conf.output}/emails")
    sinks.write_summary(known, f"{conf.output}/summary")
    if conf.ocr and conf.images:
        sinks.write_emails(ocr.image_emails(tables.read_images(spark, conf.images, conf.image_bytes), seconds=conf.ocr_seconds), f"{conf.output}/image-emails")
    if not conf.domains:
        return None
    sites = run_sites(tables.read_domains(spark, conf.domains), pages, dims, conf.compat)
    sinks.write_outcomes(sites, f"{conf.output}/outcomes")
    return run_report(sites, time.time() - began)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="letterbox", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    actions = parser.add_subparsers(dest="action", required=True)
    for name in ("run", "explain", "stream"):
        one = actions.add_parser(name)
        one.add_argument("settings")
        one.add_argument("--pages")
        one.add_argument("--output")
        one.add_argument("--compat", action="store_true", default=None)
    actions.choices["run"].add_argument("--domains")
    actions.choices["explain"].add_argument("page_id", type=int)
    actions.choices["stream"].add_argument("--stop", help="a file whose appearance ends the stream")
    args = vars(parser.parse_args(argv))
    action, path, page_id, stop = args.pop("action"), args.pop("settings"), args.pop("page_id", None), args.pop("stop", None)
    conf = config.load(path, **args)
    spark = SparkSession.builder.appName("letterbox").getOrCreate()
    if action == "explain":
        pages, dims = tables.read_pages(spark, conf.pages), dims_of(spark, conf)
        one = pages.filter(F.col("page_id") == page_id)
        extractor_report(one, conf.compat).orderBy("extractor").show(100, truncate=False)
        explain_page(pages, page_id, dims, conf.compat).select("email", "raw", "extractors", "reason").show(1000, truncate=False)
    elif action == "stream":
        stream(spark, conf, stop)
    elif (report := run(spark, conf)) is not None:
        report.show(truncate=False)
        category_counts(spark.read.parquet(f"{conf.output}/categorized")).orderBy(F.desc("n")).show(1000)


def stream(spark: SparkSession, conf: config.Config, stop: str | None = None) -> None:
    """Addresses of a folder of page files as they arrive, each written once, until ``stop`` exists."""
    from letterbox.streaming.dedup import start_compaction, stream_emails
    from letterbox.streaming.progress import Progress, run_until_asked

    pages = spark.readStream.schema(spark.read.parquet(conf.pages).schema).option("maxFilesPerTrigger", conf.files_a_batch).parquet(conf.pages)
    spark.streams.addListener(Progress())
    query = start_compaction(stream_emails(pages, "html", conf.compat), f"{conf.output}/emails", f"{conf.output}/checkpoint", conf.compact_seconds).start()
    run_until_asked(query, stop) if stop else query.awaitTermination()


if __name__ == "__main__":
    main()
