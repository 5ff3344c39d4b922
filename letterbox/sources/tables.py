"""Readers of pages, domains and images; bodies as they came over the wire."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from letterbox.functions.validate import bad_suffix, valid_domain


def read_pages(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    """page_id, url, html and whatever else the table has."""
    return spark.read.format(source).load(path)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Distinct valid domains of a text file, one a line; blanks around them go, upper case is invalid."""
    return spark.read.text(path).select(F.trim("value").alias("domain")).filter(valid_domain(F.col("domain"))).distinct()


def stream_domains(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return lines.select(F.trim("value").alias("domain")).filter(valid_domain(F.col("domain")))


def _with_text(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, StringType())])


def inflate(pages: DataFrame, body: str = "body", encoding: str = "content_encoding", into: str = "html") -> DataFrame:
    """Bodies to text: gzip by its magic (a broken one is null), or where the header says so and it works."""
    schema = pages.schema

    def text(raw: bytes | None, how: str | None) -> str | None:
        if raw is None:
            return None
        magic = raw[:2] == b"\x1f\x8b"
        if magic or (how or "").lower() == "gzip":
            try:
                raw = zlib.decompress(raw, 31)
            except zlib.error:
                if magic:
                    return None
        return raw.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text(r, h) for r, h in zip(b.column(body).to_pylist(), b.column(encoding).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, into])

    return pages.mapInArrow(run, _with_text(schema, into))


def host(url: Column) -> Column:
    """Host of a URL or bare domain, without port."""
    full = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.lower(F.parse_url(full, F.lit("HOST")))


def pages_of_domains(domains: DataFrame, pages: DataFrame, compat: bool = False) -> DataFrame:
    """Each domain with its page, https before http; page columns are null for unresolved ones.

    Hosts are reduced to an identifier first; bodies meet only the pages that were chosen.
    """
    if compat:
        domains = domains.filter(~bad_suffix(F.concat(F.lit("https://"), F.col("domain")), compat=True))
    keyed = pages.select(host(F.col("url")).alias("_host"), F.startswith("url", F.lit("https:")).alias("_https"), F.col("page_id").alias("_page"))
    best = keyed.groupBy("_host").agg(F.min(F.when(F.col("_https"), F.col("_page"))).alias("_s"), F.min("_page").alias("_any")).select("_host", F.coalesce("_s", "_any").alias("_page"))
    chosen = domains.join(best, F.col("domain") == F.col("_host"), "left").select("domain", "_page")
    return chosen.join(pages, F.col("_page") == F.col("page_id"), "left").select("domain", F.col("_page").isNotNull().alias("reached"), *pages.columns)


def resolve_urls(links: DataFrame, base: str = "base", url: str = "url", into: str = "resolved") -> DataFrame:
    """RFC 3986 resolution of references; empty where it fails."""
    from urllib.parse import urljoin

    def one(b: str | None, u: str | None) -> str:
        try:
            return urljoin(b or "", u or "")
        except ValueError:
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [one(b, u) for b, u in zip(x.column(base).to_pylist(), x.column(url).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(made, pa.string())], [*x.schema.names, into])

    return links.mapInArrow(run, _with_text(links.schema, into))


def read_images(spark: SparkSession, folder: str, most_bytes: int = 5 << 20) -> DataFrame:
    """path, content of PNG and JPEG files up to a size, by their first bytes."""
    files = spark.read.format("binaryFile").load(folder).filter(F.col("length") <= most_bytes)
    magic = F.hex(F.substring("content", 1, 8))
    return files.filter(F.startswith(magic, F.lit("89504E470D0A1A0A")) | F.startswith(magic, F.lit("FFD8FF"))).select("path", "content")
