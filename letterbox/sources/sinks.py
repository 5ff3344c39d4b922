"""Where results go: distinct addresses, categories, outcomes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_emails(emails: DataFrame, path: str) -> None:
    """Distinct lower-cased addresses, appended."""
    emails.select(F.lower(F.trim("email")).alias("email")).distinct().write.mode("append").parquet(path)


def write_categorized(emails: DataFrame, path: str) -> None:
    emails.select("category", "email").distinct().write.mode("append").partitionBy("category").parquet(path)


def write_outcomes(sites: DataFrame, path: str) -> None:
    sites.select("domain", "outcome").write.mode("append").partitionBy("outcome").parquet(path)


def compact(emails: DataFrame, path: str) -> None:
    """Rewrite an address table without repeats, under another path than it is read from."""
    emails.select(F.lower(F.trim("email")).alias("email")).distinct().write.mode("overwrite").parquet(path)


def write_summary(emails: DataFrame, path: str) -> None:
    """category (null: all), n of distinct addresses; replaces the one before. One row a category, whatever its size."""
    emails.select("category", "email").distinct().rollup("category").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(path)
