"""Word lists from line files: contact keywords, suffixes, disposable domains, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Distinct trimmed lines; blank ones would match everything and are dropped."""
    return spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "").distinct()


def keywords(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """A lexicon small enough for an expression; a longer one is an error, not a cut."""
    found = [r[0] for r in lines(spark, path, "word").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{path} has more than {most} words")
    return sorted(found)


def categories(spark: SparkSession, path: str) -> DataFrame:
    """category, patterns, ord of ``name|word|word`` lines; # comments and blanks skipped, the last of a name counts.

    Files are in the order of their paths; lines in that of their place (one task reads a file that short).
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    rows = rows.withColumns({"ord": F.struct("file", "line"), "value": F.trim("value")})
    parts = F.transform(F.split("value", r"\|"), lambda x: F.lower(F.trim(x)))
    rows = rows.filter((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.get(parts, F.lit(0)).alias("category"), F.filter(F.slice(parts, 2, 10_000), lambda x: x != "").alias("patterns"), "ord")
    return rows.groupBy("category").agg(F.max_by("patterns", "ord").alias("patterns"), F.max("ord").alias("ord"))


def category_dict(frame: DataFrame) -> dict[str, list[str]]:
    return {r["category"]: list(r["patterns"]) for r in frame.orderBy("ord").collect()}
