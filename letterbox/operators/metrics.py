"""Counts, rates and summaries of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_counts(emails: DataFrame) -> DataFrame:
    """category (null: the total), n."""
    return emails.rollup("category").agg(F.count("*").alias("n"))


def category_listing(emails: DataFrame) -> DataFrame:
    """category, n, emails (sorted, distinct). The list of a category grows with its addresses: write
    ``emails`` partitioned by category instead where they are many."""
    return emails.groupBy("category").agg(F.count_distinct("email").alias("n"), F.array_join(F.sort_array(F.collect_set("email")), "\n").alias("emails"))


def outcomes(sites: DataFrame) -> DataFrame:
    """``sites`` (reached, n_emails) with outcome: success, unresolved or no email."""
    return sites.withColumn("outcome", F.when(~F.col("reached"), "unresolved").when(F.col("n_emails") > 0, "success").otherwise("no email"))


def run_report(sites: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: counters, shares and averages of a run over ``sites`` (outcome, n_emails)."""
    rows = sites.agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("outcome") == "success").alias("success"),
        F.count_if(F.col("outcome") == "unresolved").alias("unresolved"),
        F.count_if(F.col("outcome") == "no email").alias("no_email"),
        F.coalesce(F.sum("n_emails"), F.lit(0)).alias("emails"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(100.0 * F.col(part), F.col(whole)), F.lit(0.0))
    rows = rows.withColumns({"failed": F.col("unresolved") + F.col("no_email"), "success_pct": share("success", "processed"), "emails_per_success": F.coalesce(F.try_divide(F.col("emails").cast("double"), F.col("success")), F.lit(0.0))})
    if seconds is not None:
        rows = rows.withColumn("per_second", F.coalesce(F.try_divide(F.col("processed").cast("double"), F.lit(float(seconds))), F.lit(0.0)))
        rows = rows.withColumn("duration", duration(F.lit(seconds)))
    return rows


def eta(done: Column, total: Column, seconds: Column) -> Column:
    """Seconds left at the pace so far, 0 where there is none yet."""
    return F.coalesce(F.try_divide((total - done) * seconds, done), F.lit(0.0))


def duration(seconds: Column) -> Column:
    """``12s``, ``3m4s``, ``2h5m``."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh%dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def extractor_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("extractor").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def image_priority(url: Column, alt: Column) -> Column:
    url_hit = F.lower(url).rlike("mail|email|contact|@")
    alt_hit = F.lower(F.coalesce(alt, F.lit(""))).rlike("mail|email|contact|@")
    return F.when(url_hit, 10).when(alt_hit, 5).otherwise(0)


def select_images(images: DataFrame, most: int = 20) -> DataFrame:
    """All images with a priority, others while fewer than ``most`` come before (page_id, pos, url, alt)."""
    ranked = images.withColumn("priority", image_priority(F.col("url"), F.col("alt")))
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("priority"), "pos")))
    return ranked.filter((F.col("priority") > 0) | (F.col("rn") <= most))


def provenance(home: DataFrame, contact: DataFrame) -> DataFrame:
    """host, email and where it stands: homepage, contact, or both."""
    both = home.select("host", "email", F.lit(1).alias("h"), F.lit(0).alias("c")).unionByName(contact.select("host", "email", F.lit(0).alias("h"), F.lit(1).alias("c")))
    found = both.groupBy("host", "email").agg(F.max("h").alias("h"), F.max("c").alias("c"))
    return found.select("host", "email", F.when(F.col("h") + F.col("c") == 2, "homepage & contact").when(F.col("h") == 1, "homepage").otherwise("contact").alias("found_on"))
