"""Departments of addresses: the category with the most keywords inside the local part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterbox.functions.clean import local_part

#: fixed values: the built-in categories, used where no category file is given
CATEGORIES = {
    "general": ["info", "contact", "inquiry", "general", "hello", "main", "office", "mail", "email", "reach"],
    "sales": ["sales", "sell", "order", "purchase", "buy", "quote", "pricing", "business", "commercial", "revenue"],
    "support": ["support", "help", "assist", "troubleshoot", "issue", "problem", "service", "customer", "care"],
    "admin": ["admin", "administrator", "management", "manager", "executive", "director", "ceo", "founder", "owner"],
    "marketing": ["marketing", "promotion", "advertise", "newsletter", "subscribe", "pr", "public", "media", "social"],
    "technical": ["tech", "technical", "it", "developer", "dev", "engineer", "sysadmin", "system", "server", "hosting", "webmaster"],
    "finance": ["finance", "financial", "accounting", "accountant", "billing", "invoice", "payment", "payable", "receivable", "bookkeeping"],
    "hr": ["hr", "human", "recruit", "recruitment", "jobs", "career", "hiring", "employment", "personnel", "staff"],
    "legal": ["legal", "law", "attorney", "lawyer", "counsel", "compliance", "regulatory", "contract"],
}
OTHER = "other"


def categories_frame(spark: SparkSession, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """category, patterns, ord (the order of the file, which breaks ties)."""
    rows = [(k, v, i) for i, (k, v) in enumerate((categories or CATEGORIES).items())]
    return spark.createDataFrame(rows, "category string, patterns array<string>, ord int")


def categorize(email: Column, categories: dict[str, list[str]] | None = None) -> Column:
    """Score of a category: entries of its list that the local part contains, each as often as listed."""
    low = F.lower(local_part(email))
    scores = []
    for i, (name, words) in enumerate((categories or CATEGORIES).items()):
        score = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("category")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["category"]).otherwise(OTHER)
