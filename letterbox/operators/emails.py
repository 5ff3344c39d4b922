"""Candidates to addresses: cleaning, first per key, syntax, context, look-ups and the verdict."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterbox.functions import rows as R
from letterbox.functions.categorize import categorize
from letterbox.functions.clean import clean, dedup_key, domain_part
from letterbox.functions.validate import FILE_SUFFIXES, in_example_context, rejection_reason, well_formed

#: extractors whose finds may be made up from neighbouring text rank behind all others
LAST = ("split siblings",)


def first_per_key(candidates: DataFrame, by: list[str], compat: bool = False) -> DataFrame:
    """One row per (``by``, email): the cleaned key, the raw form it came first from, and all extractors.

    ``candidates``: ``by`` columns, extractor, raw, and where the text is at hand, email and example_context.
    """
    keyed = candidates if "email" in candidates.columns else candidates.withColumn("email", dedup_key(clean(F.col("raw"), compat)))
    order = F.struct(F.col("extractor").isin(*LAST).alias("late"), "extractor", "raw")
    context = [F.max("example_context").alias("example_context")] if "example_context" in candidates.columns else []
    found = keyed.groupBy(*by, "email").agg(F.min(order).alias("f"), F.sort_array(F.collect_set("extractor")).alias("extractors"), *context)
    return found.select(*by, "email", F.col("f.raw").alias("raw"), "extractors", *(["example_context"] if context else []))


#: an address of one text as ``firsts`` gives it
FIRST = "struct<email:string,late:boolean,extractor:string,raw:string,extractors:array<string>,example_context:boolean>"


def firsts(found: Iterable[R.Find], text: str | None, compat: bool = False) -> list[dict]:
    """``in_context`` and ``first_per_key`` of the candidates (extractor, raw) of one text."""
    best: dict[str, tuple[bool, str, str]] = {}
    extractors: dict[str, set[str]] = {}
    for extractor, raw in dict.fromkeys(found):
        email, rank = R.key_of(raw, compat), (extractor in LAST, extractor, raw)
        if email not in best or rank < best[email]:
            best[email] = rank
        extractors.setdefault(email, set()).add(extractor)
    near = R.Context(text).near_example if best else None
    return [{"email": e, "late": b[0], "extractor": b[1], "raw": b[2], "extractors": sorted(extractors[e]), "example_context": near(e)} for e, b in best.items()]


def merge_firsts(rows: DataFrame, by: list[str]) -> DataFrame:
    """What ``first_per_key`` gives, from ``by`` and the fields of FIRST of every text."""
    order = F.struct("late", "extractor", "raw")
    found = rows.groupBy(*by, "email").agg(F.min(order).alias("f"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("extractors")))).alias("extractors"), F.max("example_context").alias("example_context"))
    return found.select(*by, "email", F.col("f.raw").alias("raw"), "extractors", "example_context")


def in_context(rows: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """``rows`` (raw beside the text it comes from) with email and example_context, and without the text."""
    keyed = rows.withColumn("email", dedup_key(clean(F.col("raw"), compat)))
    return keyed.withColumn("example_context", in_example_context(F.col("email"), F.col(text))).drop(text)


def with_context(emails: DataFrame, texts: DataFrame, by: str, text: str) -> DataFrame:
    """``emails`` with example_context, from the text of its page or document, for addresses that lost it.

    Runs join nothing here: they judge the context where the candidates are found (``plans.pipeline``).
    """
    right = texts.select(F.col(by).alias("_by"), F.col(text).alias("_text"))
    joined = emails.join(right, F.col(by) == F.col("_by"), "left")
    return joined.withColumn("example_context", F.coalesce(in_example_context(F.col("email"), F.col("_text")), F.lit(False))).drop("_by", "_text")


def disposable_lookup(emails: DataFrame, disposable: DataFrame) -> DataFrame:
    """``emails`` with ``disposable``: a left join on the domain, so nothing is sent that the plan need not."""
    dim = disposable.select(F.lower("domain").alias("_domain")).distinct().withColumn("disposable", F.lit(True))
    return emails.join(dim, F.lower(domain_part(F.col("email"))) == F.col("_domain"), "left").drop("_domain")


def mx_lookup(emails: DataFrame, mx: DataFrame, now: str | None = None) -> DataFrame:
    """``emails`` with has_mx from a snapshot (domain, has_mx, valid_until); null where it knows nothing."""
    fresh = mx if now is None else mx.filter(F.col("valid_until") > F.lit(now).cast("timestamp"))
    dim = fresh.groupBy(F.lower("domain").alias("_domain")).agg(F.max("has_mx").alias("has_mx"))
    return emails.join(dim, F.lower(domain_part(F.col("email"))) == F.col("_domain"), "left").drop("_domain")


def usable_mx(records: DataFrame) -> DataFrame:
    """domain, has_mx from raw records (domain, host, pref): a named, reachable host makes it true."""
    host = F.regexp_replace("host", r"\.$", "")
    good = (host != "") & (F.octet_length(host) <= 253) & F.col("pref").between(0, 65534) & ~host.rlike(r"^(?:localhost|127\.|0\.)")
    return records.groupBy("domain").agg(F.max(F.coalesce(good, F.lit(False))).alias("has_mx"))


def verdicts(emails: DataFrame, unknown_mx_passes: bool = True, compat: bool = False, suffixes: Sequence[str] = FILE_SUFFIXES) -> DataFrame:
    """``emails`` (email, disposable, has_mx; optionally example_context) with reason, null where accepted."""
    reason = rejection_reason(F.col("email"), F.col("disposable"), F.col("has_mx"), unknown_mx_passes, compat, suffixes)
    reason = F.when(~well_formed(F.col("email")), "Not an address").otherwise(reason)
    if "example_context" in emails.columns:
        reason = F.when(well_formed(F.col("email")) & F.col("example_context"), "Example context").otherwise(reason)
    return emails.withColumn("reason", reason)


def suffix_matches(emails: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rows whose address ends in ``.suffix`` of a table: the join is on every tail, not on all pairs."""
    labels = F.split(F.lower("email"), r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    dim = suffixes.select(F.lower("suffix").alias("_suffix")).distinct()
    return emails.withColumn("_tail", F.explode(tails)).join(dim, F.col("_tail") == F.col("_suffix"), "left_semi").drop("_tail").distinct()


def categorized(emails: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    return emails.withColumn("category", categorize(F.col("email"), categories))


__all__ = ["FILE_SUFFIXES", "categorized", "disposable_lookup", "first_per_key", "firsts", "in_context", "merge_firsts", "mx_lookup", "suffix_matches", "usable_mx", "verdicts", "with_context"]
