"""Page text that got stuck to an address, and the key under which addresses are the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterbox.functions import patterns as P

_NAMES = "|".join(P.COMMON_NAMES)
_HOURS = r"^(?:\d{1,2}(?::\d{2})?\s*(?:am|pm|AM|PM)\s*[-–—]\s*\d{1,2}(?::\d{2})?\s*(?:am|pm|AM|PM))([a-zA-Z].*)$"


def one_at(email: Column) -> Column:
    return F.length(email) - F.length(F.replace(email, F.lit("@"), F.lit(""))) == 1


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def domain_part(email: Column) -> Column:
    return F.substring_index(email, "@", -1)


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _swap(email: Column, rest: Column) -> Column:
    """``rest`` in place of the local part where it is long enough to be one."""
    good = one_at(email) & (F.length(rest) >= 2)
    return F.when(good, F.concat(rest, F.lit("@"), domain_part(email))).otherwise(email)


def strip_phone(email: Column) -> Column:
    return _swap(email, F.regexp_extract(local_part(email), r"^(?:\+?[\d\-\s]+?\d)([a-zA-Z].*)$", 1))


def strip_hours(email: Column) -> Column:
    return _swap(email, F.lower(F.regexp_extract(local_part(email), _HOURS, 1)))


def _after_domain(email: Column) -> Column:
    """The common name behind the address's own domain, or part of it, at the start of the local part."""
    low, full = F.lower(local_part(email)), F.regexp_replace(F.lower(domain_part(email)), r"^www\.", "")
    label = F.substring_index(full, ".", 1)
    tails = F.when(F.length(label) > 12, F.filter(F.transform(F.sequence(F.lit(12), F.lit(4), F.lit(-1)), lambda n: F.right(label, n)), lambda t: t.rlike("^[a-z]{4,}$"))).otherwise(F.array().cast("array<string>"))
    heads = F.concat(F.array(full, F.concat(F.lit("www."), full), label), tails)
    words = F.transform(heads, lambda v: F.when(F.startswith(low, v), F.regexp_extract(F.substr(low, F.length(v) + 1), "^([a-z]+)", 1)))
    return F.get(F.filter(words, lambda w: F.coalesce(w.isin(*P.COMMON_NAMES), F.lit(False))), 0)


def strip_domain(email: Column) -> Column:
    return _swap(email, F.coalesce(_after_domain(email), F.lit("")))


def strip_year(email: Column) -> Column:
    return _swap(email, F.regexp_extract(F.lower(local_part(email)), rf"^(?:\d{{4}}(?:-\d{{2,4}})?\.?)({_NAMES})$", 1))


def strip_percent(email: Column, compat: bool = False) -> Column:
    run = "{2,6}" if compat else "{2}"
    return _swap(email, F.regexp_extract(F.lower(local_part(email)), rf"^(?:%[0-9a-f]{run})+([a-z]+)$", 1))


def strip_letter(email: Column, compat: bool = False) -> Column:
    low = F.lower(local_part(email))
    rest = F.regexp_extract(low, rf"^[a-z]({_NAMES})$", 1)
    return _swap(email, rest if compat else F.when(~low.isin(*P.COMMON_NAMES), rest).otherwise(""))


def strip_artifacts(email: Column, compat: bool = False) -> Column:
    """The first of domain, year, percent code and single letter that changes the address."""
    steps = F.array(strip_domain(email), strip_year(email), strip_percent(email, compat), strip_letter(email, compat))
    return F.coalesce(F.get(F.filter(steps, lambda s: s != email), F.lit(0)), email)


def clean(email: Column, compat: bool = False) -> Column:
    """All cleaning steps. Hours go before phone numbers, which would eat their first digits."""
    first, second = (strip_phone, strip_hours) if compat else (strip_hours, strip_phone)
    return let(let(let(email, lambda e: first(e)), lambda e: second(e)), lambda e: strip_artifacts(e, compat))


def dedup_key(email: Column) -> Column:
    """Lower case, trimmed; dots do not count in the local parts of two providers. Tags stay."""

    def key(low: Column) -> Column:
        dotless = F.concat(F.replace(local_part(low), F.lit("."), F.lit("")), F.lit("@"), domain_part(low))
        return F.when(one_at(low) & domain_part(low).isin("gmail.com", "googlemail.com"), dotless).otherwise(low)

    return let(F.lower(F.trim(email)), key)
