"""Addresses in text read from images: what character recognition garbles, and what of it can be undone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterbox.functions.text import find_all

_A, _B, _C = r"[a-zA-Z0-9][a-zA-Z0-9._%+\-]*", r"[a-zA-Z0-9][a-zA-Z0-9.\-]*", "[a-zA-Z]{2,}"
#: fixed values: words seen garbled, and what they were
KNOWN = [("orogettazione", "progettazione"), ("bduuonadonna", "buonadonna"), ("bdunadonna", "buonadonna"), ("bduonadonna", "buonadonna"), ("bduu", "bu")]
#: fixed values: misread letter groups
MISREAD = [(r"oro([a-z]+)@", "pro$1@"), (r"bdu+([a-z]+)@", "bu$1@"), (r"rn([a-z])", "m$1"), (r"cl([a-z])", "d$1"), (r"vv([a-z])", "w$1")]


def _apply(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def clean_ocr(text: Column) -> Column:
    return _apply(text, [(r"\s+", " "), (r"[|]{2,}", ""), (r"\b([a-zA-Z]+)[|]([a-zA-Z]+)\b", "$1l$2"), (r"\b([a-zA-Z]+)0([a-zA-Z]+)\b", "$1O$2")])


def fix_ocr(email: Column) -> Column:
    """Three or more of u o r n a e i d become one; known words and letter groups are put right."""
    email = _apply(email, [(f"{c}{{3,}}", c) for c in "uornaeid"])
    email = reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), KNOWN, email)
    return _apply(email, MISREAD)


def ocr_emails(text: Column) -> Column:
    """Distinct addresses of a recognised text: plain, spaced, with artefacts, and over line breaks."""
    plain = find_all(text, rf"{_A}@{_B}\.{_C}")
    apart = F.transform(find_all(text, rf"{_A}\s+@\s+{_B}\s*\.\s*{_C}"), lambda x: F.regexp_replace(x, r"\s+", ""))
    marked = F.transform(find_all(text, rf"[a-zA-Z0-9][a-zA-Z0-9._%+\-|]*@[a-zA-Z0-9][a-zA-Z0-9.\-|]*\.{_C}"), lambda x: F.translate(x, "|0", "lO"))
    lines = F.transform(find_all(text, rf"{_A}\s*@\s*{_B}\s*\.\s*{_C}"), lambda x: F.regexp_replace(x, r"\s+", ""))
    found = F.transform(F.concat(plain, apart, marked, lines), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^[^a-zA-Z0-9]+|[^a-zA-Z0-9.]+$", ""))
    good = F.filter(F.array_distinct(found), lambda x: (F.length(x) > 5) & (F.length(x) - F.length(F.replace(x, F.lit("@"), F.lit(""))) == 1))
    return F.array_distinct(F.transform(good, fix_ocr))


def image_text_emails(text: Column) -> Column:
    """From the cleaned text, or where that has none, from the text as it was read."""
    cleaned = ocr_emails(clean_ocr(text))
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(ocr_emails(text))
