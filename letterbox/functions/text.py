"""Address patterns over a text column: plain, written-out, encoded and embedded forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from letterbox.functions import patterns as P
from letterbox.functions.clean import let

_ROT = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM")
_STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(_STRINGS)


def normalize_text(text: Column) -> Column:
    """Line breaks and tabs become blanks, ends are trimmed; runs stay."""
    return F.trim(F.translate(text, "\n\r\t", "   "))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches (or one group of them); an empty array where the text is null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(P.steady(pattern)), F.lit(group)), none())


def _joined(text: Column, pattern: str) -> Column:
    """user@domain.top from the three groups of every match; the text is searched once."""
    return F.transform(find_all(text, pattern), lambda m: F.regexp_replace(m, pattern, "$1@$2.$3"))


def _where(sign: Column, found: Column) -> Column:
    """``found`` where a cheap sign of it is there; regular expressions that cannot match are not run."""
    return F.when(sign, found).otherwise(none())


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def rot13(text: Column) -> Column:
    plain = "".join(chr(c) for c in _ROT)
    return F.translate(text, plain, plain.translate(_ROT))


def from_char_codes(codes: Column) -> Column:
    """The string behind a comma-separated list of character codes."""
    one = F.transform(F.split(codes, ","), lambda c: F.coalesce(F.char(F.expr("1").cast("int") * F.trim(c).try_cast("int")), F.lit("")))
    return F.array_join(one, "")


def from_percent(text: Column) -> Column:
    return F.try_url_decode(text)


def from_base64(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64")).cast("string")


def _decoded(text: Column, pattern: str, decode) -> Column:
    return F.filter(F.transform(find_all(text, pattern, 1), decode), lambda x: F.coalesce(F.contains(x, F.lit("@")), F.lit(False)))


def written_out(text: Column) -> Column:
    words = text.rlike(r"(?i)\sat\s") & text.rlike(r"(?i)\sdot\s")
    signs = [_has(text, "[at]"), _has(text, "{at}"), _has(text, "(at)"), _has(text, "<at>"), words, words]
    return F.concat(*[_where(sign, _joined(text, p)) for sign, p in zip(signs, P.AT_DOT, strict=True)])


def spaced(text: Column) -> Column:
    return _where(_has(text, "@"), _joined(text, P.SPACED[0]))


def entities(text: Column) -> Column:
    return F.concat(*[_where(_has(text, sign), _joined(text, p)) for sign, p in zip(("&#64;", "&commat;", "&#x40;"), P.ENTITIES, strict=True)])


def scripts(text: Column) -> Column:
    """Addresses put together or decoded by page scripts."""
    return F.concat(
        _where(_has(text, "@") & _has(text, "+"), _joined(text, P.JS_CONCAT[0])),
        _where(_has(text, "fromCharCode"), _decoded(text, P.CHAR_CODES, from_char_codes)),
        _where(_has(text, "unescape"), _decoded(text, P.UNESCAPE, from_percent)),
        _where(_has(text, "atob"), _decoded(text, P.ATOB, from_base64)),
    )


def extended(text: Column, compat: bool = False) -> Column:
    """The looser pattern; by default without its truncated twins of plain matches."""
    found = find_all(text, P.EXTENDED)
    if compat:
        return found
    # no find has a line break, so a part of the joined matches is a part of one of them
    return let(F.array_join(find_all(text, P.EM), "\n"), lambda plain: F.filter(found, lambda x: ~F.contains(plain, x)))


def captures(text: Column, family: str) -> Column:
    return F.concat(*[find_all(text, p, 1) for p in P.CAPTURES[family]])


def _tagged(family: str, raws: Column) -> Column:
    return F.transform(raws, lambda x: F.struct(F.lit(family).alias("family"), x.alias("raw")))


def pattern_suite(text: Column, compat: bool = False) -> Column:
    """Array of (family, raw) over all pattern families, in their order.

    Families that put a frame around a plain match (``CAPTURES``) say where the address stood. Texts without
    any sign of an address cost one scan.
    """
    plain = _has(text, "@")
    families = {"plain": find_all(text, P.EM), "extended": extended(text, compat), "business": find_all(text, P.BUSINESS)}
    families |= {k: captures(text, k) for k in P.CAPTURES}
    families = {k: _where(plain, v) for k, v in families.items()}
    families |= {"written_out": written_out(text), "script": scripts(text), "entity": entities(text)}
    if not compat:
        families["spaced"] = spaced(text)
    all_ = F.concat(*[_tagged(k, v) for k, v in families.items()])
    sign = text.rlike(r"(?i)@|[\[({<\s]at[\])}>\s]|&#64;|&commat;|&#x40;|fromCharCode|unescape|atob")
    return F.when(sign, all_).otherwise(F.array().cast("array<struct<family:string,raw:string>>"))


def detector_suite(text: Column, compat: bool = False) -> Column:
    """Array of (family, raw) of the obfuscation detector; the mirror alphabet is off unless ``compat``."""
    parts = []
    for name, (pattern, groups) in P.DETECTOR.items():
        found = find_all(text, pattern, groups[0])
        if len(groups) > 1 and not compat:
            both = F.arrays_zip(found.alias("a"), find_all(text, pattern, groups[1]).alias("b"))
            found = F.transform(both, lambda m: F.coalesce(F.nullif(m["a"], F.lit("")), m["b"]))
        sign = _has(text, "${") if name == "js_template" else _has(text, "@")
        parts.append(_tagged(name, _where(sign, F.filter(found, lambda x: x != ""))))
    parts.append(_tagged("unicode", _where(_has(text, "@"), find_all(text, P.UNICODE))))
    parts.append(_tagged("base64", _where(_has(text, "@"), find_all(text, P.BASE64_USER))))
    if compat:
        parts.append(_tagged("rot13", _where(_has(text, "@"), F.transform(find_all(text, P.ROT13), rot13))))
    return F.concat(*parts)
