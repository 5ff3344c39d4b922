"""The expressions of ``text``, ``clean`` and ``validate`` that see every candidate, as functions of one text.

Passes that have the text in Python anyway use these: nested lambdas over columns are interpreted, node by node.
Patterns keep Java's meaning (ASCII classes, its line ends); tests hold both forms against each other.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from functools import cache, lru_cache

from letterbox.functions import patterns as P
from letterbox.functions.text import _ROT

_LINE_END = "\\n\\r\\x85\\u2028\\u2029"
#: Java's $ and white space
END = rf"(?=(?:\r\n|[{_LINE_END}])?\Z)"
SPACE = r"[ \t\n\x0b\f\r]"
Find = tuple[str, str]


def _class_of(kind: str, last: int) -> str:
    """The inside of a character class with all characters up to ``last`` whose general category begins so."""
    spans: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@cache
def _compiled(pattern: str, flags: int = 0, last: int = 0xFFFF) -> re.Pattern:
    for kind in "LN" if r"\p{" in pattern else "":
        pattern = pattern.replace(rf"\p{{{kind}}}", _class_of(kind, last))
    pattern = P.steady(pattern)
    if pattern.endswith("$"):
        pattern = f"{pattern[:-1]}{END}"
    return re.compile(pattern, flags | re.ASCII)


def find_all(text: str | None, pattern: str) -> list[str]:
    """All matches of a pattern without groups, or their only group."""
    return _compiled(pattern).findall(text) if text else []


def emails(text: str | None) -> list[str]:
    return _EM.findall(text) if text and "@" in text else []


_EM, _WHOLE = _compiled(P.EM), _compiled(P.WHOLE)


def whole(text: str) -> bool:
    return _WHOLE.search(text) is not None


def _unicode(text: str) -> list[str]:
    """Classes with characters beyond the basic plane are slow; few texts have any."""
    if text.isascii():
        return emails(text)
    return _compiled(P.UNICODE, 0, 0xFFFF if max(text) <= "\uffff" else sys.maxunicode).findall(text)


_BREAKS = str.maketrans("\n\r\t", "   ")


def normalize_text(text: str) -> str:
    return text.translate(_BREAKS).strip(" ")


_NAME = "".join(c for c in map(chr, range(128)) if re.match("[a-zA-Z0-9._%+-]", c))
_USER = "([a-zA-Z0-9._%+-]+)"


def _joined(text: str, pattern: str) -> list[str]:
    """A pattern that begins with a name is looked for by what stands behind the name: few places have that."""
    if not pattern.startswith(_USER):
        return [f"{u}@{d}.{t}" for u, d, t in _compiled(pattern).findall(text)]
    behind, out, end = _compiled(f"(?<={_USER[1:-2]}){pattern[len(_USER) :]}"), [], 0
    while m := behind.search(text, end + 1):
        before = text[end : m.start()]
        out.append(f"{before[len(before.rstrip(_NAME)) :]}@{m[1]}.{m[2]}")
        end = m.end()
    return out


def from_char_codes(codes: str) -> str:
    numbers = [c.strip() for c in codes.split(",")]
    return "".join(chr(int(c) & 255) for c in numbers if c.isdigit() and int(c) < 1 << 31)


_ESCAPED = re.compile(r"(?:%(?:[0-9a-fA-F]{2}|\+[0-9a-fA-F]|-0))+")


def from_percent(text: str) -> str | None:
    """Null where a percent sign begins no code."""
    if "%" in _ESCAPED.sub("", text):
        return None
    return _ESCAPED.sub(lambda m: bytes(abs(int(c, 16)) for c in m[0].split("%")[1:]).decode("utf-8", "replace"), text.replace("+", " "))


_BASE64 = re.compile(r"([A-Za-z0-9+/]*)(={0,2})")


def from_base64(text: str) -> str | None:
    m = _BASE64.fullmatch(re.sub(SPACE, "", text))
    if not m or (len(m[0]) % 4 if m[2] else len(m[1]) % 4 == 1):
        return None
    try:
        return base64.b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode()
    except ValueError:
        return None


def _decoded(text: str, pattern: str, decode) -> list[str]:
    return [x for x in map(decode, find_all(text, pattern)) if x and "@" in x]


_AT, _DOT = _compiled(r"\sat\s", re.I), _compiled(r"\sdot\s", re.I)


def _written_out(text: str) -> list[str]:
    words = _AT.search(text) is not None and _DOT.search(text) is not None
    signs = ["[at]" in text, "{at}" in text, "(at)" in text, "<at>" in text, words, words]
    return [x for sign, p in zip(signs, P.AT_DOT, strict=True) if sign for x in _joined(text, p)]


def _scripts(text: str) -> list[str]:
    out = _joined(text, P.JS_CONCAT[0]) if "@" in text and "+" in text else []
    for sign, pattern, decode in (("fromCharCode", P.CHAR_CODES, from_char_codes), ("unescape", P.UNESCAPE, from_percent), ("atob", P.ATOB, from_base64)):
        if sign in text:
            out += _decoded(text, pattern, decode)
    return out


_SIGN = _compiled(r"@|[\[({<\s]at[\])}>\s]|&#64;|&commat;|&#x40;|fromCharCode|unescape|atob", re.I)


def pattern_suite(text: str, compat: bool = False) -> list[Find]:
    """``text.pattern_suite`` of one text."""
    if not _SIGN.search(text):
        return []
    out: list[Find] = []
    if "@" in text:
        plain, loose = _EM.findall(text), find_all(text, P.EXTENDED)
        if not compat:
            known, joined = set(plain), "\n".join(plain)  # no find has a line break
            loose = [x for x in loose if x not in known and x not in joined]
        out += [("plain", x) for x in plain] + [("extended", x) for x in loose] + [("business", x) for x in find_all(text, P.BUSINESS)]
        out += [(family, x) for family, every in P.CAPTURES.items() for p in every for x in find_all(text, p)]
    out += [("written_out", x) for x in _written_out(text)] + [("script", x) for x in _scripts(text)]
    out += [("entity", x) for sign, p in zip(("&#64;", "&commat;", "&#x40;"), P.ENTITIES, strict=True) if sign in text for x in _joined(text, p)]
    if not compat and "@" in text:
        out += [("spaced", x) for x in _joined(text, P.SPACED[0])]
    return out


def detector_suite(text: str, compat: bool = False) -> list[Find]:
    """``text.detector_suite`` of one text."""
    out: list[Find] = []
    at = "@" in text
    for name, (pattern, groups) in P.DETECTOR.items():
        if not ("${" in text if name == "js_template" else at):
            continue
        found = _compiled(pattern).findall(text)
        if len(groups) > 1:
            found = [a if compat else a or b for a, b in found]
        out += [(name, x) for x in found if x]
    if at:
        out += [("unicode", x) for x in _unicode(text)] + [("base64", x) for x in find_all(text, P.BASE64_USER)]
        if compat:
            out += [("rot13", x.translate(_ROT)) for x in find_all(text, P.ROT13)]
    return out


def text_suite(text: str | None, compat: bool = False) -> list[Find]:
    body = normalize_text(text or "")
    return pattern_suite(body, compat) + detector_suite(body, compat)


_NAMES = frozenset(P.COMMON_NAMES)
_ANY_NAME = "|".join(P.COMMON_NAMES)
_REST = rf"([a-zA-Z][^{_LINE_END}]*)"
_TIME = r"\d{1,2}(?::\d{2})?\s*(?:am|pm|AM|PM)"
_HOURS = re.compile(rf"(?:{_TIME}\s*[-–—]\s*{_TIME}){_REST}{END}", re.ASCII)
_PHONE = re.compile(rf"(?:\+?[\d\-\s]+?\d){_REST}{END}", re.ASCII)
_YEAR = re.compile(rf"(?:\d{{4}}(?:-\d{{2,4}})?\.?)({_ANY_NAME}){END}", re.ASCII)
_PERCENT = {c: re.compile(rf"(?:%[0-9a-f]{run})+([a-z]+){END}") for c, run in ((False, "{2}"), (True, "{2,6}"))}
_LETTER = re.compile(rf"[a-z]({_ANY_NAME}){END}")
_LETTERS, _TAIL = re.compile("[a-z]+"), re.compile(f"[a-z]{{4,}}{END}")


def _first(pattern: re.Pattern, text: str) -> str:
    m = pattern.match(text)
    return m[1] if m else ""


def _after_domain(low: str, domain: str) -> str:
    full = domain.lower().removeprefix("www.")
    label = full.split(".", 1)[0]
    tails = [t for n in range(12, 3, -1) if _TAIL.match(t := label[-n:])] if len(label) > 12 else []
    for v in (full, f"www.{full}", label, *tails):
        if low.startswith(v) and (m := _LETTERS.match(low[len(v) :])) and m[0] in _NAMES:
            return m[0]
    return ""


def clean(email: str, compat: bool = False) -> str:
    """``clean.clean`` of one address."""
    if email.count("@") != 1:
        return email
    local, domain = email.split("@")
    for hours in (False, True) if compat else (True, False):
        rest = _first(_HOURS, local).lower() if hours else _first(_PHONE, local)
        local = rest if len(rest) >= 2 else local
    email, low = f"{local}@{domain}", local.lower()
    letter = "" if not compat and low in _NAMES else _first(_LETTER, low)
    for rest in (_after_domain(low, domain), _first(_YEAR, low), _first(_PERCENT[compat], low), letter):
        if len(rest) >= 2 and rest != local:
            return f"{rest}@{domain}"
    return email


def dedup_key(email: str) -> str:
    low = email.strip(" ").lower()
    local, _, domain = low.rpartition("@")
    return f"{local.replace('.', '')}@{domain}" if domain in ("gmail.com", "googlemail.com") and "@" not in local and "@" in low else low


@lru_cache(1 << 12)
def key_of(raw: str, compat: bool = False) -> str:
    return dedup_key(clean(raw, compat))


_WORDS = [w.encode() for w in P.EXAMPLE_WORDS]


class Context:
    """``validate.in_example_context`` of many addresses with one text, which is prepared once."""

    def __init__(self, text: str | None):
        self.low = None if text is None else text.lower().encode()
        self.words = [w for w in _WORDS if self.low and w in self.low]

    def near_example(self, email: str, reach: int = 100, near: int = 50) -> bool:
        if not self.words:
            return False
        key = email.lower().encode()
        at = self.low.find(key)
        if at < 0:
            return False
        start, end = max(at - reach, 0), at + len(key) + reach
        return any(h >= 0 and abs(h - at) < near for h in (self.low.find(w, start, end) for w in self.words))
