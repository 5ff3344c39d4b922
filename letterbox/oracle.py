"""SQL text of the pattern suites, of cleaning and of verdicts, for engines with RE2 expressions.

The queries of the catalog are held against these on the same tables. Values (patterns, word lists) are shared
with the package; how they are applied is written down a second time here.
"""

from __future__ import annotations

from collections.abc import Sequence

from letterbox.functions import patterns as P
from letterbox.functions import validate as V
from letterbox.functions.categorize import CATEGORIES


def quote(pattern: str) -> str:
    return pattern.replace("'", "''")


def _all(t: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({t}, '{quote(pattern)}', {group})"


def _concat(parts: Sequence[str]) -> str:
    out = parts[0]
    for x in parts[1:]:
        out = f"list_concat({out}, {x})"
    return out


def _joined(t: str, pattern: str) -> str:
    return f"list_transform({_all(t, pattern)}, lambda m: regexp_replace(m, '{quote(pattern)}', '\\1@\\2.\\3'))"


def _decoded(t: str, pattern: str, made: str) -> str:
    return f"list_filter(list_transform({_all(t, pattern, 1)}, lambda x: {made}), lambda y: coalesce(contains(y, '@'), false))"


def normalized(text: str) -> str:
    return f"trim(translate({text}, chr(10) || chr(13) || chr(9), '   '))"


def pattern_families(t: str) -> dict[str, str]:
    """Family -> list of raw finds in the normalised text ``t``."""
    plain = _all(t, P.EM)
    codes = "array_to_string(list_transform(string_split(x, ','), lambda c: coalesce(chr(try_cast(trim(c) AS INT)), '')), '')"
    return {
        "plain": plain,
        "extended": f"list_filter({_all(t, P.EXTENDED)}, lambda x: NOT coalesce(list_bool_or(list_transform({plain}, lambda p: contains(p, x))), false))",
        "business": _all(t, P.BUSINESS),
        **{k: _concat([_all(t, p, 1) for p in v]) for k, v in P.CAPTURES.items()},
        "written_out": _concat([_joined(t, p) for p in P.AT_DOT]),
        "script": _concat([_joined(t, P.JS_CONCAT[0]), _decoded(t, P.CHAR_CODES, codes), _decoded(t, P.UNESCAPE, "url_decode(replace(x, '+', ' '))"), _decoded(t, P.ATOB, "try(decode(from_base64(x)))")]),
        "entity": _concat([_joined(t, p) for p in P.ENTITIES]),
        "spaced": _joined(t, P.SPACED[0]),
    }


def detector_families(t: str) -> dict[str, str]:
    out = {}
    for name, (pattern, groups) in P.DETECTOR.items():
        found = _all(t, pattern, groups[0])
        if len(groups) > 1:
            found = f"list_transform(list_zip({found}, {_all(t, pattern, groups[1])}), lambda z: coalesce(nullif(z[1], ''), z[2]))"
        out[name] = f"list_filter({found}, lambda x: x <> '')"
    return out | {"unicode": _all(t, P.UNICODE), "base64": _all(t, P.BASE64_USER)}


def finds(source: str, by: str, t: str) -> str:
    """SELECT of ``by``, extractor, raw over a source with the normalised text column ``t``."""
    both = pattern_families(t) | detector_families(t)
    return " UNION ALL ".join(f"SELECT {by}, '{name}' AS extractor, unnest({found}) AS raw FROM {source}" for name, found in both.items())


def raws(families: dict[str, str]) -> str:
    return _concat(list(families.values()))


def _one_at(e: str) -> str:
    return f"length({e}) - length(replace({e}, '@', '')) = 1"


def _swap(e: str, rest: str) -> str:
    return f"CASE WHEN {_one_at(e)} AND length({rest}) >= 2 THEN {rest} || '@' || split_part({e}, '@', 2) ELSE {e} END"


_NAMES = "|".join(P.COMMON_NAMES)
_LISTED = "('" + "','".join(P.COMMON_NAMES) + "')"
_TIME = r"\d{1,2}(?::\d{2})?\s*(?:am|pm|AM|PM)"


def cleaned(e: str, step: str) -> str:
    """An address ``e`` after one cleaning step."""
    local = f"split_part({e}, '@', 1)"
    low = f"lower({local})"
    if step == "hours":
        return _swap(e, f"lower(regexp_extract({local}, '^(?:{_TIME}\\s*[-–—]\\s*{_TIME})([a-zA-Z].*)$', 1))")
    if step == "phone":
        return _swap(e, f"regexp_extract({local}, '^(?:\\+?[\\d\\-\\s]+?\\d)([a-zA-Z].*)$', 1)")
    if step == "year":
        return _swap(e, f"regexp_extract({low}, '^(?:\\d{{4}}(?:-\\d{{2,4}})?\\.?)({_NAMES})$', 1)")
    if step == "percent":
        return _swap(e, f"regexp_extract({low}, '^(?:%[0-9a-f]{{2}})+([a-z]+)$', 1)")
    if step == "letter":
        return _swap(e, f"CASE WHEN {low} IN {_LISTED} THEN '' ELSE regexp_extract({low}, '^[a-z]({_NAMES})$', 1) END")
    full = f"regexp_replace(lower(split_part({e}, '@', 2)), '^www\\.', '')"
    label = f"split_part({full}, '.', 1)"
    tails = f"CASE WHEN length({label}) > 12 THEN list_filter(list_transform([12,11,10,9,8,7,6,5,4], lambda n: right({label}, n)), lambda t: regexp_matches(t, '^[a-z]{{4,}}$')) ELSE [] END"
    heads = f"list_concat([{full}, 'www.' || {full}, {label}], {tails})"
    words = f"list_transform({heads}, lambda v: CASE WHEN starts_with({low}, v) THEN regexp_extract(substr({low}, length(v) + 1), '^([a-z]+)', 1) END)"
    return _swap(e, f"coalesce(list_filter({words}, lambda w: w IN {_LISTED})[1], '')")


_TLD = "regexp_extract(email, '([^.]*)$', 1)"
_LOCAL, _DOMAIN = "split_part(email, '@', 1)", "split_part(email, '@', 2)"
_SYNTAX = f"regexp_matches(email, '{quote(P.SYNTAX)}') AND contains({_DOMAIN}, '.') AND NOT regexp_matches({_LOCAL}, '^\\.|\\.$') AND NOT regexp_matches({_DOMAIN}, '^-|-$')"
SUFFIX = f"lower({_TLD}) IN ({','.join(repr(x) for x in V.FILE_SUFFIXES if x not in P.REAL_TLDS)})"
_MORE = (
    f"strlen({_LOCAL}) NOT BETWEEN 1 AND 64 OR strlen({_DOMAIN}) NOT BETWEEN 3 AND 253 OR contains(email, '..') OR regexp_matches({_LOCAL}, '^\\.|\\.$') OR regexp_matches({_DOMAIN}, '^-|-$')"
    f" OR regexp_matches({_LOCAL}, '{quote(P.FORBIDDEN)}') OR regexp_matches({_LOCAL}, '\\d{{6,}}') OR regexp_matches({_LOCAL}, '^\\d{{3,6}}[a-zA-Z]|^\\+?[\\d\\-\\s]+?\\d[a-zA-Z]')"
    f" OR (regexp_matches({_LOCAL}, '^(?:{'|'.join(P.CITIES)})') AND regexp_matches({_LOCAL}, '\\d{{4,}}')) OR NOT regexp_matches({_TLD}, '^[a-zA-Z]{{2,63}}$') OR regexp_matches(email, '{quote(V.any_of(P.TEST_ADDRESSES))}')"
)


def reason(disposable: str = "false", has_mx: str = "true") -> str:
    """The label of the first step that rejects ``email`` (lower case), else accepted."""
    return (
        f"CASE WHEN NOT ({_SYNTAX}) THEN '{P.REASONS['syntax']}' WHEN regexp_matches(email, '{quote(V.any_of(P.SECURITY_WORDS))}') THEN '{P.REASONS['security']}' WHEN {disposable} THEN '{P.REASONS['disposable']}'"
        f" WHEN {SUFFIX} THEN '{P.REASONS['suffix']}' WHEN NOT coalesce({has_mx}, true) THEN '{quote(P.REASONS['mx'])}' WHEN {_MORE} THEN '{P.REASONS['additional']}' ELSE 'accepted' END"
    )


def key(e: str) -> str:
    low = f"lower(trim({e}))"
    local, domain = f"split_part({low}, '@', 1)", f"split_part({low}, '@', 2)"
    return f"CASE WHEN {_one_at(low)} AND {domain} IN ('gmail.com', 'googlemail.com') THEN replace({local}, '.', '') || '@' || {domain} ELSE {low} END"


def category(email: str) -> str:
    """The category with most words in the local part, the first of equals; other where none has any."""
    low = f"lower(split_part({email}, '@', 1))"
    score = {k: "(" + " + ".join(f"CAST(contains({low}, '{w}') AS INT)" for w in v) + ")" for k, v in CATEGORIES.items()}
    best = f"greatest({', '.join(score.values())})"
    return f"CASE WHEN {best} = 0 THEN 'other' " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in score.items()) + " END"


def _bytes(text: str) -> str:
    """The text with every character as long as its UTF-8 form, so that places are places of bytes."""
    for span, n in (("\\x{80}-\\x{7FF}", 2), ("\\x{800}-\\x{FFFF}", 3), ("\\x{10000}-\\x{10FFFF}", 4)):
        text = f"regexp_replace({text}, '[{span}]', repeat(chr(1), {n}), 'g')"
    return text


def example(low: str, email: str) -> str:
    """Whether a word of examples is near the first place of ``email``; both as ``_bytes`` gives them."""
    at = f"strpos({low}, {email})"
    start = f"greatest({at} - 101, 0)"
    window = f"substr({low}, CAST({start} + 1 AS BIGINT), CAST({at} - 1 - {start} + strlen({email}) + 100 AS BIGINT))"
    words = "[" + ",".join(f"'{w}'" for w in P.EXAMPLE_WORDS) + "]"
    return f"{at} > 0 AND list_bool_or(list_transform({words}, lambda k: strpos({window}, k) > 0 AND abs(strpos({window}, k) - {at} + {start}) < 50))"


def judged(candidates: str, texts: str, by: str) -> str:
    """CTEs ending in ``judged`` (by, email, raw, extractors, verdict).

    ``candidates``: SELECT of by, extractor, raw. ``texts``: SELECT of by, body.
    """
    steps = ", ".join(f"{cleaned('e2', s)} AS e_{s}" for s in ("domain", "year", "percent", "letter"))
    first = "CASE " + " ".join(f"WHEN e_{s} <> e2 THEN e_{s}" for s in ("domain", "year", "percent", "letter")) + " ELSE e2 END"
    return f"""cand AS ({candidates}),
k1 AS (SELECT *, {cleaned('raw', 'hours')} AS e1 FROM cand),
k2 AS (SELECT *, {cleaned('e1', 'phone')} AS e2 FROM k1),
k3 AS (SELECT *, {steps} FROM k2),
k4 AS (SELECT {by}, extractor, raw, {key('(' + first + ')')} AS email FROM k3),
firsts AS (SELECT {by}, email, arg_min(raw, (CASE WHEN extractor = 'split siblings' THEN 1 ELSE 0 END, extractor, raw)) AS raw, string_agg(DISTINCT extractor, ',' ORDER BY extractor) AS extractors FROM k4 GROUP BY {by}, email),
bodies AS (SELECT {by}, {_bytes('lower(body)')} AS low FROM ({texts}) AS b0),
near AS (SELECT f.*, {example('b.low', _bytes('f.email'))} AS example FROM firsts f JOIN bodies b USING ({by})),
judged AS (SELECT {by}, email, raw, extractors, CASE WHEN NOT (regexp_matches(email, '{quote(P.WHOLE)}') AND NOT regexp_matches(email, '[^\\x00-\\x7F]')) THEN 'Not an address' WHEN example THEN 'Example context' ELSE {reason()} END AS verdict FROM near)"""
