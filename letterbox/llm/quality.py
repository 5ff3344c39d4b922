"""Line-first cleaning, in DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text that way is rejected. Nothing is shuffled: all lists (lines, words,
8-word windows) live inside a row. The phrases of page furniture are given by language; they count in short
lines only, since a paragraph may speak of a privacy policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterbox.llm._common import WORD, boxed, text_or_empty, unboxed

_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\f\r"
#: fixed values: marks that end a sentence, and quotes and brackets that may stand behind them
ENDS, CLOSERS = ".!?:;…。！？", "'\"”’»)]"
#: fixed values: signs between the entries of a menu, and signs of decoration
BARS, SIGNS = "[|»›·•]", "[#*$%&|<>]"
#: fixed values: phrases of page furniture, lower case, by language
BOILERPLATE = {
    "en": ("lorem ipsum", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "all rights reserved", "licensed under", "enable javascript", "sign up for our newsletter", "share on facebook", "click here to", "skip to content", "back to top", "read more", "add to cart", "leave a comment", "powered by"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "verwendet cookies", "verwendung von cookies", "newsletter abonnieren", "javascript aktivieren", "zum inhalt springen", "nach oben", "weiterlesen", "in den warenkorb"),
    "fr": ("tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "conditions générales", "utilise des cookies", "activer javascript", "inscrivez-vous à notre newsletter", "partager sur facebook", "aller au contenu", "haut de page", "lire la suite"),
    "es": ("todos los derechos reservados", "aviso legal", "política de privacidad", "política de cookies", "términos y condiciones", "condiciones de uso", "utiliza cookies", "suscríbete a nuestro boletín", "compartir en facebook", "saltar al contenido", "volver arriba", "leer más"),
    "it": ("tutti i diritti riservati", "informativa sulla privacy", "termini e condizioni", "utilizza i cookie", "leggi tutto", "torna su"),
    "pt": ("todos os direitos reservados", "política de privacidade", "termos de uso", "utiliza cookies", "leia mais", "voltar ao topo"),
    "nl": ("alle rechten voorbehouden", "privacybeleid", "algemene voorwaarden", "gebruikt cookies", "lees meer", "terug naar boven"),
}
#: longer lines, in characters, are paragraphs: furniture is not looked for
SHORT = 300
#: a document may lose this share of its letters (word characters) and stay
MAX_LOSS = 0.5
#: words of a repeated window
WINDOW = 8


def furniture(phrases: dict[str, tuple[str, ...]] = BOILERPLATE) -> str:
    """One expression for all phrases, each at the beginning of a word."""
    every = "|".join(p.replace(" ", "[ \\t]+") for some in phrases.values() for p in some)
    return rf"(?:^|[ \t(>\"'|])(?:{every})"


def line_fails(line: Column, phrases: dict[str, tuple[str, ...]] = BOILERPLATE) -> Column:
    """Whether a line with words is removed: no end of a sentence, a menu, decorated words, or furniture.

    The dear rules are only asked where a cheap sign of them is in the line.
    """
    bare = F.rtrim(F.rtrim(line, F.lit(_BLANKS)), F.lit(CLOSERS))
    ended = F.right(bare, F.lit(1)).isin(*ENDS)
    menu = F.when(line.rlike(BARS), 3 * F.regexp_count(line, F.lit(BARS)) >= F.regexp_count(line, F.lit(WORD))).otherwise(False)
    signs = F.when(line.rlike(SIGNS), 10 * F.regexp_count(line, F.lit(SIGNS)) > F.length(line)).otherwise(False)
    furnished = F.when(F.length(line) <= SHORT, F.lower(line).rlike(furniture(phrases))).otherwise(False)
    return line.rlike(r"[^\x20\x09-\x0D]") & (~ended | menu | signs | furnished)


def _pairs(hashes: Column, by: int) -> Column:
    """Hashes of each entry and the one ``by`` places on."""
    n = F.size(hashes) - by
    return F.zip_with(F.slice(hashes, 1, F.greatest(n, F.lit(0))), F.slice(hashes, by + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(words: Column) -> Column:
    """A hash for each run of ``WINDOW`` (eight) words: words, then pairs, fours and eights of them."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    two = _let(one, lambda h: _pairs(h, 1))
    four = _let(two, lambda h: _pairs(h, 2))
    return _let(four, lambda h: _pairs(h, 4))


def _repeated_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from the array ``words``: words inside windows that occur at least twice."""
    df = df.withColumn("h", F.when(F.size("words") >= WINDOW, _windows(F.col("words"))).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat nothing: only the others pay for sorting their windows
    placed = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("s")
    twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("h", "s", "p")


_OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_removed")


def _judged(docs: DataFrame, max_loss: float) -> DataFrame:
    """row (all of ``docs``' columns) and the columns in ``_OWN``."""
    df = docs.select(boxed(docs), text_or_empty().alias("t"))
    df = df.withColumns({"words": F.array_remove(F.split("t", _BLANK), ""), "lines": F.split("t", "\n")})
    df = _repeated_words(df)
    df = df.withColumns({"worded": F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), "good": F.filter("lines", lambda x: ~line_fails(x))})
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("t", F.lit(SIGNS)).cast("long"),
        "n_dup_lines": (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long"),
        "n_removed": (F.size("lines") - F.size("good")).cast("long"),
        "clean_text": F.when(F.size("lines") == F.size("good"), F.col("t")).otherwise(F.array_join("good", "\n")),
    }).drop("words", "lines", "worded", "good")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.when(F.col("n_removed") == 0, F.col("word_chars")).otherwise(F.length(F.regexp_replace("clean_text", _BLANK, "")))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (left >= (1 - max_loss) * F.col("word_chars")))


def quality(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with the counts of each text, base_failed, kept, clean_text and n_removed (lines).

    Null texts count as empty: no words, base_failed. Blank lines are never removed. A text without any
    line that fails keeps clean_text equal to itself. Each row is judged alone, so repeated rows agree, and an
    empty table gives none; columns of these names that ``docs`` brings are replaced.
    """
    return _judged(docs, max_loss).select(*unboxed(docs.columns, _OWN), *_OWN)


def quality_filter(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """The kept rows of ``docs`` with cleaned texts; n_chars, where there is one, counts the cleaned text.

    All other columns stay as they are, whatever their names.
    """
    # a filter would be pushed below the counts and compute them anew inside its own condition; an
    # explode of one or no text is not
    kept = _judged(docs, max_loss).select("row", F.explode(F.when(F.col("kept"), F.array("clean_text")).otherwise(F.array().cast("array<string>"))).alias("clean"))
    instead = {"text": F.col("clean")}
    for name in docs.columns:
        if name.lower() == "n_chars":
            instead[name] = F.length("clean").cast(docs.schema[name].dataType)
    return kept.select(*unboxed(docs.columns, **instead))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT rid, unnest(ls) AS line FROM w),
lw AS (SELECT rid, line, length(line) AS n,
       regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
       regexp_matches(line, '[{ENDS}][{_sql(CLOSERS).replace("]", "")}\]]*[\x20\x09-\x0D]*\z') AS ends,
       len(regexp_extract_all(line, '{BARS}')) AS bars,
       len(regexp_extract_all(line, '{SIGNS}')) AS signs,
       len(regexp_extract_all(line, '{WORD}')) AS nw,
       length(line) <= {SHORT} AND regexp_matches(lower(line), '{_sql(furniture())}') AS furniture
       FROM l),
la AS (SELECT rid, count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS dups,
       coalesce(sum(CASE WHEN NOT (worded AND (NOT ends OR (bars > 0 AND bars * 3 >= nw) OR signs * 10 > n OR furniture))
                    THEN length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) END), 0) AS left_chars
       FROM lw GROUP BY rid),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(least(8, nxt - i)) AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 8) AS nxt FROM r) GROUP BY rid),
o AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '{SIGNS}')) AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, left_chars
      FROM w JOIN la USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= {1 - MAX_LOSS} * word_chars AS kept
FROM o
"""
