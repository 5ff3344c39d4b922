"""Line dedup over a suffix array of line-id sequences, in DataFrame functions only.

The corpus is the sequence of its lines in order of document and line; a suffix starts at each line and ends
with its document. Suffixes are sorted by prefix doubling: the rank of a suffix by its first 2h lines comes
from the pair of ranks by h lines, its own and that h lines on. Only suffixes whose prefix also starts
elsewhere are carried on; the others have their place. The suffixes of one rank are the LCP interval of depth
h. An interval of any depth m between h and 2h is met by two overlapping ranks, at the start and m - h lines on.

A run of lines is worth deleting from ``words`` words on. So each suffix asks for its interval at the least
depth that has so many words (and, for the last lines of a run, the shortest run that ends with each line for
its own): where the interval has an earlier member, the run is a later copy. Overlapping runs join to the
maximal repeated runs, all lines of which go; the first copy in the corpus stays. Doubling ends with the deepest
interval asked for.

Sorting ranks distinct keys, never occurrences: a line that makes up a third of the corpus is one row there,
and its occurrences get their rank by a join whose hot keys adaptive execution splits. Places are one number
(document, then line), so that first and last copies are sums of the hash aggregate kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import WORD, boxed, cut, drop_cut, running_sums, text_or_empty, unboxed

#: a run of repeated lines is deleted from so many words on
WORDS = 50
#: bits of a place that hold the line; documents have the others
LINE_BITS = 27
_DOC = ["has", "doc", "copy"]


def _identity() -> list[Column]:
    """Documents are told apart and ordered by doc_id, null first, then by a hash of the text."""
    return [F.col("doc_id").isNotNull().cast("int").alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text_or_empty()).alias("copy")]


def _repeated_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranks, numbers): place, rank and w (words) of every line that stands at two places or more; the documents' numbers."""
    known = docs.select(*_identity()).groupBy(*_DOC).agg(F.count("*").alias("n"))
    numbers = cut(running_sums(known.withColumn("one", F.lit(1).cast("long")), _DOC, {"num": "one"}, "order").drop("one"), "numbers")
    lines = docs.select(*_identity(), F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "text"))
    # two hashes of 64 bits with different seeds name a line
    lines = lines.select(*_DOC, "line", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("line"), "text").alias("b"), F.regexp_count("text", F.lit(WORD)).alias("w"))
    if not numbers.filter("n > 1").isEmpty():  # rows that repeat a document
        lines = lines.groupBy(*_DOC, "line").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min("w").alias("w"))
    lines = cut(lines, "lines")
    keys = running_sums(lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), ["a", "b"], {"smaller": "n"}, "keys")
    met = lines.join(keys.select("a", "b", "smaller").hint("merge"), ["a", "b"]).select(*_DOC, "line", "w", (F.col("smaller") + 1).alias("rank"))
    place = (F.shiftleft("num", LINE_BITS) + F.col("line")).alias("place")
    ranks = cut(met.join(numbers.select(*_DOC, "num").hint("merge"), _DOC).select(place, "rank", "w"), "suffixes")
    drop_cut(lines)
    return ranks, numbers


def _document() -> Column:
    return F.shiftright("place", LINE_BITS)


def _windows(lines: DataFrame, words: int) -> DataFrame:
    """place, len: from each line the shortest run of ``words`` words on, and the shortest that ends with each line.

    ``lines`` (place, w) are the repeated ones: a run lies within a stretch of neighbours among them. Running sums
    of words before (x) and behind (y) each line, put in one order, show both by the places around. A run may come
    out twice.
    """
    own = Window.partitionBy(_document()).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    stretch = F.col("place") - F.row_number().over(own)
    upto = F.sum("w").over(own).cast("long")
    x = F.struct((F.col("upto") - F.col("w") + words).alias("v"), F.lit(1).alias("x"), "place")
    y = F.struct(F.col("upto").alias("v"), F.lit(0).alias("x"), "place")
    events = lines.select("place", "w", stretch.alias("stretch"), upto.alias("upto")).select(_document().alias("num"), "stretch", F.explode(F.array(x, y)).alias("e")).select("num", "stretch", "e.*")
    same = Window.partitionBy("num", "stretch")
    down = same.orderBy(F.desc("v"), "x").rowsBetween(Window.unboundedPreceding, 0)
    up = same.orderBy("v", F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.min(F.when(F.col("x") == 0, F.col("place"))).over(down)
    begins = F.max(F.when(F.col("x") == 1, F.col("place"))).over(up)
    found = events.withColumns({"end": ends, "begin": begins})
    first, last = F.when(F.col("x") == 1, F.col("place")).otherwise(F.col("begin")), F.when(F.col("x") == 1, F.col("end")).otherwise(F.col("place"))
    return found.select(first.alias("place"), (last - first + 1).cast("int").alias("len")).filter("place IS NOT NULL AND len IS NOT NULL")


def _repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys that stand at two places or more, with their number and first place."""
    ends = [F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("final")]
    return rows.groupBy(*by).agg(*ends).filter("first < final").drop("final")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """place and rank of the rows whose key repeats: 1 + occurrences of all smaller repeated keys."""
    keys = running_sums(_repeated(rows, by), by, {"smaller": "n"}, "keys")
    return cut(rows.join(keys.select(*by, "smaller"), by).select("place", (F.col("smaller") + 1).alias("rank")), "suffixes")


def _later(runs: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """The ``runs`` (place, len; depth <= len < 2 depth) that are later members of their intervals."""
    start = ranks.select("place", F.col("rank").alias("head"))
    end = ranks.select((F.col("place")).alias("there"), F.col("rank").alias("tail"))
    met = runs.join(start, "place").withColumn("there", F.col("place") + F.col("len") - depth).join(end, "there")
    met = cut(met.select("place", "len", "head", "tail"), "intervals")
    firsts = _repeated(met, ["head", "tail", "len"])
    return met.join(firsts.select("head", "tail", "len", "first"), ["head", "tail", "len"]).filter("place > first").select("place", "len")


def later_runs(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(runs, numbers). ``runs``: place and len of every run of lines that also starts earlier in the corpus.

    ``numbers``: has, doc, copy, num of the documents; a place is num * 2**LINE_BITS + line.
    """
    ranks, numbers = _repeated_lines(docs)
    # a run can only repeat where all of its lines do
    runs = cut(_windows(ranks.select("place", "w"), words), "runs")
    deepest, depth, found = runs.agg(F.max("len")).first()[0] or 0, 1, []
    while depth <= deepest:
        found.append(cut(_later(runs.filter(F.col("len").between(depth, 2 * depth - 1)), ranks, depth), "later"))
        if 2 * depth > deepest:
            break
        here = Window.partitionBy(_document()).orderBy("place").rangeBetween(depth, depth)
        pairs = cut(ranks.withColumn("then", F.max("rank").over(here)).filter(F.col("then").isNotNull()), "pairs")
        before, ranks = ranks, _ranked(pairs, ["rank", "then"])
        drop_cut(before)
        drop_cut(pairs)
        depth *= 2
    drop_cut(ranks)
    out = runs.limit(0)
    for some in found:
        out = out.union(some)
    return out, numbers


def line_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with text less its repeated runs of lines of ``words`` words or more, n_lines, n_removed, longest_run.

    ``n_removed`` counts the lines that went, ``longest_run`` those of the longest run of them. Lines are compared
    exactly, blank ones too. Null texts are one empty line and stay null. Rows that repeat doc_id and text are one
    document to this operator and are treated alike; an empty table gives an empty result. Columns of ``docs``
    named n_lines, n_removed or longest_run are replaced, all others stay as they are.
    """
    runs, numbers = later_runs(docs, words)
    gone = runs.select(_document().alias("num"), F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"), F.col("place").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line"))
    gone = gone.groupBy("num").agg(F.sort_array(F.collect_set(F.col("line") + F.col("k"))).alias("gone"))
    marks = cut(numbers.join(gone, "num").select(*_DOC, "gone"), "marks")
    # marks grow with the input: the plan is the same at every size
    out = docs.select(boxed(docs), text_or_empty().alias("body"), *_identity()).join(marks.hint("merge"), _DOC, "left")
    lines = F.split("body", "\n")
    stay = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    # runs of consecutive numbers: the difference to their rank is constant
    run = F.aggregate("gone", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most")), lambda s, i: _grown(s, i), lambda s: s["most"])
    text = F.when(F.col("gone").isNull(), F.col("row").getField("text")).otherwise(F.array_join(stay, "\n"))
    own = {"n_lines": F.size(lines).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), "longest_run": F.coalesce(run, F.lit(0)).cast("long")}
    return out.select(*unboxed(docs.columns, tuple(own), text=text), *[v.alias(k) for k, v in own.items()])


def _grown(state: Column, line: Column) -> Column:
    n = F.when(line == state["last"] + 1, state["n"] + 1).otherwise(1)
    return F.struct(line.alias("last"), n.alias("n"), F.greatest(state["most"], n).alias("most"))


LINES_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
n AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '{WORD}')) AS w FROM l),
c AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
y AS (SELECT doc_id, upto AS v, min(i) AS i FROM c GROUP BY doc_id, upto),
x AS (SELECT doc_id, upto - w AS v, max(i) AS i FROM c GROUP BY doc_id, upto - w),
r AS (SELECT c.doc_id, c.i AS a, y.i AS b FROM c ASOF JOIN y ON c.doc_id = y.doc_id AND c.upto - c.w + {WORDS} <= y.v
      UNION SELECT c.doc_id, x.i AS a, c.i AS b FROM c ASOF JOIN x ON c.doc_id = x.doc_id AND c.upto - {WORDS} >= x.v),
t AS (SELECT r.doc_id, a, b, row_number() OVER (PARTITION BY array_to_string(ls[a:b], chr(10)) ORDER BY r.doc_id, a) AS k FROM r JOIN d ON r.doc_id = d.doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM t WHERE k > 1),
s AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g) GROUP BY doc_id, p) GROUP BY doc_id),
o AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT o.doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, CAST(coalesce(max(longest), 0) AS BIGINT) AS longest_run,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY o.i), '')) AS text_sha256
FROM o LEFT JOIN s ON o.doc_id = s.doc_id GROUP BY o.doc_id
"""
