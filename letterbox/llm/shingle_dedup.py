"""Near dedup on word shingles: SimHash groups, checked on the shingles, then an exact join for all other pairs.

SimHash groups of the same shingles (multi-index hashing, ``simhash_dedup``) come first: each text is held against
the central one of its group. But texts at the threshold mostly differ in more bits than can be looked up, so an
exact similarity join by prefixes goes on from these links and leaves none out.

The shingles of a text, as a set, are put in one order that all texts share. Two sets whose Jaccard similarity
reaches the threshold t must share a shingle among the first n - ceil(t n) + 1 of each, so only these are filed;
sizes, and the place of the first shingle they share, rule out more pairs, and the rest is held against the
complete sets. Any common order is right: shingles that a sample shows often come last, the others by hash.

Components are asked for, not pairs. Every text is held against the smallest of each of its buckets, then
in some turns, against a member of the largest component of each bucket it is not linked to there, the central one
and others by turns: so a large group of copies comes together in a number of pairs in proportion to its size. What
is left to compare are the pairs of a bucket not linked yet, formed from the texts outside its largest component.

In crowded buckets these would be too many, as a group of copies has about as many outliers as it is large. There
each text is put as its difference from one pivot, the shingles that only one of both has. Differences of differences
are those of the texts, so a pair at the threshold of which one is not linked to the pivot must share a good part of
the differences, beginning in a prefix of these; what all have from the pivot cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import boxed, cut, drop_cut, lean, slices, text_or_empty, unboxed
from letterbox.llm._fingerprint import shingle_hashes
from letterbox.llm.components import components
from letterbox.llm.simhash_dedup import simhash_groups

#: one text in SAMPLE tells which shingles are common: those in OFTEN of its texts or more
SAMPLE, OFTEN = 64, 3
#: turns in which texts are held against one member of a component, before all pairs that are left
TURNS = 4
#: texts in a bucket from which on their differences from a pivot are compared
CROWD = 256
#: bits in which fingerprints of one group's neighbours differ at most
BITS = 4


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted set of shingle hashes of a text, as signed longs."""
    found = [x.view(np.int64) for x in shingle_hashes(text, words)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _in_order(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    if not len(common):
        return found
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, rank[at], 0)))]


def prefix(found: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles, those in ``common`` (sorted) last and by ``rank``."""
    if not len(found):
        return np.zeros(1, np.int64)  # texts without a word are alike
    found = _in_order(found, common, rank)
    return found[: len(found) + (-percent * len(found)) // 100 + 1]


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), words))], ["token"])

    sample = texts.filter(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(lean(run), "token long")
    often = sorted((r.token, r.n) for r in sample.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).collect())
    return np.array([t for t, _ in often], np.int64), np.array([n for _, n in often], np.int64)


def _postings(texts: DataFrame, words: int, percent: int, common: np.ndarray, rank: np.ndarray) -> DataFrame:
    """token, node, n, pos: the prefix of every text, its size and the place in the common order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for node, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(x.as_py(), words)
                first = prefix(found, percent, common, rank)
                cols = [first, np.full(len(first), node), np.full(len(first), len(found), np.int32), np.arange(len(first), dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "node", "n", "pos"])

    return texts.mapInArrow(lean(run), "token long, node long, n int, pos int")


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set's members in 2^k places, at least two for each member; halves can be folded together."""
    width = max(6, int(2 * len(found)).bit_length())
    counts = np.bincount((found & ((1 << width) - 1)), minlength=1 << width)
    return np.packbits((counts & 1).astype(bool), bitorder="little")


def may_be_alike(n: int, x: np.ndarray, m: int, y: np.ndarray, percent: int) -> bool:
    """False only where two sets of n and m members cannot reach the threshold: places that differ show members that do."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.bitwise_count(x ^ y).sum())
    return (100 + percent) * (n + m - apart) >= 2 * percent * (n + m)


def _alike(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose complete shingle sets reach the threshold; sketches rule out most others."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x.as_py(), words) for x in batch.column(1)]
            cols = [batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array([sketch(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "n", "sketch"])

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, x, m, y = (c.to_pylist() for c in batch.columns[2:])
            keep = [may_be_alike(i, np.frombuffer(u, np.uint8), j, np.frombuffer(v, np.uint8), percent) for i, u, j, v in zip(n, x, m, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = shingles(x.as_py(), words), shingles(y.as_py(), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def of(some: DataFrame) -> DataFrame:
        nodes = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return texts.join(nodes, "node", "left_semi")

    def beside(some: DataFrame, own: DataFrame, *names: str) -> DataFrame:
        for end in ("a", "b"):
            some = some.join(own.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names]), end)
        return some.select("a", "b", *[f"{c}_{end}" for end in ("a", "b") for c in names])

    drawn = cut(of(pairs).mapInArrow(lean(draw), "node long, n int, sketch binary").dropDuplicates(["node"]), "sketches")
    close = cut(beside(pairs, drawn, "n", "sketch").mapInArrow(lean(rule_out), "a long, b long"), "close")
    drop_cut(drawn)
    own = cut(of(close).dropDuplicates(["node"]), "pair-texts")
    out = cut(beside(close, own, "text").mapInArrow(lean(run), "a long, b long"), "alike")
    drop_cut(own)
    return out


def _may_reach(percent: int):
    """Sizes and places of a shared shingle, of posting and other posting, that allow the threshold."""
    n, m = F.col("n"), F.col("m")
    rest = F.least(n - F.col("pos"), m - F.col("there")).cast("long")
    return (100 * F.least(n, m).cast("long") >= percent * F.greatest(n, m).cast("long")) & (rest * (100 + percent) >= percent * (n.cast("long") + m))


def _size_may_reach(percent: int):
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _central(members: DataFrame, by: str) -> DataFrame:
    """``by``, center: of each group of several ``members`` (node, fp) the one nearest to the bitwise majority of their fingerprints."""
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"ones_{b}") for b in range(64)]
    sums = members.groupBy(by).agg(F.count("*").alias("size"), *ones).filter("size > 1")
    bits = [F.when(2 * F.col(f"ones_{b}") > F.col("size"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b in range(64)]
    major = sums.select(by, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("major"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("major"))).alias("apart")
    return members.join(major, by).groupBy(by).agg(F.min(F.struct(apart, "node")).alias("c")).select(by, F.col("c.node").alias("center"))


def fingerprint_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a SimHash group (node, fp, component_id) with the group's central one."""
    pairs = groups.join(_central(groups, "component_id"), "component_id").filter("node <> center")
    return pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))


def shingle_links(texts: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Edges (a, b) over ``texts`` (node, text) whose components are those of all pairs at the threshold."""
    groups = simhash_groups(texts.select(F.col("node").alias("doc_id"), "text"), words, BITS).withColumnRenamed("doc_id", "node")
    groups = cut(groups.dropDuplicates(["node"]), "groups")
    tried = cut(fingerprint_pairs(groups), "by-fingerprint")
    linked = _alike(tried, texts, words, percent)
    order = _common(texts, words)
    same = Window.partitionBy("token")
    every = _postings(texts, words, percent, *order).withColumn("rep", F.min(F.struct("node", "n", "pos")).over(same)).withColumn("last", F.max("node").over(same))
    filed = cut(every.filter(F.col("rep.node") < F.col("last")).drop("last"), "shared")
    star = filed.select("node", "n", "pos", F.col("rep.node").alias("other"), F.col("rep.n").alias("m"), F.col("rep.pos").alias("there"))
    star = star.filter((F.col("other") < F.col("node")) & _may_reach(percent)).select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()
    star = cut(star.join(tried, ["a", "b"], "left_anti"), "star")
    linked, tried = linked.union(_alike(star, texts, words, percent)), tried.union(star)
    filed = filed.drop("rep")
    turn = 0
    while turn <= TURNS:
        split = _parted(filed, linked, groups)
        if turn < TURNS:
            pairs = _with_pivots(split, turn, percent)
        else:  # the exact rest: all pairs of a bucket outside its largest component
            few = split.filter(F.col("bucket") <= CROWD)
            there = few.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("there"), F.col("root").alias("other_root"))
            pairs = few.filter("root <> top").join(there, "token").filter((F.col("root") != F.col("other_root")) & _may_reach(percent)).select("node", "other")
            crowded, direct = _by_differences(split.filter(F.col("bucket") > CROWD), texts, words, percent, *order)
            pairs, linked = pairs.union(crowded), linked.union(direct)
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        drop_cut(split)
        more = _alike(pairs, texts, words, percent)
        linked, tried = linked.union(more), tried.union(pairs)
        turn = turn + 1 if turn == TURNS or not more.isEmpty() else TURNS
    return linked


def _parted(filed: DataFrame, linked: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings of the buckets that hold several components: their component's root, the largest one's (top) with its central text, the bucket's size."""
    roots = cut(components(linked), "roots")
    rooted = cut(filed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    sizes = rooted.groupBy("token", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("roots"), F.sum("size").alias("bucket")).filter("roots > 1")
    largest = largest.select("token", F.col("top.root").alias("top"), "bucket")
    centers = cut(_central(roots.join(groups.select("node", "fp"), "node"), "root").withColumnRenamed("root", "top"), "centers")
    out = cut(rooted.join(largest.join(centers, "top", "left"), "token"), "split")
    for done in (rooted, roots, centers):
        drop_cut(done)
    return out


def _with_pivots(split: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each text outside its bucket's largest component beside that one's central text, in odd turns beside another member in the bucket."""
    one = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "pos")).alias("p")
    pivots = split.filter("root = top").groupBy("token").agg(one).select("token", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.pos").alias("there"))
    met = split.filter("root <> top").join(pivots, "token")
    if turn % 2:
        return met.filter(_may_reach(percent)).select("node", "other")
    middle = F.col("center").isNotNull()
    return met.filter(F.when(middle, _size_may_reach(percent)).otherwise(_may_reach(percent))).select("node", F.coalesce("center", "other").alias("other"))


def differences(found: np.ndarray, pivot: np.ndarray, percent: int, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int, bool]:
    """The prefix of what only one of two sorted sets has, its full size, and whether the set is off the threshold to the pivot.

    Two sets of n and m members, with a and b differences from the pivot, are at the threshold where at most r (n + m)
    members are in one of them only, so where they share (a + b - r (n + m)) / 2 differences or more; r = (100 - t) / (100 + t).
    That is above 0 if one is off the threshold to the pivot. The least of it over all sizes and differences the other
    may have leaves the prefix. Shingles the pivot lacks come first, rare ones before common ones.
    """
    added, gone = np.setdiff1d(found, pivot, assume_unique=True), np.setdiff1d(pivot, found, assume_unique=True)
    a, n, p = len(added) + len(gone), len(found), len(pivot)
    far = (100 + percent) * a > (100 - percent) * (n + p)
    if not a:
        return gone, a, far
    m, r = np.arange(-(-percent * n // 100), 100 * n // percent + 1), (100 - percent) / (100 + percent)
    apart = r * (n + m)
    least = np.maximum(np.abs(m - p), a - apart)
    if not far:  # only partners off the threshold are asked for
        least = np.maximum(least, r * (m + p))
    shared = max(1, int(np.ceil(((a + least - apart) / 2).min() - 1e-6)))
    return np.concatenate([_in_order(added, common, rank), gone])[: max(0, a - shared + 1)], a, far


def _by_differences(split: DataFrame, texts: DataFrame, words: int, percent: int, common: np.ndarray, rank: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Of crowded buckets, pairs (node, other) that may be linked, and links (a, b) to the pivots."""
    held = cut(split.select(F.coalesce("center", "top").alias("pivot"), "top", "node", "root").distinct(), "held")
    own = texts.join(held.select("node").union(held.select("pivot")).distinct(), "node", "left_semi").dropDuplicates(["node"])
    own = cut(own, "held-texts")
    beside = held.join(own, "node").join(own.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in slices(batches):
            for p, top, node, root, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != last:
                    last, pivot = p, shingles(y, words)
                found = shingles(x, words)
                first, a, far = differences(found, pivot, percent, common, rank)
                pos = np.arange(len(first), dtype=np.int32)
                if not far:  # a row without a shingle says that the text is linked to the pivot
                    first, pos = np.append(first, 0), np.append(pos, np.int32(-1))
                k = len(first)
                cols = [first, np.full(k, p), np.full(k, node), np.full(k, root if far else top), np.full(k, len(found), np.int32), np.full(k, a, np.int32), pos, np.full(k, far)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "pivot", "node", "root", "n", "a", "pos", "far"])

    inputs = beside.select("pivot", "top", "node", "root", "text", "pivot_text")
    out = cut(inputs.mapInArrow(lean(run), "token long, pivot long, node long, root long, n int, a int, pos int, far boolean"), "differences")
    drop_cut(held)
    drop_cut(own)
    filed = out.filter("pos >= 0")
    there = filed.select("token", "pivot", F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("a").alias("b"), F.col("pos").alias("there"), F.col("far").alias("other_far"))
    rest = F.least(F.col("a") - F.col("pos"), F.col("b") - F.col("there")).cast("long")
    needed = (100 + percent) * (F.col("a").cast("long") + F.col("b")) - (100 - percent) * (F.col("n").cast("long") + F.col("m"))
    once = ~F.col("other_far") | (F.col("node") < F.col("other"))
    met = filed.filter("far").join(there, ["token", "pivot"])
    pairs = met.filter((F.col("root") != F.col("other_root")) & once & _size_may_reach(percent) & (2 * (100 + percent) * rest >= needed)).select("node", "other")
    direct = out.filter("pos < 0 AND node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    return pairs, direct


def shingle_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their component by doc_id (null last), all columns as they were.

    Texts are linked where the Jaccard similarity of their sets of ``words``-word shingles is ``percent`` or
    more; a text of fewer words is one shingle, texts without a word are alike. Repeated rows stay repeated.
    SimHash groups at ``BITS`` bits are formed and checked first; the links they lack are found by the exact join.
    """
    texts = docs.select(F.xxhash64(text_or_empty()).alias("node"), text_or_empty().alias("text"))
    roots = cut(components(shingle_links(texts, words, percent)), "roots")
    doc = F.col("doc_id").cast("long")
    rows = docs.select(F.xxhash64(text_or_empty()).alias("node"), doc.alias("doc")).join(roots, "node", "left")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("first")
    stay = cut(rows.groupBy(F.coalesce("root", "node")).agg(first).select(F.col("first.doc").alias("stay"), F.col("first.node").alias("stay_node")), "stay")
    box = docs.select(boxed(docs), doc.alias("doc"), F.xxhash64(text_or_empty()).alias("node"))
    return box.join(stay, F.col("doc").eqNullSafe(F.col("stay")) & (F.col("node") == F.col("stay_node")), "left_semi").select(*unboxed(docs.columns))
