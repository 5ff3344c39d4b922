"""SimHash near-dedup with multi-index hashing.

Two fingerprints within d bits must, in some segment s of a fixed cut, differ by at most r_s bits once the
sum of (r_s + 1) is d + 1. So every distinct fingerprint is filed once per segment under its bits there,
and looked up under all keys of the Hamming ball of radius r_s around them; what a look-up fetches is held
against the complete distance. Any cut finds every pair; the number of fingerprints decides which one is
cheapest. For d = 4 it is three segments of 22, 22 and 20 bits with radii 1, 1 and 0 (47 look-ups each) up to
some 50 million, beyond that two of 32 bits with radii 2 and 1 (562 look-ups, each into four billion keys).
Copies share a fingerprint and are one entry. Keys under which very many fingerprints lie are dealt out in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterbox.llm._common import boxed, cut, lean, slices, unboxed
from letterbox.llm._fingerprint import simhash
from letterbox.llm.components import components


#: fingerprints under one key from which on the key is dealt out in parts of so many
HOT = 1024


def _cut_into(m: int, bits: int) -> list[tuple[int, int, int]]:
    radii = [(bits + 1) // m - 1 + (i < (bits + 1) % m) for i in range(m)]
    widths, out, at = [64 // m + (i < 64 % m) for i in range(m)], [], 0
    for width, radius in zip(widths, radii, strict=True):
        out.append((at, width, radius))
        at += width
    return out


def segments(bits: int, entries: int = 0) -> list[tuple[int, int, int]]:
    """(shift, width, radius) per segment for links at ``bits`` or fewer differing bits.

    The cut with the fewest look-ups and fetched candidates among evenly spread ``entries`` fingerprints.
    """

    def cost(cuts: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(width, r) for r in range(radius + 1)) * (1 + entries / 2**width) for _, width, radius in cuts)

    return min((_cut_into(m, bits) for m in range(1, min(bits + 1, 8) + 1)), key=cost)


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in picked) for r in range(radius + 1) for picked in combinations(range(width), r)]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [simhash(x.as_py(), words) for x in batch.column(1)]
            fps = [x - (1 << 64) if x >> 63 else x for x in fps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def links(fps: DataFrame, bits: int = 4, entries: int | None = None, hot: int = HOT) -> DataFrame:
    """Pairs a < b of the distinct fingerprints ``fps`` (column fp) that differ in 1 to ``bits`` bits."""
    cuts = segments(bits, fps.count() if entries is None else entries)

    def keys(shift: int, width: int):
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def around(i: int, shift: int, width: int, radius: int):
        masks = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)) for m in ball(width, radius)])
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("s"), keys(shift, width).bitwiseXOR(m).alias("key")))

    filed = F.array(*[F.struct(F.lit(i).alias("s"), keys(shift, width).alias("key")) for i, (shift, width, _) in enumerate(cuts)])
    there = fps.select(F.col("fp").alias("b"), F.explode(filed).alias("k")).select("b", "k.s", "k.key")
    here = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*[around(i, *c) for i, c in enumerate(cuts)])).alias("k")).select("a", "k.s", "k.key")
    crowded = cut(there.groupBy("s", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("s", "key", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "crowded")
    by = ["s", "key"]
    if not crowded.isEmpty():  # entries of a crowded key lie in one part each, look-ups go to all of them
        there = there.join(crowded, by, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        here = here.join(crowded, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
        by = [*by, "part"]
    met = F.lit(True)
    for c in by:
        met = met & (here[c] == there[c])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    found = here.hint("merge").join(there, met & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id that links lead to, its own included.

    Null or blank texts have fingerprint 0 and link like any other. Null identifiers are grouped too but
    never name a component unless it has no other. Repeated rows stay repeated; an empty table gives none. Other
    columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, words), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    pairs = cut(links(nodes.select("fp"), bits), "links")
    roots = cut(components(pairs), "roots")
    named = nodes.join(roots, nodes["fp"] == roots["node"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(named, "root").select(F.col("node"), "component_id")
    nodes = nodes.join(linked, nodes["fp"] == linked["node"], "left")
    nodes = cut(nodes.select(F.col("fp").alias("_fp"), F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "named")
    return fps.join(nodes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, all columns as they were, whatever their names."""
    groups = simhash_groups(docs, words, bits)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay")).distinct()
    rows = docs.select(boxed(docs), F.col("doc_id").cast("long").alias("doc"))
    return rows.join(stay, F.col("doc").eqNullSafe(F.col("stay")), "left_semi").select(*unboxed(docs.columns))
