"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most ``room`` tokens. Best-fit decreasing is run over the counts per length on
the driver (at most ``room`` counts): all pieces of one length go to the bins with the least sufficient room,
whole groups of equal bins at a time. Pieces then take the planned slots by their rank within their length.

Size of the plan: each length opens or splits at most three groups of bins, and a group that takes a length
has less than half its room left, so there are at most room * (1 + 3 * log2(room)) entries: 152,000 for 4096,
however many documents there are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import cut, lean, slices
from letterbox.llm._tokens import encoder


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Entries (length, first rank, pieces, first sequence, pieces per sequence, offset)."""
    open_: list[tuple[int, int, int]] = []  # (room left, first sequence, sequences), sorted
    entries, fresh = [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"a piece of {length} tokens does not fit {room}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(open_, (length, -1, -1))
            if at < len(open_):
                free, first, bins = open_.pop(at)
            else:
                free, first, bins = room, fresh, -(-left // (room // length))
                fresh += bins
            each = free // length
            full = min(bins, left // each)
            rest = 0 if full == bins else left - full * each
            if full:
                entries.append((length, rank, full * each, first, each, room - free))
                rank, left = rank + full * each, left - full * each
                if free - each * length:
                    insort(open_, (free - each * length, first, full))
            first, bins = first + full, bins - full
            if rest:
                entries.append((length, rank, rest, first, each, room - free))
                rank, left = rank + rest, left - rest
                insort(open_, (free - rest * length, first, 1))
                first, bins = first + 1, bins - 1
            if bins:
                insort(open_, (free, first, bins))
    return entries


def pieces(docs: DataFrame, vocabulary: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row_id, and part / local: its rank among its task's of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen, row = encoder(vocabulary), TaskContext.get().partitionId(), {}, -1
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1)), strict=True):
                ids, row = memoryview(ids + end), row + 1
                for k in range(-(-len(ids) // (4 * room))):
                    own = ids[k * 4 * room : (k + 1) * 4 * room]
                    n = len(own) // 4
                    seen[n] = seen.get(n, -1) + 1
                    out.append((doc, k, k * room, n, zlib.crc32(own), part << 33 | row, part, seen[n]))
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row_id", "part", "local"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, row_id long, part long, local long")


def best_fit_pack(docs: DataFrame, vocabulary: str, room: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_id.

    A null text is the empty one (the end id alone). Repeated rows are packed as often as they occur; ``row_id``
    tells the pieces of one from those of another. An empty table gives none; other columns of ``docs`` are not
    read. The pieces are written to the shared folder once, so ranks hold when tasks are repeated. Ids are those of
    the tokenizers library, through the piece cache of ``_tokens``.
    """
    cuts = cut(pieces(docs, vocabulary, room, end_id), "pieces")
    by_part = cut(cuts.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries = sorted(plan(counts, room))
    columns = [np.array(x, np.int64) for x in zip(*entries, strict=True)] if entries else [np.zeros(0, np.int64)] * 6
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # bases grow with the number of tasks: never broadcast
    ranked = cuts.join(bases.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("local"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, firsts, eachs, offsets = columns
        # entries are sorted by length, then rank: one key finds the entry of a piece
        big = int(ranks.max(initial=0)) + 1
        keys = lengths * big + ranks
        for batch in batches:
            length, rank = (np.asarray(batch.column(k), np.int64) for k in ("length", "rank"))
            at = np.searchsorted(keys, length * big + np.minimum(rank, big - 1), side="right") - 1
            idx = rank - ranks[at]
            seq, off = firsts[at] + idx // eachs[at], offsets[at] + idx % eachs[at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off), batch.column("row_id")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row_id"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "row_id").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, row_id long")
