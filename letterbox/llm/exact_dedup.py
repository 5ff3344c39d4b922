"""Exact dedup by a tree merge of sorted digest runs.

Every input partition is a run: its digests, sorted, with one entry for all local copies. Runs are then
merged in rounds of a binomial (radix ``fan_in``) exchange. In round r the partitions whose numbers differ
in digit r only trade entries so that afterwards digit r of the partition number is digit r of the digest's
bucket. Each partition thus gets ``fan_in`` sorted parts, one from each of its peers, which are merged as they
are, without sorting anew: the least of the parts' heads bounds what can be merged next, and one pass over
neighbours keeps the chosen identifier and the summed count. After all rounds a partition owns its digests
outright. A group of copies that holds a third of all rows is one entry of each run from the start.

Digests are SHA-256; text length and a second hash travel along and must agree when entries merge. A partition
holds the entries of one cell (some 90 bytes for each distinct text), so ``width`` grows with the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterbox.llm._common import boxed, cut, lean, partitions, text_or_empty, unboxed

_RUN = "digest binary, size long, check long, has_id int, id long, at_id long, n long, peer int"
_KEYS = ["digest", "size", "check"]
_SCHEMA = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("check", pa.int64()), ("has_id", pa.int32()), ("id", pa.int64()), ("at_id", pa.int64()), ("n", pa.int64()), ("peer", pa.int32())])
#: entries of a part that are merged at a time
_CHUNK = 1 << 14
_ENTRY = np.dtype([("digest", "S32"), ("size", "<i8"), ("check", "<i8"), ("has_id", "<i4"), ("id", "<i8"), ("at_id", "<i8"), ("n", "<i8")])


def digests(text: Column) -> list[Column]:
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("check")]


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(batch.num_rows, _ENTRY)
    column = batch.column(0)
    offsets = np.frombuffer(column.buffers()[1], np.int32, batch.num_rows + 1 + column.offset)[column.offset :]
    out["digest"] = np.frombuffer(column.buffers()[2], "S32", batch.num_rows, int(offsets[0]))
    for k, name in enumerate(_ENTRY.names[1:], 1):
        out[name] = batch.column(k).to_numpy(zero_copy_only=False)
    return out


def collapse(t: np.ndarray, keep: str) -> np.ndarray:
    """One entry for equal neighbours: the kept identifier, the rows that have it, and all rows.

    Neighbours are equal when digest, size and check agree; entries are ordered by digest, and the few whose
    digests alone agree by the others.
    """
    if not len(t):
        return t
    same = (t["digest"][1:] == t["digest"][:-1]) & (t["size"][1:] == t["size"][:-1]) & (t["check"][1:] == t["check"][:-1])
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    out = t[starts]
    out["n"] = np.add.reduceat(t["n"], starts)
    out["has_id"] = np.maximum.reduceat(t["has_id"], starts)
    worst = np.iinfo(np.int64).min if keep == "max" else np.iinfo(np.int64).max
    ids = np.where(t["has_id"] == out["has_id"][group], t["id"], worst)
    out["id"] = (np.maximum if keep == "max" else np.minimum).reduceat(ids, starts)
    at = np.where((ids == out["id"][group]) & (t["has_id"] == out["has_id"][group]), t["at_id"], 0)
    out["at_id"] = np.add.reduceat(at, starts)
    return out


def merge_runs(runs: list[list[np.ndarray]], keep: str) -> Iterator[np.ndarray]:
    """Merge runs (lists of blocks, each run sorted by digest) into collapsed, sorted blocks."""
    heads = [np.concatenate(r) if len(r) > 1 else r[0] for r in runs if r]
    at = [0] * len(heads)
    while True:
        live = [k for k in range(len(heads)) if at[k] < len(heads[k])]
        if not live:
            return
        # all that is not above the least of the parts' next chunk ends can be merged now, whole groups of copies too
        bound = min(heads[k]["digest"][min(at[k] + _CHUNK, len(heads[k])) - 1] for k in live)
        taken = []
        for k in live:
            to = int(np.searchsorted(heads[k]["digest"], bound, side="right"))
            taken.append(heads[k][at[k] : to])
            at[k] = to
        some = np.concatenate(taken)
        # a stable sort of what is sorted in parts merges them; size and check only part equal digests
        some = some[np.argsort(some["digest"], kind="stable")]
        tied = some["digest"][1:] == some["digest"][:-1]
        if tied.any() and ((some["size"][1:] != some["size"][:-1]) | (some["check"][1:] != some["check"][:-1]))[tied].any():
            some = some[np.lexsort((some["check"], some["size"], some["digest"]))]
        yield collapse(some, keep)


def _merge(keep: str):
    """Merge a partition's sorted parts, told apart by the peer they come from; what comes out names this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[np.ndarray]] = defaultdict(list)
        me = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                rows, peers = _entries(batch), batch.column(7).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(peers)) + 1
                for part, peer in zip(np.split(rows, edges), peers[np.concatenate(([0], edges))].tolist(), strict=True):
                    runs[peer].append(part)
        for block in merge_runs(list(runs.values()), keep):
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(block), [None, pa.py_buffer(np.ascontiguousarray(block["digest"]).tobytes())]).cast(pa.binary())
            cols = [digest, *[pa.array(np.ascontiguousarray(block[k])) for k in _ENTRY.names[1:]], pa.array(np.full(len(block), me, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)

    return lean(run)


def digest_groups(rows: DataFrame, keep: str = "max", fan_in: int = 4, width: int | None = None) -> DataFrame:
    """One row per distinct (digest, size, check): has_id, id (the one kept), at_id (rows with it), n.

    ``rows`` has those three and doc_id; a null doc_id is kept only where a group has no other.
    ``width``: partitions of the exchange, the session's shuffle partitions by default.
    """
    width = width or partitions(rows.sparkSession)
    digits = 1
    while fan_in**digits < width:
        digits += 1
    cells = fan_in**digits
    one = F.lit(1).cast("long")
    run = rows.select(*_KEYS, F.col("doc_id").isNotNull().cast("int").alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), one.alias("at_id"), one.alias("n"), F.lit(0).alias("peer"))
    merge = _merge(keep)
    # the only sort: each input partition becomes a run
    run = run.sortWithinPartitions("digest").mapInArrow(merge, _RUN)
    # the bucket of a digest: its leading bits, spread over the cells
    bucket = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % cells
    for r in range(digits):
        place = fan_in**r
        here = F.col("peer") % cells
        there = here - (F.floor(here / place) % fan_in) * place + (F.floor(bucket / place) % fan_in) * place
        run = run.withColumn("part", there.cast("int")).repartitionById(cells, "part").drop("part").mapInArrow(merge, _RUN)
    return run.drop("peer")


def exact_dedup(docs: DataFrame, text: Column | None = None, keep: str = "max", fan_in: int = 4) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any others) with keep_id, group_size, kept, text_sha256.

    Null texts equal the empty text; null identifiers lose to any other. Where the identifier that stays
    is on several rows of a group, exactly one of them is kept. An empty table gives an empty result.
    Columns of ``docs`` named like the four that are added are replaced; all others stay as they are.
    """
    rows = docs.select(boxed(docs), F.col("doc_id").cast("long").alias("doc_id"), *digests(text_or_empty() if text is None else text))
    groups = cut(digest_groups(rows.select("doc_id", *_KEYS), keep, fan_in), "digests")
    right = groups.select(*_KEYS, F.when(F.col("has_id") == 1, F.col("id")).alias("keep_id"), "at_id", F.col("n").alias("group_size"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not groups.filter("at_id > 1").isEmpty():
        # rows repeat the kept identifier: rows are numbered once, for good, and the first of them is kept
        rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
        out = rows.join(right, _KEYS)
        first = rows.select("uid", "doc_id", *_KEYS).join(right.filter("at_id > 1"), _KEYS).filter(stays).groupBy(*_KEYS).agg(F.min("uid").alias("first"))
        out = out.join(cut(first, "firsts"), _KEYS, "left")
        stays = stays & (F.col("first").isNull() | (F.col("uid") == F.col("first")))
    else:
        out = rows.join(right, _KEYS)
    own = {"keep_id": F.col("keep_id"), "group_size": F.col("group_size"), "kept": stays, "text_sha256": F.lower(F.hex("digest"))}
    return out.select(*unboxed(docs.columns, tuple(own)), *[v.alias(k) for k, v in own.items()])
