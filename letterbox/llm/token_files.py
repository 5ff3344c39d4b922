"""Token-id output: wavelet-matrix shard files in ascending doc_id order, and their reader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from letterbox.llm._common import cut, new_path, partitions, slices
from letterbox.llm._files import read_file, write_file
from letterbox.llm._tokens import encoder
from letterbox.llm._wavelet import WaveletMatrix

#: ids after which a shard is closed; a document is never cut, so one long text may exceed it
SHARD = 1 << 19


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, shard: int = SHARD) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the shard table: path, part, shard, n_docs, n_tokens, start.

    Rows are range-partitioned and sorted by doc_id (null first; rows that repeat a doc_id stay together).
    A null text is empty, so each document has at least ``end_id``. A shard file holds its ids as a wavelet
    matrix beside doc ids and lengths; ``start`` counts the ids of all shards before it. The table is written
    to the shared folder before it is returned, so the files of attempts that failed are never read. An empty table
    gives no shard; other columns of ``docs`` are not read. Ids are those of the tokenizers library, through the
    piece cache of ``_tokens``.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            arrays = {
                "doc_id": np.array([0 if d is None else d for d, _ in held], "<i8"),
                "has_id": np.array([d is not None for d, _ in held], "<u1"),
                "length": np.array([len(x) // 4 for _, x in held], "<i8"),
            }
            path = write_file(folder, f"{part:06d}-{number:06d}.lbxwm", WaveletMatrix.build(ids).to_bytes(arrays))
            return pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int64()), "shard": pa.array([number], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})

        for batch in slices(batches):
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1)), strict=True):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    shards = cut(rows.mapInArrow(run, "path string, part long, shard long, n_docs long, n_tokens long"), "shards")
    # two levels of prefix sums: over the partitions (few rows), then over the shards of each
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inner.join(parts, "part").select("path", "part", "shard", "n_docs", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def read_token_files(shards: DataFrame) -> DataFrame:
    """One row per document of the shard table: doc_id, start, n_tokens, ids_crc32, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matrix, arrays = WaveletMatrix.from_bytes(read_file(path))
                ids = memoryview(matrix.decode().tobytes())
                lengths = arrays["length"]
                ends = np.cumsum(lengths)
                if len(ends) and ends[-1] != matrix.n:
                    raise ValueError(f"{path}: lengths do not add up to its ids")
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(arrays["doc_id"], pa.int64(), mask=arrays["has_id"] == 0),
                    "start": pa.array(starts + start, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    files = shards.select("path", "start").repartition(partitions(shards.sparkSession))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
