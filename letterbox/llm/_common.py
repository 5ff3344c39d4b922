"""Shared plumbing: the scratch folder all executors see, and frames cut from their lineage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir that this application owns and removes when it ends.

    Only where the setting is absent (tests on one machine) is a local temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='letterbox-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(remove, spark, base)
    path = f"{base.rstrip('/')}/letterbox-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        _OWNED.add(path)
        atexit.register(remove, spark, path)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


_OWNED: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a stopped session is no error."""
    context = spark.sparkContext
    if context._jsc is None or context._jvm is None:
        return
    try:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone at exit
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._letterbox_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove what ``cut`` wrote once nothing reads it any more."""
    if path := getattr(df, "_letterbox_path", None):
        remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches (which Spark holds to spark.sql.execution.arrow.maxBytesPerBatch) in parts of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return what Arrow and the C library hold free to the system; they keep it for their next use otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving free memory back after each batch it took and at its end.

    Python workers live on after a task, beside the tasks of all later stages.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(taken())
        finally:
            give_back()

    return lean_run


def running_sums(df: DataFrame, by: list, sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with, for each new name in ``sums``, the sum of its column over all rows before, ordered by ``by``.

    Range partitions (written once, so that they hold), their totals (a row each), and running sums inside them.
    """
    held = cut(df.repartitionByRange(partitions(df.sparkSession), *by).withColumn("_p", F.spark_partition_id()), name)
    totals = held.groupBy("_p").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = held.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    out = out.join(totals, F.col("_p") == F.col("_q"))
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).select(*df.columns, *sums)


def boxed(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that names of an operator's own meet none of them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


def unboxed(columns: list[str], without: tuple[str, ...] = (), **instead: Column) -> list[Column]:
    """The columns out of their box, less those named as in ``without`` and with those in ``instead`` replaced."""
    gone = {c.lower() for c in without}
    own = {k.lower(): v for k, v in instead.items()}
    return [own.get(c.lower(), F.col("row").getField(c)).alias(c) for c in columns if c.lower() not in gone]


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
