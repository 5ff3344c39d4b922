"""Following a run: counters while it goes on, and a stop that lets a batch end."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def observed(df: DataFrame, name: str = "run", **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows (and ``counters``) while it is written; no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counters.items()]), seen


class Progress(StreamingQueryListener):
    """Calls ``report`` after each batch with the batch, its rows, all rows so far and rows per second."""

    def __init__(self, report: Callable[[dict], None] = print):
        super().__init__()
        self.report, self.rows, self.failed = report, 0, None

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        self.report({"batch": p.batchId, "rows": p.numInputRows, "all_rows": self.rows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryTerminated(self, event):  # noqa: N802
        self.failed = event.exception


def asked_to_stop(spark: SparkSession, mark: str) -> bool:
    """Whether somebody has put a file at ``mark`` (any file system that Hadoop knows)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _last_batch(query: StreamingQuery) -> int:
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]


def run_until_asked(query: StreamingQuery, mark: str, seconds: float = 5.0) -> None:
    """Wait for a stream's end; once ``mark`` exists, let the batch at hand finish and stop.

    What a stopped stream had not read is read by the next one with the same checkpoint.
    """
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active()
    while query.isActive:
        if asked_to_stop(spark, mark):
            last = _last_batch(query)
            while query.isActive and query.status["isTriggerActive"] and _last_batch(query) == last:
                time.sleep(0.05)
            query.stop()
            return
        query.awaitTermination(seconds)
