"""Streams of pages: new addresses once, compaction by batch, and look-ups that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from letterbox.functions.clean import clean, dedup_key
from letterbox.functions.text import normalize_text, pattern_suite
from letterbox.functions.validate import additional_failure, basic_syntax, well_formed


def stream_emails(texts: DataFrame, text: str = "text", compat: bool = False) -> DataFrame:
    """Every address once over the life of the stream.

    State is one key per distinct address and is kept for ever, as "once" asks for; it lies in the state store
    that the session names (RocksDB for more addresses than fit executors' memory).
    """
    raw = texts.select(F.explode(pattern_suite(normalize_text(F.col(text)), compat)).alias("c")).select(F.col("c.raw").alias("raw"))
    email = raw.select(dedup_key(clean(F.col("raw"), compat)).alias("email"))
    good = email.filter(well_formed(F.col("email")) & basic_syntax(F.col("email")) & additional_failure(F.col("email")).isNull())
    return good.dropDuplicates(["email"])


def merge_into(path: str, slices: int = 64):
    """A ``foreachBatch`` function: addresses of a batch that the table lacks are appended.

    The table is partitioned by a hash of the address, and a batch reads the slices it has addresses for. A batch
    that is run again finds its addresses there, so the table never repeats one; one stream writes a table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select("email").distinct().withColumn("slice", F.pmod(F.xxhash64("email"), F.lit(slices)).cast("int")).persist()
        met = [r.slice for r in new.select("slice").distinct().collect()]  # at most ``slices`` numbers
        try:
            known = spark.read.schema("email string, slice int").parquet(path).filter(F.col("slice").isin(met))
            fresh = new.join(known, ["slice", "email"], "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            fresh = new
        fresh.write.mode("append").partitionBy("slice").parquet(path)
        new.unpersist()

    return merge


def start_compaction(emails: DataFrame, path: str, checkpoint: str, seconds: int = 300) -> DataStreamWriter:
    return emails.writeStream.foreachBatch(merge_into(path)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def mx_cache(answers: DataFrame, hours: int = 24, hours_failed: int = 1) -> DataFrame:
    """Latest answer per domain from a stream (domain, has_mx, ts), with valid_until; state expires with it."""

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for pdf in batches:
            row = pdf.sort_values("ts").iloc[-1]
            if best is None or row.ts.value // 1000 >= best[1]:
                best = (bool(row.has_mx), row.ts.value // 1000)
        state.update(best)
        life = hours if best[0] else hours_failed
        state.setTimeoutDuration(life * 3_600_000)
        until = pd.Timestamp(best[1], unit="us") + pd.Timedelta(hours=life)
        yield pd.DataFrame({"domain": [key[0]], "has_mx": [best[0]], "valid_until": [until]})

    return answers.groupBy("domain").applyInPandasWithState(update, "domain string, has_mx boolean, valid_until timestamp", "has_mx boolean, at long", "update", GroupStateTimeout.ProcessingTimeTimeout)
