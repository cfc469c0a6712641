"""Streaming: a profile that grows with each micro-batch, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators.profile import value_cells, value_counts


def merge_counts(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Value counts of all rows so far: (ordinal, value, n) are sums, so batches merge exactly.

    The batch's values join the sums uncounted, so that a task holds one table of values, not one for each batch and one of all.
    """
    if before is None:
        return value_counts(batch)
    now = value_cells(batch).withColumn("n", F.lit(1).cast("long"))
    return before.unionByName(now).groupBy("ordinal", "value").agg(F.sum("n").alias("n"))


def profiled(counts: DataFrame) -> DataFrame:
    """(ordinal, row_count, null_count, unique_count) of merged counts."""
    return counts.groupBy("ordinal").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
    )


def profile_stream(stream: DataFrame, state_path: str, each: Callable[[DataFrame, int], None] | None = None):
    """A started query that keeps value counts under state_path, one folder for each epoch, and calls each(profile, epoch).

    An epoch that comes again overwrites its own folder from the one before it, so a restart counts nothing twice.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{state_path}/epoch-{epoch - 1}") if epoch else None
        merge_counts(before, batch).write.mode("overwrite").parquet(f"{state_path}/epoch-{epoch}")
        if each:
            each(profiled(spark.read.parquet(f"{state_path}/epoch-{epoch}")), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).start()


def windowed_counts(
    events: DataFrame,
    time_col: str,
    key_col: str,
    value_col: str,
    width: str = "1 day",
    late: str = "1 hour",
) -> DataFrame:
    """(start, key, n, total) in tumbling windows; rows later than the watermark are left out of a stream. Works on batches too."""
    base = events.withWatermark(time_col, late) if events.isStreaming else events
    return base.groupBy(
        F.window(time_col, width).alias("w"),
        F.col(key_col).alias("key"),
    ).agg(F.count("*").alias("n"), F.sum(value_col).alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")
