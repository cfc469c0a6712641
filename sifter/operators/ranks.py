"""Average ranks and exact quantiles whose tasks hold a bounded number of values."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sifter.sources.shared import durable

#: Distinct values that one task ranks, or holds to read a quantile off.
TASK_VALUES = 1 << 18


def double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def average_ranks(counts: DataFrame, key: str, value: str, copies: str, most: int = TASK_VALUES) -> DataFrame:
    """counts with rank: for each key, the mean rank of a value of which there are `copies`.

    Up to `most` distinct values of a key are one window. With more, values are range partitioned by key and value into pieces of
    about `most` and summed up piece by piece; the totals of pieces and keys (one row each) say where ranks begin. A value's
    piece is found by the partitioner, so that work doesn't grow with the number of pieces.
    """
    size, rows = counts.groupBy(key).agg(F.count("*").alias("m")).agg(F.coalesce(F.max("m"), F.lit(0)), F.sum("m")).first()
    half = (F.col(copies) - 1) / 2.0
    if size <= most:
        upto = F.sum(copies).over(Window.partitionBy(key).orderBy(value))
        return counts.withColumn("rank", upto - half)
    ordered = counts.repartitionByRange(math.ceil(rows / most), key, value).withColumn("piece", F.spark_partition_id())
    ordered = ordered.sortWithinPartitions(key, value)
    ordered = durable(ordered.mapInArrow(_running(copies), ordered.select("*", F.lit(0).cast("long").alias("upto")).schema), "ordered")
    earlier = lambda by: F.sum("total").over(Window.orderBy(by)) - F.col("total")
    # A row for each piece, and one for each key.
    pieces = ordered.groupBy("piece").agg(F.sum(copies).alias("total")).select("piece", earlier("piece").alias("before"))
    starts = ordered.groupBy(key).agg(F.sum(copies).alias("total")).select(key, earlier(key).alias("start"))
    placed = ordered.join(F.broadcast(pieces), "piece").join(F.broadcast(starts), key)
    return placed.withColumn("rank", F.col("before") + F.col("upto") - F.col("start") - half).select(*counts.columns, "rank")


def _running(copies: str):
    """Batches of a partition with upto, the sum of copies so far."""

    def run(batches):
        upto = 0
        for batch in batches:
            here = upto + np.cumsum(batch.column(copies).to_numpy(zero_copy_only=False))
            upto = int(here[-1]) if len(here) else upto
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(here, pa.int64())], [*batch.schema.names, "upto"])

    return run


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = TASK_VALUES) -> list[float | None]:
    """Exact quantiles of a column by linear interpolation; null for a column without values.

    One aggregation counts values. While more than `most` distinct ones may lie around a quantile, approximate quantiles close to
    it bound a smaller interval, whose rows are counted anew; then the quantile is read off that interval alone.
    """
    x = double(column)
    held = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    n, distinct = held.agg(F.count("*"), F.approx_count_distinct("x")).first()
    return [_quantile(held, n, distinct, share, most) if n else None for share in shares]


def _quantile(held: DataFrame, n: int, distinct: int, share: float, most: int) -> float:
    place, below, inside = share * (n - 1), 0, held
    while distinct > most and n > 1:
        at = (place - below) / (n - 1)
        near = [max(0.0, at - 2e-3), min(1.0, at + 2e-3)]
        low, high = inside.agg(F.percentile_approx("x", near, 10_000)).first()[0]
        x = F.col("x")
        count = inside.agg(
            F.count_if(x < low),
            F.count_if((x >= low) & (x <= high)),
            F.approx_count_distinct(F.when((x >= low) & (x <= high), x)),
        ).first()
        if not (below + count[0] <= math.floor(place) and math.ceil(place) < below + count[0] + count[1]) or count[1] == n:
            break  # the interval misses a neighbour of the place, or no longer shrinks: read it off what there is
        below, n, distinct, inside = below + count[0], count[1], count[2], inside.where((x >= low) & (x <= high))
    return inside.agg(F.percentile("x", min(1.0, max(0.0, (place - below) / max(1, n - 1))))).first()[0]
