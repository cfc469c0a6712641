"""Samples of exactly n rows, drawn row by row: by place where the rows of files have one, else by value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators.identity import place_sample
from sifter.operators.profile import row_key

#: Equal rows that one task draws for, and bytes of a chosen key.
COPIES, KEY_BYTES = 1 << 16, 32
BROADCAST_BYTES = 32 << 20


def row_sample(df: DataFrame, rows: int, seed: int = 42, n: int | None = None) -> DataFrame:
    """Exactly `rows` rows of df (all, if there are no more), each row being as likely as any other, the same for any partitioning.

    Rows that a file's reader numbers are drawn by their places, in one narrow pass; others by their values. n: the number
    of rows, if it is known.
    """
    n = df.count() if n is None else n
    if n <= rows:
        return df
    by_place = place_sample(df, rows, seed, n)
    return value_sample(df, rows, seed, n) if by_place is None else by_place


def value_sample(df: DataFrame, rows: int, seed: int, n: int) -> DataFrame:
    """`rows` of the n rows of df, more than `rows`, drawn by value, for sources whose rows have no places.

    The k-th of equal rows draws the hash of (seed, row, k), so that equal rows are drawn one by one and the sample is the same
    for any partitioning and any order. Rows are counted by a 128-bit key, pre-aggregated; draws above a cut that all but
    surely leaves a few more than `rows` go at once, wherever they are; the few too many go last, so that no task sees more
    than about `rows` draws. Equal rows beyond COPIES draw in tasks of their own.
    """
    spark, keys = df.sparkSession, row_key(df)
    counts = df.select(keys[0].alias("k0"), keys[1].alias("k1")).groupBy("k0", "k1").agg(F.count("*").alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    few = counts.where(F.col("copies") <= COPIES).select("k0", "k1", "copies", F.lit(0).cast("long").alias("block"))
    many = counts.where(F.col("copies") > COPIES).select("k0", "k1", "copies", blocks.alias("block"))
    first = F.col("block") * COPIES
    last = F.least(first + (COPIES - 1), F.col("copies") - 1)
    each = few.union(many.repartition(parts, "k0", "k1", "block")).select("k0", "k1", F.explode(F.sequence(first, last)).alias("copy"))
    wanted = min(1.0, (rows + 8 * math.sqrt(rows) + 32) / n)
    cut = -(2**63) + min(2**64 - 1, math.ceil(wanted * 2**64))
    drawn = each.withColumn("draw", F.xxhash64(F.lit(seed), "k0", "k1", "copy")).where(F.col("draw") <= F.lit(cut))
    kept = drawn.orderBy("draw", "k0", "k1", "copy").limit(rows).groupBy("k0", "k1").agg(F.count("*").cast("int").alias("times"))
    kept = F.broadcast(kept) if rows * KEY_BYTES <= BROADCAST_BYTES else kept
    whole = df.select(keys[0].alias("k0"), keys[1].alias("k1"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    one = whole.join(kept, ["k0", "k1"]).groupBy("k0", "k1").agg(F.first("row").alias("row"), F.first("times").alias("times"))
    out = one.select(F.explode(F.array_repeat("row", F.col("times"))).alias("row"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
