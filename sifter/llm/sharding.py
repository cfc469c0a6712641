"""Sharding indivisible groups of equal texts by Karmarkar-Karp differencing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import durable, spread_join, table
from sifter.llm.differencing import difference

#: Groups that one task divides, on average, and partial partitions that one task merges.
BUCKET_GROUPS = 4096
#: Parts of buckets up to which the table of their shards (24 bytes a row) is broadcast.
SENT_PARTS = 1 << 20


def merged(parts: DataFrame, count: int, fan: int) -> DataFrame:
    """(bucket, part, shard): which shard each part of each bucket's partial partition goes to; parts: bucket, part, bytes.

    A tree: `fan` buckets at a time are merged by differencing into one partial partition, in a task each, until one is left.
    """
    level = durable(parts, "level")
    placed = level.select("bucket", "part", F.col("bucket").alias("at"), F.col("part").alias("slot"))
    most = level.agg(F.max("bucket")).first()[0] or 0

    def merge(got: pa.Table) -> pa.Table:
        own, row = np.unique(got["bucket"].to_numpy(), return_inverse=True)
        vectors = np.zeros((len(own), count), np.int64)
        slot = got["part"].to_numpy()
        vectors[row, slot] = got["bytes"].to_numpy()
        bins, _ = difference(vectors, count)
        return pa.table(
            {
                "at": got["bucket"],
                "slot": got["part"],
                "above": pa.array(got["bucket"].to_numpy() // fan, pa.int64()),
                "bin": pa.array(bins[row, slot], pa.int32()),
                "bytes": got["bytes"],
            },
        )

    while True:
        step = level.groupBy(F.floor(F.col("bucket") / fan).alias("group")).applyInArrow(
            merge,
            "at long, slot int, above long, bin int, bytes long",
        )
        step = durable(step, "merged")
        up = step.select("at", "slot", "above", "bin")
        up = F.broadcast(up) if most * count <= SENT_PARTS else up
        placed = placed.join(up, ["at", "slot"]).select("bucket", "part", F.col("above").alias("at"), F.col("bin").alias("slot"))
        if most < fan:
            return placed.select("bucket", "part", F.col("slot").alias("shard"))
        placed = durable(placed, "placed")
        level = durable(
            step.groupBy(F.col("above").alias("bucket"), F.col("bin").alias("part")).agg(F.sum("bytes").alias("bytes")),
            "level",
        )
        most //= fan


def shards(
    docs: DataFrame,
    count: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_groups: int = BUCKET_GROUPS,
    fan: int = BUCKET_GROUPS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs: byte sums near equal, equal texts together.

    size: UTF-8 bytes of the text plus 1; a null text has none and is in the group of the empty text. Groups are
    summed before anything else, so a text that a third of the rows hold is one item. Each bucket of groups
    is divided by differencing into a partial partition of `count` sums; partial partitions are then merged by
    differencing, `fan` at a time in a task. A group larger than an equal share stays whole. slot: gapless from 0
    in each shard, counted in the order of written partitions. Groups are told apart by SHA-256. Empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, size = F.unhex(F.sha2(text, 256)).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size")
    sized = durable(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), key, size, F.crc32(text.cast("binary")).alias("text_crc32")),
        "sized",
    )
    groups = durable(sized.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("copies")), "groups")
    buckets = max(1, math.ceil(groups.count() / bucket_groups))

    def divide(got: pa.Table) -> pa.Table:
        got = got.sort_by("key")
        bins, _ = difference(got["bytes"].to_numpy()[:, None], count)
        return pa.table(
            {
                "bucket": got["bucket"],
                "key": got["key"],
                "part": pa.array(bins[:, 0], pa.int32()),
                "bytes": got["bytes"],
                "copies": got["copies"],
            },
        )

    bucketed = groups.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "bytes", "copies")
    parts = durable(bucketed.groupBy("bucket").applyInArrow(divide, "bucket long, key binary, part int, bytes long, copies long"), "parts")
    of = merged(parts.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes")), count, fan)
    of = F.broadcast(of) if buckets * count <= SENT_PARTS else of
    placed = durable(parts.join(of, ["bucket", "part"]).select("key", "shard", "copies"), "places")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, next_ = TaskContext.get().partitionId(), np.zeros(count, np.int64)
        for batch in batches:
            shard = batch["shard"].to_numpy()
            order = np.argsort(shard, kind="stable")
            many = np.bincount(shard, minlength=count)
            rank = np.empty(len(shard), np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(next_, many)
            next_ += many
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(shard), task, np.int32)), pa.array(rank)],
                [*batch.schema.names, "task", "rank"],
            )

    joined = spread_join(sized, placed, "key", "copies").select("doc_id", "size", "text_crc32", "shard")
    # Written with its task and rank, so that the numbers below don't depend on how it is read again.
    numbered = durable(joined.mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, task int, rank long"), "numbered")
    held = numbered.groupBy("task", "shard").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(_by_shard()) - F.col("rows")
    starts = held.select("task", "shard", before.alias("before"))
    return numbered.join(starts, ["task", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("before") + F.col("rank")).alias("slot"),
    )


def _by_shard():
    from pyspark.sql import Window

    return Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards(table(spark, sf_dir, "documents"), 8)
    return got.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
