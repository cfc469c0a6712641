"""Connected components over an edge table: in one task while that holds the edges, else by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import durable, spread_join

#: Edges that one task holds at most: 16 MB.
TASK_EDGES = 1 << 20


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i[k] and j[k] for all k; label[x] stays the least index of x's class."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _least(pairs: DataFrame) -> DataFrame:
    """pairs with m, the least neighbour of u or u itself: pre-aggregated before its shuffle; a hub's rows stay where they are."""
    known = durable(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
    return spread_join(pairs, known, "u", "n")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [x for x in batches if x.num_rows]
    if held:
        got = pa.Table.from_batches(held)
        u, v = got["u"].to_numpy(), got["v"].to_numpy()
        node, at = np.unique(np.r_[u, v], return_inverse=True)
        label = np.arange(len(node))
        join_labels(label, at[: len(u)], at[len(u) :])
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_pydict({"node": node[k : k + (1 << 16)], "component": node[label[k : k + (1 << 16)]]})


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge.

    edges: long columns u, v. Up to task_edges different ones are merged by one task. Beyond, rounds after Kiveris et al. (2014):
    every round relinks neighbours to the least one known, in the table sizes of the edges, until a round changes nothing. Both
    give the same. Loops, repeated and reversed edges are harmless; no edge gives no row. Raises if max_rounds do not suffice.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda pairs: pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    if 0 < seen[0] <= task_edges:
        return now.repartition(1).mapInArrow(_in_one_task, "node long, component long")
    for _ in range(max_rounds if seen[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large, "large")
        small = _least(large)
        small = small.select(
            F.col("v").alias("u"),
            F.col("m").alias("v"),
        ).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = durable(small, "small")
        state = mark(now)
        if state == seen:
            break
        seen = state
    else:
        if seen[0]:
            raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(),
    )
