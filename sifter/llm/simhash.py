"""Near-duplicates by SimHash: tiled exact comparison, exclusive-or and bit counts."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import byte_words, durable, id_text, mixed, rows, spread_join, table, window_hashes
from sifter.llm.components import components, join_labels

#: Rows of a block (one side of a task) at most, rows of a tile inside it, words hashed at once.
BLOCK_ROWS, TILE_ROWS, FLUSH = 1 << 18, 2048, 1 << 20
#: Comparisons of a partition of block pairs, about: some twenty seconds.
TASK_PAIRS = 1 << 33


def majority_bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive runs of counts[i] > 0 hashes: the word whose bit is 1 where over half of the run's are.

    Eight bit columns at a time are added up as the eight bytes of a 64-bit word, in runs of 255 at most.
    """
    parts = (counts + 254) // 255
    owner = np.repeat(np.arange(len(counts)), parts)
    first = np.cumsum(parts) - parts
    begin = (np.cumsum(counts) - counts)[owner] + 255 * (np.arange(len(owner)) - first[owner])
    ones = np.empty((len(counts), 8, 8), np.int64)
    for shift in range(8):
        byte = np.add.reduceat((h >> np.uint64(shift)) & np.uint64(0x0101010101010101), begin)
        ones[:, :, shift] = np.add.reduceat(byte.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    return np.packbits(2 * ones > counts[:, None, None], axis=2, bitorder="little").reshape(-1, 8).copy().view("<u8")[:, 0]


def fingerprints(
    docs: DataFrame,
    shingle: int = 4,
    seed: int = 42,
    width: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint): width 64-bit words, each most significant byte first.

    The text is lower-cased in A-Z only. A text without words (null, empty, blank) has zeros. The first
    word takes XXH64 of the shingles; further ones take hashes of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        hashes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) for x in hashes])
            out = np.zeros((len(ids), width), ">u8")
            if held:
                h = np.concatenate(hashes)
                for k in range(width):
                    out[counts > 0, k] = majority_bits(mixed(h, k) if k else h, counts[counts > 0])
            made = pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())],
                ["doc_id", "fingerprint"],
            )
            ids.clear(), hashes.clear()
            return made

        for doc_id, text in rows(batches):
            ids.append(doc_id)
            hashes.append(window_hashes(byte_words(text and text.lower()), shingle, seed, short=True))
            held += len(hashes[-1])
            if held > FLUSH or len(ids) >= 4096:
                yield flush()
                held = 0
        if ids:
            yield flush()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint binary")


def compare(a: Side, b: Side | None, radius: int, within: Within | None = None) -> np.ndarray:
    """Classes of the rows of a (followed by those of b) joined by a pair a-b, or a-a without b, at most radius bits apart.

    A pair of tiles is passed over when their population counts differ by more than radius, as each differing bit changes
    a count by one. Words after the first ones are only compared for pairs that these leave within radius. within: a
    further test of sizes, by which tiles are passed over as well; radius is the largest that it asks for.
    """
    same, b = b is None, a if b is None else b
    base = 0 if same else len(a.words)
    label = np.arange(len(a.words) + (0 if same else len(b.words)))
    width = a.words.shape[1]
    # A partial sum over the radius settles a pair: half of the words do for nearly all, or three if the radius is wide.
    head = (width + 1) // 2
    while head < min(width, 3) and 32 * head - radius < 10 * math.sqrt(head):
        head += 1
    cols_a, cols_b = ([np.ascontiguousarray(x.words[:, k]) for k in range(head)] for x in (a, b))
    tiles_a, tiles_b = a.tiles(), b.tiles()
    for p, q, low_a, high_a, least_a, most_a in tiles_a:
        for s, t, low_b, high_b, least_b, most_b in tiles_b:
            if same and s < p or low_b - high_a > radius or low_a - high_b > radius:
                continue
            if within and (most_a < within.share * least_b or most_b < within.share * least_a):
                continue
            for lo in range(p, q, 64):
                hi = min(lo + 64, q)
                apart = np.bitwise_count(cols_a[0][lo:hi, None] ^ cols_b[0][None, s:t])
                for k in range(1, head):
                    apart += np.bitwise_count(cols_a[k][lo:hi, None] ^ cols_b[k][None, s:t])
                near = np.flatnonzero(apart <= radius)
                if not len(near):
                    continue
                i, j = np.divmod(near, t - s)
                i, j = i + lo, j + s
                if same:
                    i, j = i[i < j], j[i < j]
                if (head < width or within) and len(i):
                    far = np.bitwise_count(a.words[i] ^ b.words[j]).sum(1, dtype=np.int64)
                    ok = within.holds(far, a.sizes[i], b.sizes[j]) if within else far <= radius
                    i, j = i[ok], j[ok]
                if len(i):
                    join_labels(label, i, j + base)
    return label


@dataclass(frozen=True)
class Within:
    """Which pairs of sets are worth linking: sizes in a ratio of `share` or more, and bits apart as far as their smaller size allows.

    radii: (size, radius) by falling size; the first row whose size the smaller set reaches holds.
    """

    share: float
    radii: tuple[tuple[int, int], ...]

    def holds(self, far: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(a, b), np.maximum(a, b)
        reach = np.select([small >= size for size, _ in self.radii], [radius for _, radius in self.radii], -1)
        return (far <= reach) & (small >= self.share * large)


@dataclass(frozen=True)
class Side:
    """Rows of one block: words (rows, width), in order of their population counts, or of sizes if there are any."""

    words: np.ndarray
    sizes: np.ndarray

    def tiles(self) -> list[tuple[int, ...]]:
        """(first, end, least and largest population count, least and largest size) of each tile."""
        count, out = np.bitwise_count(self.words).sum(1, dtype=np.int64), []
        for p in range(0, len(count), TILE_ROWS):
            c, z = count[p : p + TILE_ROWS], self.sizes[p : p + TILE_ROWS]
            out.append((p, p + len(c), int(c.min()), int(c.max()), int(z.min()), int(z.max())))
        return out


def links(prints: DataFrame, radius: int, width: int = 1, block_rows: int = BLOCK_ROWS, within: Within | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints within radius, enough to join every class; prints: node, fingerprint (, size).

    Fingerprints are put in order of their population counts (of sizes, with `within`) and cut into blocks; each pair of blocks
    whose ranges may hold a link is one task. A task gives a spanning forest of its links, so that a group of g near copies
    costs at most g rows for each pair of blocks, not g * g. Blocks hold block_rows at most, so a block is sent to (rows /
    block_rows) tasks: work grows with the square of the distinct fingerprints, as the method's does, less what counts
    or sizes rule out. The driver sees two numbers of each block, never the pairs.
    """
    spark = prints.sparkSession
    n = prints.count()
    parts = max(1, math.ceil(n / block_rows), min(16, math.ceil(n / (2 * TILE_ROWS))))
    schema = "block long, low long, high long, prints binary, nodes binary, sizes binary"
    ones = sum((F.bit_count(F.conv(F.hex(F.substring("fingerprint", 8 * k + 1, 8)), 16, -10).cast("long")) for k in range(width)), F.lit(0))
    rank = F.col("size") if within else ones.cast("long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [x for x in batches if x.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held)
        words = np.frombuffer(b"".join(got["fingerprint"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)
        by, node = got["rank"].to_numpy(), got["node"].to_numpy()
        order = np.argsort(by, kind="stable")
        for k, at in enumerate(range(0, len(order), block_rows)):
            own = order[at : at + block_rows]
            row = [
                TaskContext.get().partitionId() << 32 | k,
                by[own[0]],
                by[own[-1]],
                words[own].tobytes(),
                node[own].tobytes(),
                by[own].tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "low", "high", "prints", "nodes", "sizes"])

    ranged = prints.select("node", "fingerprint", rank.alias("rank")).repartitionByRange(parts, "rank", "fingerprint")
    blocks = durable(ranged.mapInArrow(cut, schema), "blocks")
    # Two numbers and a name for each block, rows / block_rows of them; which blocks each one meets is a range of ranks.
    spans = sorted((r.low, r.high, r.block) for r in blocks.select("low", "high", "block").collect())
    reach = (lambda high: high / within.share) if within else (lambda high: high + radius)
    upto = [bisect.bisect_right(spans, reach(high), key=lambda x: x[0]) - 1 for _, high, _ in spans]
    if not spans:
        return spark.createDataFrame([], "u long, v long")
    number = spark.createDataFrame(
        [(k, x[2], last) for k, (x, last) in enumerate(zip(spans, upto, strict=True))],
        "rank long, block long, last long",
    )
    ranked = blocks.join(F.broadcast(number), "block").select("rank", "last", "prints", "nodes", "sizes")
    met = F.broadcast(number.select(F.col("rank").alias("left"), F.explode(F.sequence("rank", "last")).alias("right")))
    tasks = sum(last - k + 1 for k, last in enumerate(upto))
    first = ranked.join(met, F.col("rank") == F.col("left")).select("left", "right", F.lit(0).alias("side"), "prints", "nodes", "sizes")
    other = ranked.join(met.where("left <> right"), F.col("rank") == F.col("right")).select(
        "left",
        "right",
        F.lit(1).alias("side"),
        "prints",
        "nodes",
        "sizes",
    )

    def forest(got: pa.Table) -> pa.Table:
        got = got.sort_by("side")
        sides = [
            Side(np.frombuffer(p, np.uint64).reshape(-1, width), np.frombuffer(z, np.int64))
            for p, z in zip(got["prints"].to_pylist(), got["sizes"].to_pylist(), strict=True)
        ]
        node = np.concatenate([np.frombuffer(x, np.int64) for x in got["nodes"].to_pylist()])
        label = compare(sides[0], sides[1] if len(sides) > 1 else None, radius, within)
        least = node.copy()
        np.minimum.at(least, label, node)
        moved = np.flatnonzero(node != least[label])
        return pa.table({"u": node[moved], "v": least[label[moved]]})

    # A number of partitions that is asked for isn't merged by bytes: the work of a pair is not its bytes. As many as the work asks for.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.union(other).repartition(min(tasks, max(least, math.ceil(n * n / 2 / TASK_PAIRS))), "left", "right")
    return dealt.groupBy("left", "right").applyInArrow(forest, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 4,
    radius: int = 4,
    seed: int = 42,
    width: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    Two documents are linked when their fingerprints differ in at most radius bits; component_id is the
    smallest doc_id reachable over links. Copies share a fingerprint and meet once, before any
    comparison. Texts without words have a fingerprint of zeros, linked like any other. A null doc_id is kept with
    its fingerprint, which links others like any other; a component of null ids alone has a null component_id. Empty
    input gives no rows.
    """
    prints = durable(fingerprints(docs, shingle, seed, width, id_col, text_col), "prints")
    name = F.conv(F.hex("fingerprint"), 16, -10).cast("long") if width == 1 else F.xxhash64("fingerprint")
    nodes = durable(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("node", name),
        "nodes",
    )
    found = components(links(nodes.select("node", "fingerprint"), radius, width))
    linked = nodes.select("node", "least").join(found, "node")
    ids = linked.groupBy("component").agg(F.min("least").alias("id"))
    of = linked.join(ids, "component").select("node", "id", F.lit(True).alias("linked"))
    known = nodes.join(of, "node", "left").select(
        "fingerprint",
        "copies",
        F.when(F.col("linked"), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )
    return spread_join(prints, durable(known, "classes"), "fingerprint", "copies").select("doc_id", "fingerprint", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
