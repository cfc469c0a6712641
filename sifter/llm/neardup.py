"""Near-duplicates by exact Jaccard index of shingle sets; SimHash says which sets are worth comparing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.llm.common import byte_words, durable, id_text, mixed, rows, small, window_names, word_codes
from sifter.llm.components import components
from sifter.llm.simhash import Within, join_labels, links, majority_bits

#: Shingles of a block at most (a task holds two), and those from which a group is cut so that several tasks share it.
BLOCK_SHINGLES, SHARE_SHINGLES, SHARES = 1 << 22, 1 << 16, 16


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """A row's key: rows of one id and one text count as one document; null ids are told apart by their texts."""
    return F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """64-bit names of the distinct shingles, in order; the text is lower-cased in A-Z only. Fewer words are one shingle."""
    words = byte_words(text and text.lower())
    return np.unique(window_names(word_codes(words), min(shingle, len(words)))) if words else np.empty(0, np.uint64)


def set_prints(docs: DataFrame, shingle: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, node, size, fingerprint) for each row: node names the text's set of shingles, the fingerprint is of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema(
            [("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("fingerprint", pa.binary())],
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got = list(rows([batch.slice(at, 1024)]))
                sets = [shingle_set(x[2], shingle) for x in got]
                size = np.array([len(x) for x in sets], np.int64)
                prints = np.zeros((len(got), width), ">u8")
                if size.any():
                    h = np.concatenate(sets)
                    for k in range(width):
                        prints[size > 0, k] = majority_bits(mixed(h, k) if k else h, size[size > 0])
                node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                cols = [[x[0] for x in got], [x[1] for x in got], node, size, [x.tobytes() for x in prints]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.types, strict=True)], schema=kinds)

    texts = id_text(docs, id_col, text_col)
    keyed = texts.select("doc_id", row_key(texts).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, key long, node long, size long, fingerprint binary")


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All i, j with a Jaccard index of a[i] and b[j] (a[i] and a[j], i < j, without b) of `similarity` or more.

    Sets are sorted arrays of distinct numbers. An index of b's members counts what each a[i] shares with every set.
    """
    same, b = b is None, a if b is None else b
    size = np.array([len(x) for x in b], np.int64)
    member = np.concatenate(b)
    order = np.argsort(member, kind="stable")
    owner, member = np.repeat(np.arange(len(b)), size)[order], member[order]
    left, right = [], []
    for i, x in enumerate(a):
        low = np.searchsorted(member, x, "left")
        many = np.searchsorted(member, x, "right") - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(b))
        j = np.flatnonzero(both / np.maximum(1, len(x) + size - both) >= similarity)
        j = j[j > i] if same else j
        left.append(np.full(len(j), i, np.int64)), right.append(j)
    return np.concatenate(left), np.concatenate(right)


def confirmed(sets: DataFrame, of: DataFrame, similarity: float, block: int = BLOCK_SHINGLES, share: int = SHARE_SHINGLES) -> DataFrame:
    """(u, v): links of Jaccard index `similarity` or more, enough to join every class of them inside each group.

    sets: node, grams (sorted 64-bit numbers); of: node, component, size. Every pair of a group is compared. A group of
    more than `share` shingles is cut into blocks, each pair of blocks being one task; small groups go together, and
    links met between them count too. A task gives a spanning forest of the links it confirmed, so rows grow with
    nodes times blocks, not with pairs.
    """
    total = F.col("total")
    cuts = F.greatest(F.ceil(total / block), F.least(F.lit(SHARES), F.ceil(total / share)), F.lit(1)).cast("long")
    groups = durable(of.groupBy("component").agg(F.sum("size").alias("total")).select("component", "total", cuts.alias("cuts")), "groups")
    bins = int((groups.where("cuts = 1").agg(F.sum("total")).first()[0] or 0) // share) + 1
    own = F.pmod(F.xxhash64("node"), F.col("cuts"))
    dealt = of.join(groups, "component").select("node", "component", "cuts", own.alias("own"))
    dealt = dealt.select("node", "component", "cuts", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("other"))
    alone = F.col("cuts") == 1
    low, high = F.least("own", "other"), F.greatest("own", "other")
    named = dealt.select(
        "node",
        F.when(alone, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("job"),
        F.when(alone, F.lit(-1)).otherwise(low).alias("low"),
        F.when(alone, F.lit(-1)).otherwise(high).alias("high"),
        (F.col("own") > F.col("other")).alias("second"),
        (F.col("own") != F.col("other")).alias("two"),
    )
    # Of a pair of different blocks, the one of the higher number is the second side.

    def forest(got: pa.Table) -> pa.Table:
        node, second, grams = got["node"].to_numpy(), got["second"].to_numpy(), got["grams"].to_pylist()
        order = np.argsort(second, kind="stable")
        node, cut = node[order], int((~second).sum())
        members = [np.frombuffer(grams[k], "<u8") for k in order]
        two = bool(got["two"][0].as_py())
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if two and cut in (0, len(node)):
            return none
        i, j = similar(members[:cut], members[cut:] if two else None, similarity)
        label = np.arange(len(node))
        join_labels(label, i, j + (cut if two else 0))
        least = node.copy()
        np.minimum.at(least, label, node)
        moved = np.flatnonzero(node != least[label])
        return pa.table({"u": node[moved], "v": least[label[moved]]})

    return named.join(sets, "node").select(
        "job",
        "low",
        "high",
        "node",
        "second",
        "two",
        "grams",
    ).groupBy("job", "low", "high").applyInArrow(forest, "u long, v long")


def near_copies(
    docs: DataFrame,
    shingle: int,
    similarity: float,
    radii: tuple[tuple[int, int], ...],
    width: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(key) twice: row_key() of each document that is not the one kept of its component, and of each kept one that has several rows.

    Documents are linked by an exact Jaccard index of `similarity` or more of their sets of shingles; texts without words
    have equal sets. Fingerprints as near as `radii` say for the smaller set's size (see Within), of sets whose sizes allow the
    index at all, and closed to groups, say which sets are compared. The document of least doc_id is kept, one with a null
    id only in a component of null ids alone.
    """
    prints = durable(set_prints(docs, shingle, width, id_col, text_col), "prints")
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    nodes = durable(
        prints.groupBy("node").agg(
            F.min("fingerprint").alias("fingerprint"),
            F.min("size").alias("size"),
            F.min(best).alias("best"),
        ),
        "nodes",
    )
    # Different sets have an index of n / (n + 1) at most, n being the size of the smaller one.
    able = nodes.where(F.col("size") / (F.col("size") + 1) >= similarity).select("node", "fingerprint", "size")
    near = components(links(able, max(r for _, r in radii), width, within=Within(similarity, radii)))
    near = durable(nodes.join(near, "node").select("node", "component", "size", F.col("best.key").alias("key")), "near")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got = list(rows([batch.slice(at, 1024)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in got], pa.int64()),
                        pa.array([shingle_set(x[1], shingle).astype("<u8").tobytes() for x in got], pa.binary()),
                    ],
                    ["node", "grams"],
                )

    texts = id_text(docs, id_col, text_col)
    # Whole texts stay where they are while the keys of the few that have a candidate are small.
    texts = texts.select(row_key(texts).alias("key"), "text").join(small(near.select("key", "node"), 16), "key").select("node", "text")
    sets = durable(texts.mapInArrow(grams, "node long, grams binary").groupBy("node").agg(F.first("grams").alias("grams")), "sets")
    of = components(confirmed(sets, near.select("node", "component", "size"), similarity))
    kept = nodes.join(of, "node", "left").groupBy(
        F.coalesce("component", "node"),
    ).agg(F.min("best").alias("best")).select(F.col("best.key").alias("key"))
    kept = durable(kept, "kept")
    many = durable(prints.groupBy("key").agg(F.count("*").alias("n")), "rows")
    gone = durable(many.join(kept, "key", "left_anti").select("key"), "gone")
    return gone, durable(many.where("n > 1").join(gone, "key", "left_anti").select("key"), "again")
