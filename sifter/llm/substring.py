"""Substring dedup by level-wise doubling: stretches that repeat at half a window's length alone are extended to the window."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import byte_words, durable, id_text, ints, rows, table, window_names, word_codes

#: Windows that a task holds at once, and that a bucket is meant to hold.
FLUSH, BUCKET = 1 << 20, 1 << 20
#: Bytes of run lists up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
NAMES = "doc_id long, key long, at binary, name binary"
CANDIDATES = [("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.binary()), ("name", pa.binary())]
MOVED = "bucket int, batch long, ids binary, counts binary, steps binary, name binary"
SHARED = "batch long, ids binary, counts binary, places binary, later binary"
RUNS = "doc_id long, key long, first binary, last binary, later_first binary, later_last binary"

_pack = lambda x: zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)
_unpack = lambda blob, kind: np.frombuffer(zstandard.decompress(blob), kind)


def _runs(places: np.ndarray) -> tuple[bytes, bytes]:
    """First and last of each run of consecutive numbers, as bytes."""
    if not len(places):
        return b"", b""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.r_[0, cut + 1]].astype("<i4").tobytes(), places[np.r_[cut, len(places) - 1]].astype("<i4").tobytes()


def _spread(first: bytes, last: bytes) -> np.ndarray:
    """The numbers in those runs."""
    a, b = ints(first, "<i4").astype(np.int64), ints(last, "<i4").astype(np.int64)
    size = b - a + 1
    return np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _send(named: list[tuple[int, int, np.ndarray]], batch: int, buckets: int) -> Iterator[dict]:
    """Rows for the buckets from the window names of some documents, held together.

    Of the names that several of these documents share, only those of the least doc_id are sent on; the others'
    places are known to be later ones here and now. So a name costs each batch one document's
    windows, however many documents hold it.
    """
    docs = sorted(named, key=lambda x: x[:2])
    ids, keys, counts = (np.array(x, np.int64) for x in zip(*((d, k, len(n)) for d, k, n in docs), strict=True))
    name, owner = np.concatenate([x[2] for x in docs]), np.repeat(np.arange(len(docs)), counts)
    _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
    own = ids[owner[first]][inverse] == ids[owner]
    later = np.flatnonzero(~own)
    shared = np.zeros(len(first), bool)
    shared[inverse[later]] = True
    here = np.flatnonzero(shared[inverse])
    yield {
        "bucket": int(batch % buckets),
        "batch": batch,
        "ids": _pack(np.r_[ids, keys]),
        "counts": _pack(counts),
        "steps": _pack(here),
        "name": _pack(~own[here]),
    }
    keep = np.flatnonzero(own)
    bucket = (name[keep] >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)):
        places = keep[order[edge[k] : edge[k + 1]]]
        held, many = np.unique(owner[places], return_counts=True)
        yield {
            "bucket": -1 - int(k),
            "batch": batch,
            "ids": _pack(np.diff(ids[held], prepend=0)),
            "counts": _pack(many),
            "steps": _pack(np.diff(places, prepend=0).astype("<u4")),
            "name": name[places].tobytes(),
        }


def _meet(got: pa.Table) -> pa.Table:
    """In one bucket: the places whose name occurs in several documents, back to their batches."""
    out = {k: [] for k in ("batch", "ids", "counts", "places", "later")}

    def put(*row) -> None:
        for k, x in zip(out, row, strict=True):
            out[k].append(x)

    ids, names, places, batches = [], [], [], []
    for bucket, batch, i, c, s, n in rows(got.to_batches()):
        if bucket >= 0:
            put(batch, i, c, s, n)
            continue
        ids.append(np.repeat(np.cumsum(_unpack(i, np.int64)), _unpack(c, np.int64)))
        places.append(np.cumsum(_unpack(s, "<u4"), dtype=np.int64))
        names.append(ints(n, np.uint64))
        batches.append((batch, len(places[-1])))
    if batches:
        name, doc = np.concatenate(names), np.concatenate(ids)
        order = np.argsort(name, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0])
        size = np.diff(np.r_[start, len(name)])
        low, high = np.minimum.reduceat(doc[order], start), np.maximum.reduceat(doc[order], start)
        least = np.empty(len(name), np.int64)
        shared = np.empty(len(name), bool)
        least[order], shared[order] = np.repeat(low, size), np.repeat(low != high, size)
        at = 0
        for (batch, n), place in zip(batches, places, strict=True):
            hit = np.flatnonzero(shared[at : at + n])
            if len(hit):
                put(batch, None, None, _pack(place[hit]), _pack(doc[at + hit] > least[at + hit]))
            at += n
    return pa.table(out, pa.schema([("batch", pa.int64()), *((k, pa.binary()) for k in ("ids", "counts", "places", "later"))]))


def _gather(got: pa.Table) -> pa.Table:
    """Of one batch: for each document with shared windows, the runs of their places, and of those that are later ones."""
    ids = keys = counts = None
    places, laters = [], []
    for _, i, c, p, f in rows(got.to_batches()):
        if i is not None:
            (ids, keys), counts = _unpack(i, np.int64).reshape(2, -1), _unpack(c, np.int64)
        places.append(_unpack(p, np.int64))
        laters.append(_unpack(f, bool))
    shared, later = np.zeros(counts.sum(), bool), np.zeros(counts.sum(), bool)
    for p, f in zip(places, laters, strict=True):
        shared[p] = True
        later[p] |= f
    out = {k: [] for k in ("doc_id", "key", "first", "last", "later_first", "later_last")}
    end = np.cumsum(counts)
    total = np.r_[0, np.cumsum(shared)]
    for k in np.flatnonzero(total[end] - total[end - counts]):
        part = slice(end[k] - counts[k], end[k])
        row = (int(ids[k]), int(keys[k]), *_runs(np.flatnonzero(shared[part])), *_runs(np.flatnonzero(later[part])))
        for key, x in zip(out, row, strict=True):
            out[key].append(x)
    return pa.table(out, pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), *((k, pa.binary()) for k in list(out)[2:])]))


def _shared_runs(source: DataFrame, read, buckets: int, label: str) -> DataFrame:
    """RUNS for each document with a window that another document has as well; read(row) gives its names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            found = list(_send(held, number, buckets))
            kinds = [("bucket", pa.int32()), ("batch", pa.int64()), *((k, pa.binary()) for k in ("ids", "counts", "steps", "name"))]
            for at in range(0, len(found), 64):
                yield pa.RecordBatch.from_pylist(found[at : at + 64], pa.schema(kinds))

        for row in rows(batches):
            names = read(row)
            if row[0] is None or not len(names):
                continue
            held.append((row[0], row[1], names))
            size += len(names)
            if size >= FLUSH:
                yield from out()
                held, size, number = [], 0, number + 1
        if held:
            yield from out()

    sent = source.mapInArrow(run, MOVED)
    key = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    met = sent.groupBy(key.alias("meeting")).applyInArrow(_meet, SHARED)
    return durable(met.groupBy("batch").applyInArrow(_gather, RUNS).dropDuplicates(["key"]), label)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): key is a hash of id and text, so that rows of one id keep their own places."""
    texts = id_text(docs, id_col, text_col)
    return texts.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its bytes, summed first, stay within BROADCAST_BYTES."""
    size = df.agg(*(F.sum(F.octet_length(c)) for c in df.columns if c not in ("doc_id", "key")), F.count("*") * 16).first()
    return F.broadcast(df) if sum(x or 0 for x in size) <= BROADCAST_BYTES else df


def level_lengths(window: int) -> list[int]:
    """Half of the window (rounded up), and the window: twice that length, with a word in common if it is odd."""
    return [window] if window < 2 else [(window + 1) // 2, window]


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(key, first, last): the places where a window starts whose words also start in a document of a smaller doc_id.

    first and last hold the runs of such places as little-endian 32-bit numbers. Levels: stretches of half the window's length are
    named by their hash and met over all documents. Only where both halves of a window are stretches that several
    documents have is the window itself, of twice that length, a candidate; candidates alone are named and met at that level. So
    the later level's work follows what repeats, not the corpus. Windows are judged on the input. key is that of keyed(): rows of
    one doc_id are one holder, but each text has its own places; null ids and null texts hold none. Names are 64-bit hashes: n
    windows make n * n / 2^65 false meetings. bucket: names that one task meets, about; there are as many as the input asks for.
    """
    spark = docs.sparkSession
    texts = keyed(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A word takes four bytes at least on average, its space included; texts of shorter words make larger buckets.
    buckets = lambda names: max(parts, math.ceil(names / bucket))
    short, *longer = level_lengths(window)
    found = _shared_runs(texts, lambda row: window_names(word_codes(byte_words(row[2])), short), buckets(_bytes(texts) / 4), "level")
    if not longer:
        return found.where(F.octet_length("later_first") > 0).select(
            "key",
            F.col("later_first").alias("first"),
            F.col("later_last").alias("last"),
        )
    reach = window - short

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places whose window has both halves among the shared ones, and the windows' names."""
        for row in rows(batches, 64):
            at = _spread(row[3], row[4])
            both = at[np.isin(at + reach, at)]
            if len(both):
                name = window_names(word_codes(byte_words(row[2])), window, both)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [row[0]], "key": [row[1]], "at": [both.astype("<i4").tobytes()], "name": [name.tobytes()]},
                    pa.schema(CANDIDATES),
                )

    able = found.select("key", "first", "last")
    named = texts.join(_small(able), "key").select("doc_id", "key", "text", "first", "last").mapInArrow(candidates, NAMES)
    named = durable(named.dropDuplicates(["key"]), "names")
    held = named.agg(F.sum(F.octet_length("name") / 8)).first()[0] or 0
    again = _shared_runs(named, lambda row: ints(row[3], np.uint64), buckets(held), "level").where(F.octet_length("later_first") > 0)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of candidates as runs of words' places."""
        for key, at, first, last in rows(batches, 64):
            a, b = _runs(ints(at, "<i4")[_spread(first, last)])
            yield pa.RecordBatch.from_pydict(
                {"key": [key], "first": [a], "last": [b]},
                pa.schema([("key", pa.int64()), ("first", pa.binary()), ("last", pa.binary())]),
            )

    later = again.select("key", F.col("later_first").alias("first"), F.col("later_last").alias("last"))
    return named.select("key", "at").join(_small(later), "key").select("key", "at", "first", "last").mapInArrow(
        placed,
        "key long, first binary, last binary",
    )


def drop_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): whole texts without the words that repeated windows cover.

    One row for each row of docs. Null and empty texts have no words and keep an empty text. Words stay unchanged, joined by
    one space.
    """
    spans = durable(repeated_spans(docs, window, id_col, text_col), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": []}
            for doc_id, text, first, last in rows([batch]):
                words = byte_words(text)
                n, gone = len(words), 0
                if first:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, ints(first, "<i4"), 1)
                    np.add.at(edge, ints(last, "<i4").astype(np.int64) + window, -1)
                    stays = np.cumsum(edge)[:n] == 0
                    words = [words[k] for k in np.flatnonzero(stays)]
                    gone = n - len(words)
                for k, x in zip(out, (doc_id, n, gone, b" ".join(words)), strict=True):
                    out[k].append(x)
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]),
            )

    joined = keyed(docs, id_col, text_col).join(_small(spans), "key", "left").select("doc_id", "text", "first", "last")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as text, on whole tables: the first doc_id of each, and the words that later ones cover.
OP9_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS x FROM s),
f AS (SELECT x, min(doc_id) AS least FROM h GROUP BY x),
c AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS p FROM h JOIN f ON h.x = f.x WHERE h.doc_id > f.least),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF NOT coalesce(list_contains(gone, p), false)], ' ')) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""
