"""Shared pieces: durable tables, word splitting, window hashes, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.sources.shared import durable, release, shared_root

__all__ = [
    "byte_words",
    "durable",
    "id_text",
    "ints",
    "mixed",
    "release",
    "rows",
    "shared_root",
    "small",
    "small_batches",
    "spread_join",
    "table",
    "window_hashes",
    "window_names",
    "word_codes",
]
#: A key is hot if one in so many rows has it; so there are at most as many hot keys.
HOT_SHARE = 1000
#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(big: DataFrame, unique: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """big joined with unique on key, of which unique has one row each; weight: a column of unique, the rows of big with that key.

    Rows of hot keys, HOT_SHARE at most by what hot means, meet a broadcast table where they lie; the others are shuffled, and
    no key among those holds more than a share of 1 / HOT_SHARE of the rows. So no task depends on the largest key.
    Tables read twice should be written ones. The weight is dropped.
    """
    spark = big.sparkSession
    total = unique.agg(F.sum(weight)).first()[0] or 0
    bound = max(total // HOT_SHARE, 10_000)
    hot = unique.where(F.col(weight) > bound).collect() if total > bound else []  # fewer than HOT_SHARE rows
    plain = unique.drop(weight)
    if not hot:
        return big.join(plain, key, how)
    few = spark.createDataFrame(hot, unique.schema).drop(weight)
    rest = big.join(F.broadcast(few.select(key)), key, "left_anti").join(unique.where(F.col(weight) <= bound).drop(weight), key, how)
    return big.join(F.broadcast(few), key).unionByName(rest)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its rows, counted first, take BROADCAST_BYTES at most; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def byte_words(text: bytes | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ in UTF-8; bytes.split() cuts at just those six characters."""
    return text.split() if text else []


def window_hashes(words: list[bytes], n: int, seed: int, short: bool) -> np.ndarray:
    """Unsigned XXH64 of every run of n words joined by one space. With fewer words: of all of them if
    short, else none."""
    if not words or (len(words) < n and not short):
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    m = max(1, len(words) - n + 1)
    cuts = zip(start[:m].tolist(), (end[n - 1 :] if len(words) >= n else end[-1:]).tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in cuts]), ">u8").astype(np.uint64)


class WordCodes(dict):
    """XXH64 of each word, remembered for up to `most` distinct words."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_CODES = WordCodes()


def word_codes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word, by a memory that lasts as long as the worker."""
    return _CODES.of(words)


def window_names(codes: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit name of every run of n codes, or of those that start at the places `at`: a rolling polynomial of word hashes, mixed."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m if at is None else len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + m] if at is None else codes[at + k])
    return mixed(h, n)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A further 64-bit hash of each hash (the splitmix64 finaliser)."""
    x = h + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: whole texts are large, and a task holds a few batches. A setting of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, str(8 << 20))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, whatever else the table holds: doc_id, and text as bytes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def rows(batches: Iterable[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows as tuples, made into Python objects a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def ints(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind)
