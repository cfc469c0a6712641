"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import durable, id_text, rows, table

#: Bytes of benchmark text in a block, that is, sent to the executors at once.
BLOCK_BYTES = 16 << 20
#: ASCII characters that end a word: all but letters, digits and what belongs to other scripts.
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def plain_words(text: bytes | str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    if not text:
        return []
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return text.lower().encode().translate(_TO_SPACE).split()


class Rolling:
    """Karp-Rabin hashes of all stretches of a token list, of any length, from sums of powers; blocked tokens are in no stretch."""

    _MODS, _BASES = ((1 << 31) - 1, (1 << 31) - 19), (911_382_323, 972_663_749)

    def __init__(self, tokens: np.ndarray, top: int):
        """top: at least the length of this list and of those it is compared with, so that their hashes are alike."""
        self.n, self.top, self.sums, self.powers = len(tokens), top, [], []
        for mod, base in zip(self._MODS, self._BASES, strict=True):
            power = np.ones(top + 1, np.int64)
            have = 1
            while have <= top:  # doubling: powers up to 2k from those up to k
                more = min(have, top + 1 - have)
                power[have : have + more] = power[:more] * (int(power[have - 1]) * base % mod) % mod
                have += more
            term = (tokens.astype(np.int64) + 1) % mod * power[: self.n] % mod
            self.sums.append(np.r_[0, np.cumsum(term)])
            self.powers.append(power)
        self.block(tokens < 0)

    def block(self, blocked: np.ndarray) -> None:
        self.held = np.r_[0, np.cumsum(blocked)]

    def stretches(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each stretch of that length without a blocked token."""
        if length > self.n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.held[length:] == self.held[:-length])
        out = np.zeros(len(at), np.uint64)
        for mod, sums, power in zip(self._MODS, self.sums, self.powers, strict=True):
            h = (sums[at + length] - sums[at]) % mod * power[self.top - at] % mod
            out = out << np.uint64(32) | h.astype(np.uint64)
        return at, out


def tiles(test: np.ndarray | list[int], doc: np.ndarray | list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling (Wise 1993): (start in test, start in doc, length) of non-overlapping equal stretches.

    Again and again the longest length is sought at which the two share an unmarked stretch (by halves: what is shared at a length
    is shared at any smaller one), and all stretches of that length are marked, from the first of the test on, each with the first
    of the document that is free. A pass costs a sort of the stretches, however many of them are equal; there are at
    most as many passes as different lengths. Tokens below 0 match nothing.
    """
    test, doc = np.asarray(test, np.int64), np.asarray(doc, np.int64)
    if least <= 0 or min(len(test), len(doc)) < least:
        return []
    top = max(len(test), len(doc))
    sides = Rolling(test, top), Rolling(doc, top)
    free = test >= 0, doc >= 0
    found: list[tuple[int, int, int]] = []

    def shared(length: int):
        (p, h), (q, g) = (s.stretches(length) for s in sides)
        both = np.isin(h, g)
        return (p[both], h[both], q, g) if both.any() else None

    longest = min(len(test), len(doc))
    while longest >= least and (got := shared(least)):
        low, high = least, longest  # something of length low is shared; got is what
        step = max(1, least)
        while low < high:
            middle = min(high, low + step) if step else (low + high + 1) // 2
            if now := shared(middle):
                low, got, step = middle, now, step * 2
            else:
                high, step = middle - 1, 0
        for p, q in _marked(*got, low, test, doc, free):
            found.append((p, q, low))
        for side, left in zip(sides, free, strict=True):
            side.block(~left)
        longest = low - 1 if low > least else 0
    return sorted(found)


def _marked(
    p: np.ndarray,
    h: np.ndarray,
    q: np.ndarray,
    g: np.ndarray,
    length: int,
    test: np.ndarray,
    doc: np.ndarray,
    free: tuple[np.ndarray, np.ndarray],
):
    """Pairs of equal stretches, first come first served; what they cover is no longer free."""
    order = np.argsort(g, kind="stable")
    q, g = q[order], g[order]
    low, high = np.searchsorted(g, h, "left").tolist(), np.searchsorted(g, h, "right").tolist()
    next_: dict[int, int] = {}
    for a, lo, hi in zip(p.tolist(), low, high, strict=True):
        if not (free[0][a] and free[0][a + length - 1]):
            continue
        k = next_.get(lo, lo)
        # A stretch of the document that is no longer free won't be again: each is passed over once.
        while k < hi and not (free[1][q[k]] and free[1][q[k] + length - 1]):
            k += 1
        next_[lo] = k
        if k < hi:
            b = int(q[k])
            if (test[a : a + length] == doc[b : b + length]).all():
                free[0][a : a + length] = free[1][b : b + length] = False
                yield a, b


class Index:
    """Seeds of a block of benchmark items: their stretches of `least` tokens."""

    def __init__(self, items: list[tuple[int, bytes]], least: int):
        self.least, self.word, self.items = least, {}, []
        for item_id, text in items:
            tokens = [self.word.setdefault(w, len(self.word)) for w in plain_words(text)]
            if len(tokens) >= least:
                self.items.append((item_id, np.array(tokens, np.int32)))
        hashes = [np.unique(self.codes(tokens.astype(np.int64), least)) for _, tokens in self.items]
        owner = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seed, self.owner = h[order], owner[order]

    @staticmethod
    def codes(tokens: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(max(0, len(tokens) - n + 1), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (tokens[k : k + len(h)] + 1).astype(np.uint64)
            h ^= h >> np.uint64(29)
        return h

    def matches(self, text: bytes | None) -> Iterator[tuple[int, int, float, int, list]]:
        """(item_id, item words, coverage, words in the longest tile, tiles) for each item that shares a seed with the text."""
        words = plain_words(text)
        tokens = np.fromiter((self.word.get(w, -1) for w in words), np.int64, len(words))
        n = self.least
        known = np.r_[0, np.cumsum(tokens >= 0)]
        at = np.flatnonzero(known[n:] - known[:-n] == n) if len(tokens) >= n else np.empty(0, np.int64)
        if not len(at):
            return
        h = self.codes(tokens, n)[at]
        low, high = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        # A row for each seed of the text and item that has it, items in order.
        which = self.owner[np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        place = np.repeat(at[hit], many)
        order = np.argsort(which, kind="stable")
        which, place = which[order], place[order]
        for k, places in zip(
            which[np.flatnonzero(np.diff(which, prepend=-1))],
            np.split(place, np.flatnonzero(np.diff(which)) + 1),
            strict=True,
        ) if len(which) else ():
            # Tiles hold seeds, so the rest of the document can't match: what lies between is one gap.
            keep = np.unique(places[:, None] + np.arange(n))
            gap = np.flatnonzero(np.r_[False, np.diff(keep) > 1])
            cut, real = np.insert(tokens[keep], gap, -1), np.insert(keep, gap, -1)
            item_id, item = self.items[k]
            found = tiles(item, cut, n)
            covered = sum(x for *_, x in found)
            yield item_id, len(item), covered / len(item), max((x for *_, x in found), default=0), [
                (p, int(real[q]), x) for p, q, x in found
            ]


def short_items(benchmark: DataFrame, least: int = 5, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id): items of fewer than `least` words, null and empty ones too, which contamination() does not seek."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    words = F.filter(F.split(plain, " "), lambda x: x != "")
    return benchmark.where(F.size(words) < least).select(F.col(item_col).cast("long").alias("item_id"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, item_words, coverage, longest, tiles) for each document and item whose words tiles cover by `coverage` or more.

    Words are lower-cased, without ASCII punctuation. Tiles are stretches of `least` words or more in any order, so
    a passage put in another order is caught. Items of fewer than `least` words say nothing about a text and are not sought;
    short_items() lists them. Benchmark items go to the executors in blocks of about block_bytes: a benchmark of one
    block costs one scan, a larger one a scan for each block, one after the other, whose rows are written before the next block is
    read. tiles: (word in item, word in document, words). Null and empty texts or items match nothing; repeated
    documents and items each count.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    pair = pa.list_(pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())]))
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("item_id", pa.int64()),
            ("item_words", pa.int64()),
            ("coverage", pa.float64()),
            ("longest", pa.int64()),
            ("tiles", pair),
        ],
    )
    ddl = (
        "doc_id long, item_id long, item_words long, coverage double, longest long, tiles "
        "array<struct<item_at:long,doc_at:long,words:long>>"
    )
    texts = id_text(docs, id_col, text_col)

    def matched(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, text in rows([batch], 64):
                    for item_id, n, share, longest, found in index.value.matches(text):
                        if share >= coverage:
                            tiled = [{"item_at": p, "doc_at": q, "words": m} for p, q, m in found]
                            out.append(
                                {
                                    "doc_id": doc_id,
                                    "item_id": item_id,
                                    "item_words": n,
                                    "coverage": share,
                                    "longest": longest,
                                    "tiles": tiled,
                                },
                            )
                if out:
                    yield pa.RecordBatch.from_pylist(out, kinds)

        return texts.mapInArrow(run, ddl)

    held = lambda block: spark.sparkContext.broadcast(Index([tuple(r) for r in block.sort("item_id").collect()], least))
    if blocks == 1:
        return matched(held(items))
    items = durable(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    parts = []
    for b in range(blocks):
        index = held(items.where(F.col("block") == b).drop("block"))
        parts.append(durable(matched(index), "hits"))
        index.destroy()
    return reduce(DataFrame.union, parts)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "item_words", "coverage", "longest", F.size("tiles").alias("n_tiles"))
