"""Packing token streams into sequences of fixed capacity by multiway differencing."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import id_text, rows, table
from sifter.llm.differencing import difference

#: Remainders packed together, distinct chunks whose ids are remembered, bytes of ids sent at once.
GROUP, REMEMBERED, FLUSH = 1024, 1 << 19, 8 << 20
#: Of every CUT_EVERY remainders one is cut into halves, quarters and so on, down to LEAST_CUT: small parts even out the windows.
CUT_EVERY, LEAST_CUT = 4, 64
#: Fixed values of the public 50k byte-level vocabulary.
END, END_ID, STOP_ID = "<|endoftext|>", 50256, 1
_DOUBT = re.compile(r" (?!\S)")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """The ids that the tokenizers library gives for a byte-level BPE file, by its rank file and a chunk cache.

    In this vocabulary's pattern a single space before a non-space starts a new token, so a text cuts there
    without changing its ids. A text where some space is followed by white space or the end goes whole.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in _ENCODERS:
            import public_tokenizers

            _ENCODERS[name] = cls(public_tokenizers.path(name), public_tokenizers.PATTERN)
        return _ENCODERS[name]

    def _raw(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _DOUBT.search(text):
            return self._raw(text)
        chunks = text.split(" ")
        out = list(map(self.known.get, chunks))
        out[0] = self._raw(chunks[0])
        if None in out:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for k, x in enumerate(out):
                if x is None:
                    out[k] = self.known.get(chunks[k])
                    if out[k] is None:
                        out[k] = self._raw(" " + chunks[k])
                        if len(chunks[k]) <= 32:
                            self.known[chunks[k]] = out[k]
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; END is a token of its own, as in the library."""
        mark = np.array([END_ID], "<u4").tobytes()
        return mark.join(self._plain(x) if x else b"" for x in text.split(END))


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A window for each size (each at most capacity), and the number of windows: near-equal sums within capacity.

    Starts with as few windows as the sum allows. Whenever a sum exceeds the capacity the count rises, in growing
    steps; the steps passed over are then searched by halves for a smaller count that does.
    """
    low, step, best = max(1, -(-int(sizes.sum()) // capacity)), 1, None
    high = k = low
    while best is None or low < high:
        bins, sums = difference(sizes[:, None], k)
        if sums.max(initial=0) <= capacity:
            best, high = (bins[:, 0], k), k
        else:
            low = k + 1
        if best is None:
            k, step = min(k + step, max(len(sizes), k + 1)), step * 2
        else:
            k = (low + high) // 2
    return best


def cuts(n: int, small: bool) -> list[tuple[int, int]]:
    """(start, length) of the parts of a remainder of n ids: the whole, or halves of what is left while that is over LEAST_CUT."""
    out, at = [], 0
    while small and n - at > LEAST_CUT:
        out.append((at, (n - at + 1) // 2))
        at += out[-1][1]
    return [*out, (at, n - at)]


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """Pieces of token streams laid gapless into sequences of at most capacity ids.

    A document's stream is its ids, then STOP_ID; a null text counts as empty. Each full stretch of capacity ids
    is a sequence; the remainders of up to GROUP documents of a partition, some of them cut, are divided by differencing
    into windows of near-equal sums. Every id lies in one piece. Columns: doc_id, start, length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id (unique, not gapless), offset. Repeated and null ids are rows of their own.
    There is no shuffle: a lost task is packed again from the same rows.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, stop = Encoder.of(ranks), np.array([STOP_ID], "<u4").tobytes()
        number, size = TaskContext.get().partitionId() << 36, 0
        out: list[tuple] = []
        rest: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        def close() -> None:
            nonlocal number
            parts = [
                (doc_id, start + at, ids[4 * at : 4 * (at + n)], total)
                for k, (doc_id, start, ids, total) in enumerate(rest)
                for at, n in cuts(len(ids) // 4, k % CUT_EVERY == 0)
            ]
            bins, k = windows(np.array([len(x[2]) // 4 for x in parts], np.int64), capacity)
            offset = [0] * k
            for (doc_id, start, ids, total), b in zip(parts, bins.tolist(), strict=True):
                out.append((doc_id, start, len(ids) // 4, ids, total, number + b, offset[b]))
                offset[b] += len(ids) // 4
            number += k
            rest.clear()

        for doc_id, text in rows(batches, 64):
            ids = encoder.ids(text.decode("utf-8", "replace") if text else "") + stop
            total = len(ids) // 4
            full = total - total % capacity
            for at in range(0, full, capacity):
                out.append((doc_id, at, capacity, ids[4 * at : 4 * (at + capacity)], total, number, 0))
                number += 1
            if full < total:
                rest.append((doc_id, full, ids[4 * full :], total))
            size += len(ids)
            if len(rest) >= GROUP:
                close()
            if size > FLUSH and out:
                yield flush()
                size = 0
        if rest:
            close()
        while out:
            yield flush()

    return id_text(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
