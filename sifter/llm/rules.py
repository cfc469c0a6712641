"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sifter.llm.common import byte_words, id_text, rows, table

#: Largest share of a text's word characters inside repeated n-grams, by n. 2 to 4: in the most frequent one.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: 5 to 10: inside n-grams that occurred before.
DUP_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that equal an earlier line, and of those in such lines or any n-gram of DUP_SHARE.
LINE_SHARE, COVER_SHARE = 0.30, 0.20
#: A share counts from so many repeats on, or if one repeat is a stretch of so many words: a short sentence said twice is a tenth of a
#: short text, but no repetition; a passage said twice is.
REPEATS, PASSAGE = 2, 20
MIN_WORDS, MAX_REPEAT, BASE = 50, 50, np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = re.compile(rb"[#*$%&|<>]")
_LOW = bytes(range(0x80, 0xC0))


def _codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)


def _covered(n: int, start: np.ndarray, total: int) -> np.ndarray:
    """Which words lie in windows of n words from those starts."""
    edge = np.zeros(total + 1, np.int64)
    edge[start] += 1
    edge[start + n] -= 1
    return np.cumsum(edge)[:total] > 0


def _repeated(at: np.ndarray, source: np.ndarray, n: int) -> bool:
    """Whether the repeated n-grams at those places are REPEATS stretches or more, or one of PASSAGE words: a stretch is a run of places
    whose first occurrences run along with them."""
    by = np.argsort(at)
    at, source = at[by], source[by]
    ends = np.flatnonzero(np.r_[(np.diff(at) != 1) | (np.diff(source) != 1), True])
    return len(ends) >= REPEATS or int(np.diff(np.r_[-1, ends]).max()) + n - 1 >= PASSAGE


def repetition(words: list[bytes], chars: np.ndarray) -> tuple[int, dict[int, float], np.ndarray]:
    """Words in 3-word windows found twice or more; by n, the share of characters inside repeated n-grams if these
    are REPEATS repeats or a passage, else 0; and which words lie in n-grams of DUP_SHARE that occurred before.

    One rolling polynomial hash grows from n to n + 1 words, so each length costs a multiply-add and a sort.
    """
    total, n_words = max(1, int(chars.sum())), len(words)
    code = _codes(words) + np.uint64(1)
    code = (code ^ (code << np.uint64(29))) * BASE
    h, share, repeat, inside = code.copy(), {}, 0, np.zeros(n_words, bool)
    for n in range(2, 11):
        if n > n_words:
            break
        h = h[:-1] * BASE + (code[n - 1 :] ^ (code[n - 1 :] >> np.uint64(31)))
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        if new.all():
            share |= dict.fromkeys(range(n, 11), 0.0)
            break
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(h)])
        if n == 3:
            repeat = int(_covered(3, order[np.repeat(size, size) > 1], n_words).sum())
        if n in TOP_SHARE:
            top = int(np.argmax(size))
            at = order[first[top] : first[top] + size[top]]
            share[n] = float(chars[_covered(n, at, n_words)].sum()) / total if size[top] > REPEATS else 0.0
        else:
            again = order[~new]
            covered = _covered(n, again, n_words)
            inside |= covered
            many = _repeated(again, np.repeat(order[first], size)[~new], n)
            share[n] = float(chars[covered].sum()) / total if many else 0.0
    return repeat, share, inside


def measure(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_load, dup_line_share, cover_share).

    repeat_load: the largest share of repeated n-grams over its limit. cover_share: characters of words in n-grams that occurred before
    or in lines that equal an earlier one, each word once. Shares of fewer than REPEATS repeats, none a passage, are 0.
    """
    text = text or b""
    words = byte_words(text)
    chars = np.array([len(w) if w.isascii() else len(w.translate(None, _LOW)) for w in words], np.int64)
    seen: set[bytes] = set()
    lines, dup_lines, dup_chars, longest, at, again = 0, 0, 0, 0, 0, []
    for line in text.split(b"\n"):
        n = len(byte_words(line))
        if not n:
            continue
        lines += len(line)
        if line in seen:
            dup_lines, dup_chars, longest = dup_lines + 1, dup_chars + len(line), max(longest, n)
            again.append((at, at + n))
        seen.add(line)
        at += n
    repeat, share, inside = repetition(words, chars)
    for a, b in again:
        inside[a:b] = True
    limit = TOP_SHARE | DUP_SHARE
    load = max((share[n] / limit[n] for n in share), default=0.0)
    by_line = dup_lines >= REPEATS or longest >= PASSAGE
    many = by_line or any(share.get(n, 0.0) for n in DUP_SHARE)
    cover = float(chars[inside].sum()) / max(1, int(chars.sum())) if many else 0.0
    line_share = dup_chars / max(1, lines) if by_line else 0.0
    return len(words), int(chars.sum()), len(SYMBOLS.findall(text)), dup_lines, repeat, load, line_share, cover


def verdict(measured: tuple) -> tuple[bool, bool]:
    """(base_failed, kept)."""
    n_words, _, _, _, repeat, load, line_share, cover = measured
    failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT * n_words
    return failed, not failed and load <= 1 and line_share <= LINE_SHARE and cover <= COVER_SHARE


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts for each row of docs, from whole texts.

    Base: fewer than 50 words, or over half of the words in repeated 3-word windows. Then the share of characters inside
    the most frequent n-gram (n from 2 to 4), inside n-grams seen before (5 to 10), in repeated lines, and in any of the latter two
    is held against TOP_SHARE, DUP_SHARE, LINE_SHARE and COVER_SHARE. A single repeat of less than PASSAGE words counts for none of them. Null and blank
    texts have zero counts and fail the base; repeated rows and null ids are rows like any other.
    """
    names = [
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "repeat_load",
        "dup_line_share",
        "cover_share",
        "base_failed",
        "kept",
    ]
    kinds = [*[pa.int64()] * 6, *[pa.float64()] * 3, pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(doc_id, *(got := measure(text)), *verdict(got)) for doc_id, text in rows([batch])]
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    ddl = ", ".join(
        f"{n} {'long' if k == pa.int64() else 'double' if k == pa.float64() else 'boolean'}"
        for n, k in zip(names, kinds, strict=True)
    )
    return id_text(docs, id_col, text_col).mapInArrow(run, ddl)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
