"""Language identification: bit-sliced Bloom filters of character n-grams, one bit of a mask for each language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.llm.common import mixed, rows, small_batches, table

#: Documents of a language that its filter is learned from, at most; n-grams that the filter holds, at most.
TRAIN_DOCS, MOST_GRAMS = 1000, 50_000
#: Lengths of n-grams in letters; words are lower-cased and stand between single blanks, which count as letters.
LENGTHS = (3, 4)
#: An n-gram belongs to a language if this share of its documents has it, and this part of the largest share of any language.
LEAST_SHARE, LEAST_PART = 0.002, 0.1
#: Bits of a filter for each n-gram of the largest language, and hash functions: about one false positive in 120.
BITS, HASHES = 10, 4
#: Places of a text that are looked up at once.
STEP = 1 << 16
UNKNOWN = "und"
BLANK = 32


@cache
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a blank for what is no letter."""
    made = np.full(0x110000, BLANK, np.uint64)
    for k in range(0x110000):
        if chr(k).isalpha():
            made[k] = ord(chr(k).lower()[0])
    return made


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text with one blank between words, before and after; empty if it has no letter."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate([[np.uint64(BLANK)], x, [np.uint64(BLANK)]])
    x = x[np.r_[True, (x[1:] != BLANK) | (x[:-1] != BLANK)]]
    return x if len(x) > 1 else x[:0]


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit names of all n-grams of those letters, repeats included, some at a time."""
    for n in LENGTHS:
        for at in range(0, len(x) - n + 1, STEP):
            part = x[at : at + STEP + n - 1]
            h = np.zeros(len(part) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + part[k : k + len(h)]
            yield mixed(h, n)


@dataclass
class Filters:
    """Bloom filters of one size, sliced by place: slices[place] has a bit for each language whose filter has that place set."""

    langs: list[str]
    slices: np.ndarray  # places x 64-bit words of languages

    def masks(self, names: np.ndarray) -> np.ndarray:
        """For each n-gram, the languages whose filters hold it: the slices of its places, joined by `and`."""
        a, b = names & np.uint64(0xFFFFFFFF), (names >> np.uint64(32)) | np.uint64(1)
        got, size = None, np.uint64(len(self.slices))
        for k in range(HASHES):
            found = self.slices.take(((a + np.uint64(k) * b) % size).astype(np.int64), axis=0)
            got = found if got is None else got & found
        return got

    def add(self, lang: int, names: np.ndarray) -> None:
        a, b = names & np.uint64(0xFFFFFFFF), (names >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            self.slices[(a + np.uint64(k) * b) % np.uint64(len(self.slices)), lang // 64] |= np.uint64(1 << lang % 64)

    def false_rate(self) -> np.ndarray:
        """By language, the chance that an n-gram outside its filter is taken for one inside: the share of set places to the power of hashes."""
        return (popcounts(self.slices, len(self.langs)) / len(self.slices)) ** HASHES

    def guess(self, text: str | None, rate: np.ndarray) -> tuple[str, float]:
        """(language, its part of all languages' corrected counts): hits h of n n-grams count as (h - n * rate) / (1 - rate), 0 at least."""
        x = letters(text or "")
        if not len(x) or not self.langs:
            return UNKNOWN, 0.0
        hits, n = np.zeros(len(self.langs)), 0
        for names in grams(x):
            hits += popcounts(self.masks(names), len(self.langs))
            n += len(names)
        held = np.maximum(0.0, (hits - n * rate) / np.maximum(1e-9, 1 - rate))
        best = int(np.argmax(held))
        return self.langs[best], float(held[best] / max(held.sum(), 1e-300))


def popcounts(masks: np.ndarray, n: int) -> np.ndarray:
    """How many masks have each of the first n bits set."""
    got = np.empty(n, np.int64)
    for k in range(n):
        got[k] = np.count_nonzero(masks[:, k // 64] & np.uint64(1 << k % 64))
    return got


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(
    docs: DataFrame,
    train_docs: int = TRAIN_DOCS,
    most_grams: int = MOST_GRAMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Filters:
    """Filters learned from text and lang of documents whose crc32(id as text) mod 5 is not 0, whole texts.

    Of each language the train_docs ids of least hash; of rows of one id and language, one. An n-gram belongs to a language if LEAST_SHARE
    of its documents have it, and no language more than 1 / LEAST_PART times that share; of more than most_grams those that most
    documents have. Null ids, texts and languages are left out, as are texts without a letter. The languages are in the order
    of their documents' number, so that ties go to the more frequent one.
    """
    small_batches(docs.sparkSession)
    told = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).where("doc_id is not null and lang is not null")
    told = told.where(~_held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    # By a sketch of each language's ids, a hash that about twice train_docs of them stay under; only those are ordered. No text is read for this.
    many = told.groupBy("lang").agg(F.approx_count_distinct("h").alias("many"))
    under = F.lit(2.0**64) * (2.0 * train_docs / F.col("many")) - F.lit(2.0**63)
    ids = told.select("lang", "h").join(F.broadcast(many), "lang").where(F.col("h").cast("double") <= under).select("lang", "h").distinct()
    few = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= train_docs)
    last = F.broadcast(few.groupBy("lang").agg(F.max("h").alias("last")))  # a row for each language
    sample = told.join(last, "lang").where("h <= last and text is not null")
    sample = sample.groupBy("lang", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each language, as n-gram null, and those that have an n-gram."""
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in rows([batch]):
                own, x = seen.setdefault(lang, Counter()), letters(text)
                if len(x):
                    own[None] += 1
                    own.update(np.unique(np.concatenate(list(grams(x)))).view(np.int64).tolist())
            for lang, own in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own)), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())],
                    ["lang", "gram", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    size = {r.lang: r.n for r in counted.where("gram is null").collect()}  # a row for each language
    langs = sorted(size, key=lambda x: (-size[x], x))
    if not langs:
        return Filters([], np.zeros((64, 1), np.uint64))
    known = F.broadcast(docs.sparkSession.createDataFrame([(x, k, size[x]) for k, x in enumerate(langs)], "lang string, id int, docs long"))
    share = counted.where("gram is not null").join(known, "lang").select("id", "gram", "n", (F.col("n") / F.col("docs")).alias("share"))
    share = share.withColumn("top", F.max("share").over(Window.partitionBy("gram")))  # a row of each language at most
    share = share.where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_PART * F.col("top")))
    best = Window.partitionBy("id").orderBy(F.desc("n"), "gram")
    held = share.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most_grams).select("id", "gram").toArrow()
    ids_, names = held["id"].to_numpy(), held["gram"].to_numpy().view(np.uint64)
    places = max(64, BITS * int(np.bincount(ids_, minlength=1).max(initial=0)))
    made = Filters(langs, np.zeros((places, -(-len(langs) // 64)), np.uint64))
    for k in range(len(langs)):
        made.add(k, names[ids_ == k])
    return made


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, from whole texts alone, in one narrow pass.

    The filters, MOST_GRAMS * BITS places at most of a bit for each language, are sent to each executor once. A null text,
    or one without a letter, is `und` with score 0, as is every text if nothing was learned. A text none of whose n-grams is
    known gets the most frequent language, with score 0. held_out is false for a null id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    langs, sent = filters.langs, spark.sparkContext.broadcast(filters.slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(langs, sent.value)
        rate = own.false_rate()
        for batch in batches:
            said = [(doc_id, *own.guess(text, rate)) for doc_id, text in rows([batch])]
            columns = list(zip(*said, strict=True)) or [[], [], []]
            kinds = (pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "lang_pred", "score"],
            )

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = got.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
