"""Corpus pipeline over documents: quality, line dedup, near-dedup, decontamination, packing.

Each stage works on all rows its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import durable, small, table
from sifter.llm.decontaminate import contamination
from sifter.llm.lines import drop_repeated_lines
from sifter.llm.neardup import near_copies, row_key
from sifter.llm.packing import pack
from sifter.llm.quality import quality_scores, train
from sifter.sources.shared import drop_since, written

#: Near-duplicates: sets of five-word shingles with a Jaccard index of 0.8, sought by fingerprints of 4 x 64 bits.
SHINGLE, SIMILARITY, WIDTH = 5, 0.8, 4
#: Share of bits that differ, on average, at that index: of sets of 64 shingles or more, and of small ones (most at four shingles and five).
APART = ((64, 0.16), (4, 3 / 16))
#: 4.5 standard deviations above those averages; what is inside is compared exactly.
RADII = tuple((size, math.floor(64 * WIDTH * p + 4.5 * math.sqrt(64 * WIDTH * p * (1 - p)))) for size, p in APART)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.3 or more; null and empty texts score as one empty line."""
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")), keep=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of later occurrences of three-line windows; those that nothing is left of go.

    A text without such lines is left as it is, null and empty ones too.
    """
    got = drop_repeated_lines(docs).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    cut = F.col("n_removed") > 0
    own = {x.name: F.col("row")[x.name] for x in docs.schema}
    return got.select(
        *(
            F.when(
                cut,
                new[x.name].cast(x.dataType),
            ).otherwise(own[x.name]).alias(x.name) if x.name in new else own[x.name].alias(x.name)
            for x in docs.schema
        ),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links of Jaccard index 0.8 or more: of the document of its smallest doc_id.

    Rows are named by doc_id and text, so a row with a null doc_id goes for its own text alone; it stays only if its component
    has null ids alone. Of rows of one doc_id and one text, one stays.
    """
    gone, again = (small(x, 8) for x in near_copies(docs, SHINGLE, SIMILARITY, RADII, WIDTH))
    left = docs.join(gone, row_key(docs) == gone.key, "left_anti")
    if again.isEmpty():
        return left
    # A struct, so that no column of docs can clash; its fields come back in their order.
    held = left.join(again, row_key(left) == again.key, "left_semi").select(
        row_key(left).alias("key"),
        F.struct(*(left[c] for c in left.columns)).alias("row"),
    )
    once = held.groupBy("key").agg(F.first("row").alias("row")).select("row.*")
    return left.join(again, row_key(left) == again.key, "left_anti").union(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered by tiles to 0.8 or more. Rows are named by doc_id and text."""
    keyed = docs.select(row_key(docs).alias("key"), "text")
    hit = durable(
        contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="key").select(F.col("doc_id").alias("key")).distinct(),
        "hit",
    )
    hit = small(hit, 8)
    return docs.join(hit, row_key(docs) == hit.key, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    got = pack(docs)
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", packing),
]
#: SQL can't express a trained classifier, fingerprint components or tilings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote besides its result, and the result before it, are dropped once that is written."""
    docs, mark = table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_since(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
