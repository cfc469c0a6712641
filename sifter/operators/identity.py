"""Where rows are: a stable identity for rows of files, from the reader itself, without a shuffle or a sort."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators.joins import spread_join
from sifter.operators.profile import row_key
from sifter.sources.shared import durable

#: What may stand between a file and a frame whose rows are the file's rows, each once.
NARROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation", "View"}
#: Names that places go by while a frame is worked on.
FILE, ROW = "sifter file", "sifter row"
BROADCAST_BYTES, FILE_BYTES = 32 << 20, 256


def placed(df: DataFrame) -> DataFrame | None:
    """df with FILE and ROW, the path and the row's place in that file, or None.

    None unless the source is one set of files whose reader numbers rows (Parquet) with nothing but projections and filters above
    it; over a join or a union a place could come twice. The places don't depend on how the files are cut into partitions.
    """
    todo, relations = [df._jdf.queryExecution().analyzed()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in NARROW:
            return None
        below = [node.children().apply(k) for k in range(node.children().size())]
        relations, todo = relations + (not below), todo + below
    if relations != 1:
        return None
    try:
        return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:  # the reader has no such columns
        return None


def row_numbers(at: DataFrame) -> DataFrame:
    """(FILE, first): what a file's rows are numbered from, so that places become row numbers from 0 over all files by path.

    at: placed(). A row for each file; rows that a filter left out at the end of a file have no numbers.
    """
    size = at.groupBy(FILE).agg((F.max(ROW) + 1).alias("size")).orderBy(FILE).collect()  # a row for each file, as the reader's own list
    first, rows = 0, []
    for file, n in size:
        rows.append((file, first))
        first += n
    got = at.sparkSession.createDataFrame(rows, f"`{FILE}` string, first long")
    return F.broadcast(got) if len(rows) * FILE_BYTES <= BROADCAST_BYTES else got


def duplicate_places(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """(row, first): the number of each row that repeats an earlier one in all columns, nulls being equal, and of the first of
    its kind; the `most` first of them. None if the rows have no places.

    Rows meet by two hashes, pre-aggregated; the many rows of one kind are not brought together, but told their first one.
    """
    at = placed(df)
    if at is None:
        return None
    k0, k1 = row_key(df)
    held = at.select(k0.alias("k0"), k1.alias("k1"), F.struct(FILE, ROW).alias("at"))
    kinds = durable(held.groupBy("k0", "k1").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"), "kinds")
    again = spread_join(held, kinds, ["k0", "k1"], "n").where("at <> first")
    if most is not None:
        again = again.orderBy("at").limit(most)
    numbers = row_numbers(at)
    named = lambda side: numbers.select(F.col(FILE).alias(f"{side}_file"), F.col("first").alias(f"{side}_from"))
    again = again.select(*(F.col(f"{s}.{FILE}").alias(f"{s}_file") for s in ("at", "first")), *(F.col(f"{s}.{ROW}").alias(f"{s}_row") for s in ("at", "first")))
    again = again.join(named("at"), "at_file").join(named("first"), "first_file")
    return again.select((F.col("at_from") + F.col("at_row")).alias("row"), (F.col("first_from") + F.col("first_row")).alias("first"))


def place_sample(df: DataFrame, rows: int, seed: int = 42, n: int | None = None) -> DataFrame | None:
    """Exactly `rows` rows of df (all, if there are no more), each as likely as any other; None if the rows have no places.

    Each row draws the hash of (seed, file, row) and the lowest draws stay: one narrow pass drops all but about `rows`
    rows where they lie, and the few too many go by a top-k, whose parts merge in any order. The sample is the same for any
    partitioning of the same files. n: the number of rows, if it is known.
    """
    at = placed(df)
    if at is None:
        return None
    n = df.count() if n is None else n
    if n <= rows:
        return df
    wanted = min(1.0, (rows + 8 * math.sqrt(rows) + 32) / n)
    cut = -(2**63) + min(2**64 - 1, math.ceil(wanted * 2**64))
    draw = F.xxhash64(F.lit(seed), FILE, ROW)
    low = at.withColumn("sifter draw", draw).where(F.col("sifter draw") <= F.lit(cut))
    return low.orderBy("sifter draw", FILE, ROW).limit(rows).select(*(F.col(f"`{c}`") for c in df.columns))
