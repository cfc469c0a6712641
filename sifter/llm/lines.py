"""Line dedup: later occurrences of three-line windows go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import durable, spread_join, table

#: Documents with covered lines up to which their line numbers may be broadcast if they also stay within BROADCAST_LINES.
BROADCAST_LINES = 1 << 20


def _key(id_col: str, text_col: str):
    """A row's key: rows of one id and one text count as one document."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def covered_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, gone): for each document with a later occurrence of a window, the numbers of the lines it covers.

    A window is `window` consecutive lines, told apart by their 64-bit hashes; windows of blank lines
    alone don't count. Its first occurrence is the one of least (doc_id, row_key, line); a null id comes before
    all. Overlapping windows' lines are merged. Texts of fewer lines have no window.
    """
    lines = F.split(F.col("text"), "\n", -1)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        _key(id_col, text_col).alias("row_key"),
        F.col(text_col).cast("string").alias("text"),
    )
    hashed = slim.where(F.size(lines) >= window).select(
        "doc_id",
        "row_key",
        F.transform(lines, lambda x: F.when(F.trim(x) != "", F.xxhash64(x))).alias("h"),
    )
    starts = F.sequence(F.lit(1), F.size("h") - (window - 1))
    # A blank line hashes as null, which xxhash64 passes over: its place is marked by a number of its own.
    one = lambda k, j: F.coalesce(F.element_at("h", (k + F.lit(j)).cast("int")), F.lit(j).cast("long"))
    named = F.transform(
        starts,
        lambda k: F.struct(
            (k - 1).alias("line"),
            F.xxhash64(*(one(k, j) for j in range(window))).alias("name"),
            F.coalesce(*(F.element_at("h", (k + F.lit(j)).cast("int")) for j in range(window))).isNotNull().alias("text"),
        ),
    )
    windows = hashed.select("doc_id", "row_key", F.explode(named).alias("w")).where("w.text").select(
        "doc_id",
        "row_key",
        F.col("w.line").alias("line"),
        F.col("w.name").alias("name"),
    )
    windows = durable(windows, "windows")
    at = F.struct("doc_id", "row_key", "line")
    least = windows.groupBy("name").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("places"))
    repeated = durable(least.where("first <> last").select("name", "first", "places"), "repeated")
    later = spread_join(windows, repeated, "name", "places").where(~at.eqNullSafe(F.col("first")))
    merged = later.groupBy("row_key").agg(F.collect_set("line").alias("starts"))
    return durable(
        merged.select(
            "row_key",
            F.array_distinct(F.flatten(F.transform("starts", lambda k: F.sequence(k, k + F.lit(window - 1))))).alias("gone"),
        ),
        "gone",
    )


def drop_repeated_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_removed, kept): for each row of docs, as a struct, its text without lines that later occurrences cover.

    A struct, so that no column of docs can clash. A null text has no lines and keeps null; kept lines stay in
    order, joined by a line feed; a text whose every line is covered becomes empty.
    """
    gone = covered_lines(docs, window, id_col, text_col)
    size = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_LINES else gone
    keyed = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        _key(id_col, text_col).alias("key"),
        F.col(text_col).cast("string").alias("body"),
    )
    lines = F.split("body", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stays, lambda k: F.element_at(lines, k + 1)), "\n")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    n_lines = F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return keyed.join(gone, F.col("key") == F.col("row_key"), "left").select(
        "row",
        n_lines.alias("n_lines"),
        removed.alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("kept"),
    )


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM e WHERE trim(ls[i] || ls[i + 1] || ls[i + 2]) <> ''),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM r WHERE k > 1) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT coalesce(list_contains(gone, i), false)], chr(10))) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id"""
