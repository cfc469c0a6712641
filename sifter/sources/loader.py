"""Sources: files by suffix, JDBC, DataFrames; with a row cap of exactly n rows."""

from __future__ import annotations

import logging
import re
from pathlib import Path, PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.operators.profile import clean
from sifter.operators.sampling import row_sample

#: Suffixes and JDBC prefixes.
SUFFIXES = {
    ".csv": "csv",
    ".tsv": "tsv",
    ".xlsx": "excel",
    ".xls": "excel",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".orc": "orc",
}
POSTGRES = ("postgresql://", "postgres://", "postgresql+psycopg2://")
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)?$")


#: The column that holds a line which does not fit the others, while such lines are counted.
CORRUPT = "sifter corrupt line"
log = logging.getLogger(__name__)


class LoadError(Exception):
    """A source that can't be read."""


def source_type(source: str) -> str:
    if source.lower().startswith(POSTGRES):
        return "postgresql"
    kind = SUFFIXES.get(PurePosixPath(source.rstrip("/")).suffix.lower())
    if not kind:
        raise LoadError(f"unknown kind of source: {source}; known suffixes: {', '.join(SUFFIXES)}")
    return kind


def name_of(source: str) -> str:
    """The file's stem, or the database's name."""
    return (
        urlsplit(source).path.rstrip("/").rsplit("/", 1)[-1] if source_type(source) == "postgresql" else PurePosixPath(source.rstrip("/")).stem
    ) or "dataset"


def redacted(source: str) -> str:
    """The source without user and password."""
    return re.sub(r"//[^/@]*@", "//", source)


def jdbc_options(source: str, table_name: str | None, query: str | None) -> dict[str, str]:
    """Options of Spark's JDBC reader; a query goes before a table, whose name must be a plain identifier."""
    if not (table_name or query):
        raise LoadError("a database source needs table_name or query")
    if not query and not NAME.match(table_name):
        raise LoadError(f"not a table name: {table_name!r}")
    at = urlsplit(re.sub(r"^[a-z+0-9]+://", "postgresql://", source, flags=re.I))
    options = {
        "url": f"jdbc:postgresql://{at.hostname}:{at.port or 5432}{at.path}",
        "driver": "org.postgresql.Driver",
        **({"query": query} if query else {"dbtable": table_name}),
    }
    return options | ({"user": at.username} if at.username else {}) | ({"password": at.password} if at.password else {})


def read(spark: SparkSession, source: str, *, table_name: str | None = None, query: str | None = None, **options) -> DataFrame:
    """The source as a lazy DataFrame. A .tsv file is split at tabs unless sep says otherwise."""
    kind = source_type(source)
    try:
        if kind in ("csv", "tsv"):
            return spark.read.options(**_delimited(kind, options)).csv(source)
        if kind == "postgresql":
            return _jdbc(spark, jdbc_options(source, table_name, query), dict(options))
        if kind == "excel":
            return _excel(spark, source, **options)
        return spark.read.options(**options).format(kind).load(source)
    except LoadError:
        raise
    except Exception as problem:
        raise LoadError(f"{redacted(source)}: {problem}") from problem


def _jdbc(spark: SparkSession, options: dict, more: dict) -> DataFrame:
    """A table read by one task, or, with partition_column, by `partitions` tasks between that column's least and greatest value.

    A query can't be cut by Spark's reader itself, so it becomes a derived table. Bounds that aren't given are asked of the database.
    """
    column, parts = more.pop("partition_column", None), int(more.pop("partitions", 16))
    low, high = more.pop("lower_bound", None), more.pop("upper_bound", None)
    if not column:
        return spark.read.format("jdbc").options(**(options | more)).load()
    if not NAME.match(column):
        raise LoadError(f"not a column name: {column!r}")
    if "query" in options:
        options = {k: v for k, v in options.items() if k != "query"} | {"dbtable": f"({options['query']}) as sifter_source"}
    if low is None or high is None:
        asked = {k: v for k, v in options.items() if k != "dbtable"} | {
            "query": f"select min({column}) as low, max({column}) as high from {options['dbtable']}"
        }
        low, high = spark.read.format("jdbc").options(**asked).load().first()
    if low is None:  # no rows, or no value to cut at
        return spark.read.format("jdbc").options(**(options | more)).load()
    cut = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**(options | cut | more)).load()


#: Known data sets and the names their files go by.
KNOWN_SETS = {
    "Titanic": ("titanic.csv", "titanic.xlsx"),
    "Adult Income": ("adult.csv", "adult_income.csv"),
    "UNSW-NB15": ("unsw_nb15.csv", "UNSW-NB15.csv"),
    "CICIDS2017": ("cicids2017.csv", "CICIDS2017.csv"),
    "V2X": ("v2x.csv", "V2X.csv"),
}


def local_set(name: str, folders: list[str]) -> str | None:
    """The path of a known data set below the folders of the driver's machine: the first folder and file name that has one."""
    for folder in folders:
        for file in KNOWN_SETS.get(name, ()):
            found = sorted(Path(folder).rglob(file))
            if found:
                return str(found[0])
    return None


def local_sets(folders: list[str]) -> list[str]:
    """Paths of all known data sets below the folders."""
    return [path for name in KNOWN_SETS if folders and (path := local_set(name, folders))]


def _excel(spark: SparkSession, source: str, **options) -> DataFrame:
    """One sheet, read on the driver; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as absent:
        raise LoadError("reading Excel files needs openpyxl; save the sheet as CSV or Parquet") from absent
    import pandas as pd

    if source.lower().endswith(".xls"):
        raise LoadError("the old .xls format isn't supported; save the sheet as .xlsx")
    return spark.createDataFrame(pd.read_excel(source, engine="openpyxl", **options))


def _delimited(kind: str, options: dict) -> dict:
    return {"header": True, "inferSchema": True, "mode": "PERMISSIVE"} | ({"sep": "\t"} if kind == "tsv" else {}) | options


def with_corrupt(spark: SparkSession, source: str, **options) -> DataFrame | None:
    """A CSV or TSV source with CORRUPT, the whole line where it has more or fewer fields than the header, or a value that is not of
    its column's type; null elsewhere. None for other sources, and where the caller chose a mode or a schema of their own."""
    kind = source_type(source)
    if kind not in ("csv", "tsv") or {"mode", "schema", "columnNameOfCorruptRecord"} & options.keys():
        return None
    said = _delimited(kind, options)
    schema = spark.read.options(**said).csv(source).schema
    held = said | {"columnNameOfCorruptRecord": CORRUPT, "inferSchema": False, "columnPruning": False}
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).options(**held).csv(source)


def malformed(spark: SparkSession, source: str, **options) -> DataFrame:
    """(file, lines, corrupt, example, digest): for each file of a CSV or TSV source its lines but for the header, those that do not fit, one
    of them, and a digest of all fields in any order. No rows for other sources."""
    df = with_corrupt(spark, source, **options)
    if df is None:
        return spark.createDataFrame([], "file string, lines long, corrupt long, example string, digest long")
    # The digest asks for every field: a reader that leaves columns out doesn't count fields.
    every = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    whole = df.select(F.col("_metadata.file_path").alias("file"), F.col(f"`{CORRUPT}`").alias("line"), every.alias("h"))
    return whole.groupBy("file").agg(F.count("*").alias("lines"), F.count("line").alias("corrupt"), F.min("line").alias("example"), F.bit_xor("h").alias("digest"))


def load(spark: SparkSession, source: str, max_rows: int, seed: int = 42, **options) -> tuple[DataFrame, dict]:
    """(data, metadata): NaN as null, and exactly max_rows rows if the source has more, drawn row by row, the same ones every time.

    Lines of a CSV or TSV file that do not fit are counted in the same pass as the rows, logged, and named in the metadata
    (malformed_rows); what they hold stays in the data as far as it can be read.
    """
    try:
        counted = malformed(spark, source, **options).agg(F.sum("lines"), F.sum("corrupt"), F.min("example"), F.bit_xor("digest")).first()
    except LoadError:
        raise
    except Exception as problem:
        raise LoadError(f"{redacted(source)}: {problem}") from problem
    df = clean(read(spark, source, **options))
    n = df.count() if counted[0] is None else counted[0]
    meta = {"original_rows": n, "sampled": n > max_rows, "source": redacted(source), "malformed_rows": counted[1] or 0}
    if counted[1]:
        meta["malformed_example"] = counted[2][:200]
        log.warning("%s: %d of %d lines do not fit the header; one is %r", redacted(source), counted[1], n, counted[2][:200])
    return (row_sample(df, max_rows, seed, n) if meta["sampled"] else df), meta
