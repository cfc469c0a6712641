"""The profile: one pass over the values, from which most detectors work."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.functions.scalars import is_datetime, is_numeric, is_scalar

LONG_TEXT = 64
TABLE = (
    "ordinal int, name string, dtype string, row_count bigint, null_count bigint, unique_count bigint, top_value string, top_count bigint,"
    " is_numeric boolean, is_text boolean, is_categorical boolean, is_datetime boolean, is_boolean boolean"
)


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null, once, so that later counts and statistics agree on what is missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def value_key(column: Column, kind: T.DataType) -> Column:
    """A value as text that is equal for equal values; long texts as a digest, so that they aren't shuffled."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return (column + F.lit(0.0)).cast("string")
    if isinstance(kind, T.StringType):
        return F.when(F.length(column) > LONG_TEXT, F.sha2(column, 256)).otherwise(column)
    if is_scalar(kind):
        return column.cast("string")
    return F.sha2(F.to_json(F.struct(column.alias("v"))), 256)


def value_cells(df: DataFrame) -> DataFrame:
    """(ordinal, value): a row for each value of each column; null is a value."""
    cells = F.array(
        *(
            F.struct(F.lit(k).alias("ordinal"), value_key(F.col(f"`{f.name}`"), f.dataType).alias("value"))
            for k, f in enumerate(df.schema)
        ),
    )
    return df.select(F.inline(cells))


def value_counts(df: DataFrame) -> DataFrame:
    """(column, ordinal, value, n): how often each value of each column occurs; null is a value.

    One unpivot and one aggregation with partial sums, whatever the number of columns: a frequent value costs each
    task one row.
    """
    return value_cells(df).groupBy("ordinal", "value").agg(F.count("*").alias("n"))


def profile_table(df: DataFrame) -> DataFrame:
    """One row for each column: name, dtype, row_count, null_count, unique_count, top_value, top_count and type flags."""
    counts = value_counts(df).groupBy("ordinal").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.max(F.when(F.col("value").isNotNull(), F.struct(F.col("n"), F.col("value")))).alias("top"),
    )
    names = df.sparkSession.createDataFrame(
        [
            (
                k,
                f.name,
                f.dataType.simpleString(),
                is_numeric(f.dataType),
                isinstance(f.dataType, T.StringType),
                is_datetime(f.dataType),
                isinstance(f.dataType, T.BooleanType),
            )
            for k, f in enumerate(df.schema)
        ],
        "ordinal int, name string, dtype string, is_numeric boolean, is_text boolean, is_datetime boolean, is_boolean boolean",
    )
    got = names.join(counts, "ordinal", "left")
    n, unique = (F.coalesce(F.col(c), F.lit(0)) for c in ("row_count", "unique_count"))
    categorical = (F.col("is_text") & ~F.col("is_datetime")) | (F.col("is_numeric") & (unique < 20) & (n > 100))
    return got.select(
        "ordinal",
        "name",
        "dtype",
        n.alias("row_count"),
        F.coalesce("null_count", F.lit(0)).alias("null_count"),
        unique.alias("unique_count"),
        F.col("top.value").alias("top_value"),
        F.coalesce("top.n", F.lit(0)).alias("top_count"),
        "is_numeric",
        "is_text",
        categorical.alias("is_categorical"),
        "is_datetime",
        "is_boolean",
    )


@dataclass
class ColumnProfile:
    ordinal: int
    name: str
    dtype: str
    row_count: int
    null_count: int
    unique_count: int
    top_value: str | None
    top_count: int
    is_numeric: bool
    is_text: bool
    is_categorical: bool
    is_datetime: bool
    is_boolean: bool
    samples: list = field(default_factory=list)

    @property
    def null_ratio(self) -> float:
        return self.null_count / self.row_count if self.row_count else 0.0

    @property
    def filled(self) -> int:
        return self.row_count - self.null_count


@dataclass
class DatasetProfile:
    name: str
    source: str
    source_type: str
    columns: list[ColumnProfile]
    row_count: int
    duplicate_rows: int
    size_estimate: int
    metadata: dict = field(default_factory=dict)

    @property
    def has_missing(self) -> bool:
        return any(c.null_count for c in self.columns)

    @property
    def missing_ratio(self) -> float:
        cells = self.row_count * len(self.columns)
        return sum(c.null_count for c in self.columns) / cells if cells else 0.0

    def column(self, name: str) -> ColumnProfile | None:
        return next((c for c in self.columns if c.name == name), None)

    def names(self, flag: str) -> list[str]:
        return [c.name for c in self.columns if getattr(c, flag)]


def profile_frame(spark: SparkSession, p: DatasetProfile) -> DataFrame:
    """profile_table() again, as local rows, from a profile on the driver."""
    names = [f for f in ColumnProfile.__dataclass_fields__ if f != "samples"]
    return spark.createDataFrame([tuple(getattr(c, n) for n in names) for c in p.columns], TABLE)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicates): rows, and those beyond the first of each set of equal ones, nulls being equal.

    Rows meet by a 128-bit key of two hashes, pre-aggregated, not by their whole width.
    """
    keys = row_key(df)
    held = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys))).groupBy("k0", "k1").agg(F.count("*").alias("n"))
    return held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row; each cell goes with whether it is null, as a hash passes over nulls."""
    cells = [
        x
        for f in df.schema
        for c in [F.col(f"`{f.name}`")]
        for x in (c.isNull(), c if not isinstance(f.dataType, T.MapType | T.VariantType) else F.to_json(F.struct(c)))
    ]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *reversed(cells))


def profile(
    df: DataFrame,
    name: str = "dataframe",
    source: str = "dataframe",
    source_type: str = "dataframe",
    **metadata,
) -> DatasetProfile:
    """The profile on the driver: a row for each column, five sample values, duplicates.

    Samples come from the first rows Spark gives; columns that hold next to nothing there are sought for their own.
    """
    found = {r.ordinal: ColumnProfile(**r.asDict()) for r in profile_table(df).collect()}
    head = df.limit(200).collect()
    for k, c in found.items():
        c.samples = [r[k] for r in head if r[k] is not None][:5]
        if len(c.samples) < min(5, c.filled):
            x = F.col(f"`{c.name}`")
            c.samples = [r[0] for r in df.select(x).where(x.isNotNull()).limit(5).collect()]
    rows, duplicates = duplicate_rows(df).first() if df.columns else (df.count(), 0)
    for c in found.values():
        c.row_count = rows
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return DatasetProfile(name, source, source_type, [found[k] for k in sorted(found)], rows, duplicates, size, metadata)
