"""Findings: the schema every detector gives, and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.functions.scalars import SEVERITIES, severity_rank, severity_weight, stable_id

SCHEMA = (
    "id string, module string, category string, title string, description string, severity string, confidence double, "
    "recommendation string, affected_columns array<string>, affected_rows array<bigint>, impact double, anomaly_strength double, "
    "correlation_coefficient double, p_value double, mutual_information_score double, vif double, missing_ratio double, "
    "missingness_correlation double, evidence map<string,string>"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TITLE = 200


def finding(
    df: DataFrame,
    module: str,
    category: str,
    *,
    title: Column,
    description: Column,
    severity: Column,
    confidence: Column,
    columns: Column,
    recommendation: str,
    evidence: dict[str, Column],
    rows: Column | None = None,
    **measures: Column,
) -> DataFrame:
    """df's rows as findings. Titles are cut at 200 characters; the id is a hash of what the finding says."""
    get = lambda name: measures.get(name, F.lit(None)).cast("double")
    said = F.create_map(
        *(x for k in sorted(evidence) for x in (F.lit(k), evidence[k].cast("string"))),
    ) if evidence else F.create_map().cast("map<string,string>")
    base = df.select(
        F.lit(module).alias("module"), F.lit(category).alias("category"), F.substring(title, 1, TITLE).alias("title"), description.alias("description"), severity.alias("severity"),
        F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), confidence.cast("double")),
        ).alias("confidence"), F.lit(recommendation).alias("recommendation"), columns.cast("array<string>").alias("affected_columns"), (rows if rows is not None else F.lit(None)).cast("array<bigint>").alias("affected_rows"),
        *(get(x).alias(x) for x in NAMES[10:18]), said.alias("evidence"),
    )
    return base.select(stable_id("finding", *(F.col(c) for c in base.columns)).alias("id"), *base.columns)


def valid(df: DataFrame) -> DataFrame:
    """Only findings that keep to the schema's constraints."""
    return df.where(
        (F.length("title") >= 1) & (F.length("title") <= TITLE) & F.col("severity").isin(*SEVERITIES) & F.col("confidence").between(0, 1) & (
            F.length("description") >= 1
        ),
    )


def actionable(df: DataFrame) -> DataFrame:
    return df.where(F.col("severity").isin("critical", "high", "medium"))


def by_severity(df: DataFrame, *severities: str) -> DataFrame:
    return df.where(F.col("severity").isin(*severities))


def by_module(df: DataFrame, module: str) -> DataFrame:
    return df.where(F.col("module") == module)


def by_column(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.array_contains("affected_columns", column))


def histogram(df: DataFrame) -> DataFrame:
    """(severity, n) for every severity, zeros too."""
    names = df.sparkSession.createDataFrame([(k, s) for k, s in enumerate(SEVERITIES)], "rank int, severity string")
    return names.join(
        df.groupBy("severity").agg(F.count("*").alias("n")),
        "severity",
        "left",
    ).select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def ranked(df: DataFrame) -> DataFrame:
    """By urgency, then confidence; ties by id."""
    return df.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "id")


def strongest(df: DataFrame, limit: int) -> DataFrame:
    """The most urgent findings of a module, by severity, then impact and strength, then confidence."""
    strength = F.greatest(*(F.coalesce(F.abs(c), F.lit(0.0)) for c in ("correlation_coefficient", "mutual_information_score")))
    load = F.coalesce("impact", F.lit(0.0)) + strength + F.coalesce("anomaly_strength", F.lit(0.0))
    return df.orderBy(severity_rank(F.col("severity")), F.desc(load), F.desc("confidence"), "id").limit(limit)


def json_schema() -> dict:
    """A finding as a JSON Schema."""
    plain = {"string": "string", "double": "number", "bigint": "integer"}
    many = {"array<string>": "string", "array<bigint>": "integer"}
    kind = lambda k: {"type": [plain[k], "null"]} if k in plain else {"type": ["array", "null"], "items": {"type": many[k]}} if k in many else {
        "type": "object",
        "additionalProperties": {"type": ["string", "null"]},
    }
    properties = {name: kind(k) for name, k in (x.split(" ", 1) for x in SCHEMA.split(", "))}
    needed = ["id", "module", "category", "title", "description", "severity", "confidence"]
    properties |= {k: {"type": "string", "minLength": 1} for k in needed[:5]}
    properties["title"]["maxLength"] = TITLE
    properties["severity"] = {"enum": list(SEVERITIES)}
    properties["confidence"] = {"type": "number", "minimum": 0, "maximum": 1}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "title": "finding",
        "type": "object",
        "properties": properties,
        "required": needed,
    }


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


__all__ = [
    "SCHEMA",
    "actionable",
    "by_column",
    "by_module",
    "by_severity",
    "finding",
    "histogram",
    "none",
    "ranked",
    "severity_weight",
    "strongest",
    "valid",
]
