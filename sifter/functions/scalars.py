"""Scalar expressions shared by the detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severities by urgency, with their weights.
SEVERITIES = ("critical", "high", "medium", "low", "info")
WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2, "info": 0.0}
NUMBER = r"^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"
DATE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info."""
    out = F.lit(len(SEVERITIES))
    for k, name in enumerate(SEVERITIES):
        out = F.when(severity == name, F.lit(k)).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def severity_by_ratio(ratio: Column, cuts: tuple[float, ...]) -> Column:
    """The first of critical, high, medium, low whose cut the ratio reaches; else info."""
    out = F.lit("info")
    for name, cut in reversed(list(zip(SEVERITIES, cuts, strict=False))):
        out = F.when(ratio >= cut, F.lit(name)).otherwise(out)
    return out


def severity_by_strength(strength: Column, high: float, critical: float) -> Column:
    """high from `critical` on, medium from `high` on, else low."""
    return F.when(strength >= critical, "high").when(strength >= high, "medium").otherwise("low")


def severity_by_score(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 50, "medium").when(score >= 30, "low").otherwise("info")


def finite(value: Column) -> Column:
    """value as double, null where it is NaN or infinite."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_number_text(value: Column) -> Column:
    """Whether text parses as a number; a guard is needed as a cast also takes forms such as '1d'."""
    return F.lower(F.trim(value)).rlike(NUMBER)


def value_type(value: Column) -> Column:
    """numeric, empty, boolean, datetime or string, of a value as text."""
    text = F.trim(value)
    return F.when(text == "", "empty").when(is_number_text(text), "numeric").when(
        F.lower(text).isin("true", "false", "yes", "no"),
        "boolean",
    ).when(text.rlike(DATE), "datetime").otherwise("string")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 12 hex digits of the SHA-1 of the parts as JSON."""
    made = F.to_json(F.struct(*(p.alias(f"p{k}") for k, p in enumerate(parts))))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(made.cast("binary")), 1, 12))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType | T.BooleanType)


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def is_scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.BinaryType | T.VariantType)
