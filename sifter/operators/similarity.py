"""Similarity of findings: blocked candidate pairs, scored by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.config import CompressionSettings
from sifter.functions.scalars import jaccard, severity_weight

#: Words that say nothing about a finding.
STOPWORDS = (
    "column",
    "columns",
    "feature",
    "features",
    "value",
    "values",
    "detected",
    "relationship",
    "community",
    "group",
    "related",
    "systematic",
    "finding",
    "findings",
    "synthetic",
    "integrity",
)
#: Weights of the three kinds of similarity and of their parts, and the cut for unrelated families.
KINDS = {"structural": 0.40, "statistical": 0.35, "semantic": 0.25}
PARTS = {
    "structural": {"column_overlap": 0.35, "row_overlap": 0.10, "metadata": 0.15, "same_module": 0.10, "same_family": 0.30},
    "statistical": {"numeric_evidence": 0.75, "severity": 0.15, "confidence": 0.10},
    "semantic": {"prefix": 0.40, "token_overlap": 0.35, "domain_terms": 0.25},
}
APART, REASON = 0.15, 0.20
#: Evidence that is compared as numbers, besides correlation_coefficient; the last three are entries of the evidence map.
NUMERIC = ("p_value", "mutual_information_score", "vif", "missing_ratio", "missingness_correlation")
MAPPED = ("duplicate_ratio", "dominance_ratio", "health_score")


def words(text: Column) -> Column:
    return F.array_except(
        F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= 3)),
        F.array(*map(F.lit, STOPWORDS)),
    )


def tokens(title: Column, columns: Column) -> Column:
    return F.array_sort(words(F.concat_ws(" ", title, F.array_join(columns, " "))))


def family(columns: Column) -> Column:
    """The commonest name prefix, the first on a tie, if at least half of the columns (rounded down, one at least) have it; else null."""
    lower = F.transform(columns, lambda c: F.lower(c))
    known = lambda c: F.regexp_extract(c, r"^(neighbor\d+|neighbor|serving|target)", 1)
    first = lambda c: F.split(c, "_")[0]
    prefix = F.filter(
        F.transform(
            lower,
            lambda c: F.when(known(c) != "", known(c)).when(F.contains(c, F.lit("_")) & (F.length(first(c)) > 2), first(c)),
        ),
        lambda x: x.isNotNull(),
    )
    counted = F.transform(
        F.array_distinct(prefix),
        lambda p: F.struct(
            F.size(F.filter(prefix, lambda x: x == p)).alias("n"),
            (-F.array_position(prefix, p)).alias("at"),
            p.alias("p"),
        ),
    )
    top = F.array_max(counted)
    return F.when(F.size(prefix) > 0, F.when(top["n"] >= F.greatest(F.lit(1), F.floor(F.size(columns) / 2)), top["p"]))


def relative(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def correlation_likeness(a: Column, b: Column) -> Column:
    size = 1 - F.least(F.abs(F.abs(a) - F.abs(b)), F.lit(1.0))
    return size * F.when((a == 0) | (b == 0) | (F.signum(a) == F.signum(b)), 1.0).otherwise(0.2)


def described(findings: DataFrame) -> DataFrame:
    """findings with what pairs are scored on: tokens, family, numbers of the evidence map."""
    numbers = {k: F.try_element_at("evidence", F.lit(k)).try_cast("double") for k in MAPPED}
    numbers = {k: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x) for k, x in numbers.items()}
    return findings.withColumns(
        {"tokens": tokens(F.col("title"), F.col("affected_columns")), "family": family(F.col("affected_columns")), **numbers},
    )


def metadata_likeness(a, b) -> Column:
    """Mean likeness of what both findings say about themselves: category, impact and anomaly strength."""
    numbers = F.array_compact(
        F.array(*(F.when(a(c).isNotNull() & b(c).isNotNull(), relative(a(c), b(c))) for c in ("impact", "anomaly_strength"))),
    )
    same = F.when(a("category") == b("category"), 1.0).otherwise(0.0)
    return (same + F.aggregate(numbers, F.lit(0.0), lambda x, y: x + y)) / (1 + F.size(numbers))


def candidate_pairs(findings: DataFrame, s: CompressionSettings) -> DataFrame:
    """(left, right): ids of findings that share a column, family, term or category whose bucket has 2 to max_bucket findings.

    An equi-join on exploded keys, not a comparison of all with all. If no bucket gives a pair and there are no more than
    max_bucket findings, all pairs. Buckets over max_bucket are passed over: findings that share nothing but such a
    common key are not compared, by design of the budget; raise max_bucket to compare them.
    """
    key = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(kind), v))
    own = F.when(F.col("family").isNotNull(), F.array(F.concat(F.lit("f:"), F.col("family")))).otherwise(F.array().cast("array<string>"))
    kind = F.array(F.concat(F.lit("k:"), F.col("category")))
    keys = F.array_distinct(F.concat(key("c:", F.col("affected_columns")), key("t:", F.col("tokens")), own, kind))
    long = findings.select("id", F.explode(keys).alias("key"))
    fit = long.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, s.max_bucket)).select("key")
    kept = long.join(fit, "key", "left_semi")
    pairs = kept.select("key", F.col("id").alias("left")).join(
        kept.select("key", F.col("id").alias("right")),
        "key",
    ).where("left < right").select("left", "right").distinct()
    if not pairs.limit(1).count() and findings.count() <= s.max_bucket:
        return findings.select(F.col("id").alias("left")).join(findings.select(F.col("id").alias("right")), F.col("left") < F.col("right"))
    return pairs


def scores(findings: DataFrame, s: CompressionSettings | None = None) -> DataFrame:
    """(left, right, weight, structural, statistical, semantic, reasons) of the candidate pairs."""
    s = s or CompressionSettings()
    full = described(findings)
    sides = [full.select(*(F.col(c).alias(f"{p}_{c}") for c in full.columns)) for p in ("l", "r")]
    pair = candidate_pairs(full, s).join(sides[0], F.col("left") == F.col("l_id")).join(sides[1], F.col("right") == F.col("r_id"))
    a, b = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    both = lambda c, f: F.when(a(c).isNotNull() & b(c).isNotNull(), f(a(c), b(c)))
    numbers = F.array_compact(
        F.array(both("correlation_coefficient", correlation_likeness), *(both(c, relative) for c in NUMERIC + MAPPED)),
    )
    mean = F.coalesce(F.try_divide(F.aggregate(numbers, F.lit(0.0), lambda x, y: x + y), F.size(numbers)), F.lit(0.0))
    same = lambda c: F.when(a(c) == b(c), 1.0).otherwise(0.0)
    none = F.array().cast("array<bigint>")
    token = jaccard(a("tokens"), b("tokens"))
    signals = {
        "column_overlap": jaccard(a("affected_columns"), b("affected_columns")),
        "row_overlap": jaccard(F.coalesce(a("affected_rows"), none), F.coalesce(b("affected_rows"), none)),
        "metadata": metadata_likeness(a, b),
        "same_module": same("module"),
        "same_family": same("family"),
        "numeric_evidence": mean,
        "severity": 1 - F.abs(severity_weight(a("severity")) - severity_weight(b("severity"))),
        "confidence": 1 - F.abs(a("confidence") - b("confidence")),
        "prefix": same("family"),
        "token_overlap": token,
        "domain_terms": token,
    }
    got = pair.select("left", "right", a("family").alias("lf"), b("family").alias("rf"), *(x.alias(k) for k, x in signals.items()))
    kinds = {k: sum(F.col(p) * w for p, w in parts.items()) / sum(parts.values()) for k, parts in PARTS.items()}
    total = sum(kinds[k] * w for k, w in KINDS.items())
    apart = F.col("lf").isNotNull() & F.col("rf").isNotNull() & (F.col("lf") != F.col("rf")) & (F.col("column_overlap") == 0)
    reasons = F.array_sort(F.array_compact(F.array(*(F.when(F.col(k) >= REASON, F.lit(k)) for k in signals))))
    return got.select(
        "left",
        "right",
        F.bround(F.when(apart, total * APART).otherwise(total), 4).alias("weight"),
        *(F.bround(x, 4).alias(k) for k, x in kinds.items()),
        reasons.alias("reasons"),
    )


def edges(findings: DataFrame, s: CompressionSettings | None = None) -> DataFrame:
    """Scored pairs at or over the edge threshold."""
    s = s or CompressionSettings()
    return scores(findings, s).where(F.col("weight") >= s.edge)
