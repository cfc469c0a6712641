"""Relationship detectors: correlation, mutual information, variance inflation, feature groups."""

from __future__ import annotations

from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.config import RelationshipSettings
from sifter.functions.scalars import is_numeric, severity_by_strength
from sifter.operators.findings import finding, none
from sifter.operators.graph import local_components
from sifter.operators.moments import mutual_information, p_value, pearson, spearman, vif
from sifter.operators.profile import DatasetProfile
from sifter.operators.sampling import row_sample

MODULE = "relationship"
PAIRS = "a string, b string, pearson double, spearman double, pearson_p double, spearman_p double, p_value double, mi double, n bigint"


def thresholds(s: RelationshipSettings) -> dict[str, Column]:
    """The cutoffs in force, for the evidence of each finding."""
    held = {
        "pearson": s.pearson,
        "spearman": s.spearman,
        "mutual_information": s.mutual_information,
        "redundancy": s.redundancy,
        "strong_group": s.strong,
        "community": s.community,
        "vif_very_high": s.vif[0],
        "vif_high": s.vif[1],
    }
    return {f"{k}_threshold": F.lit(v) for k, v in held.items()}


def numeric_columns(df: DataFrame, profile: DatasetProfile) -> list[str]:
    """Numeric and boolean columns that aren't constant."""
    return [f.name for f in df.schema if is_numeric(f.dataType) and (c := profile.column(f.name)) and c.unique_count > 1]


def target_column(df: DataFrame, s: RelationshipSettings, named: str | None = None) -> str | None:
    """The named target, or the first column with a target's name."""
    if named in df.columns:
        return named
    return next((c for c in df.columns if c.lower() in s.target_names), None)


def correlated_pairs(df: DataFrame, columns: list[str], s: RelationshipSettings, full: bool = False, n: int | None = None) -> list[dict]:
    """Pairs at or over a method's cutoff, with both coefficients, the one of larger size, and the least p of the tested ones.

    Each method's pairs are sorted by size; in the balanced profile the strongest `candidates` are kept. n is the
    pair-complete count that p rests on. n: df's rows, if known.
    """
    out: dict[tuple[str, str], dict] = {}
    for method, run, cut, rows in (("pearson", pearson, s.pearson, s.pearson_rows), ("spearman", spearman, s.spearman, s.spearman_rows)):
        held = df if full else row_sample(df.select(*(F.col(f"`{c}`") for c in columns)), rows, n=n)
        found = run(held, columns, s.min_rows).where(F.abs("r") >= cut).orderBy(F.desc(F.abs("r")), "a", "b")
        for r in (found if full else found.limit(s.candidates)).collect():
            a, b = sorted((r.a, r.b))
            one = out.setdefault(
                (a, b),
                {
                    "a": a,
                    "b": b,
                    "pearson": None,
                    "spearman": None,
                    "pearson_p": None,
                    "spearman_p": None,
                    "p_value": None,
                    "mi": None,
                    "n": r.n,
                },
            )
            one[method] = r.r
            p = one[f"{method}_p"] = p_value(r.r, r.n)
            one["p_value"] = p if one["p_value"] is None else min(p, one["p_value"])
            one["n"] = max(one["n"], r.n)
    return [out[k] for k in sorted(out)]


def strength(pair: dict) -> float:
    return max(abs(pair["pearson"] or 0.0), abs(pair["spearman"] or 0.0))


def pair_table(spark: SparkSession, pairs: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in PAIRS.split(", ")]
    return spark.createDataFrame([tuple(p.get(k) for k in names) for p in pairs], PAIRS)


def correlation_findings(spark: SparkSession, pairs: list[dict], s: RelationshipSettings) -> DataFrame:
    """A finding for each flagged pair: its coefficient is the one of larger size; p of 0.001 or less makes it certain."""
    got = pair_table(spark, [p for p in pairs if p["pearson"] is not None or p["spearman"] is not None])
    r = F.when(
        F.abs(F.coalesce("pearson", F.lit(0.0))) >= F.abs(F.coalesce("spearman", F.lit(0.0))),
        F.col("pearson"),
    ).otherwise(F.col("spearman"))
    got = got.withColumn("r", r).withColumn("method", F.when(F.col("r").eqNullSafe(F.col("pearson")), "pearson").otherwise("spearman"))
    high = min(0.98, s.pearson + 0.15)
    return finding(
        got,
        MODULE,
        "correlation",
        title=F.format_string("'%s' and '%s' correlate", F.col("a"), F.col("b")),
        description=F.format_string(
            "%s correlation of %s over %d rows",
            F.col("method"),
            F.bround("r", 4).cast("string"),
            F.col("n"),
        ),
        severity=severity_by_strength(F.abs("r"), s.pearson, high),
        confidence=F.when(F.col("p_value") <= 0.001, 1.0).otherwise(0.9),
        columns=F.array("a", "b"),
        recommendation="Check whether both columns are needed.",
        evidence={
            "correlation_coefficient": F.bround("r", 6),
            "p_value": F.col("p_value"),
            "pearson": F.bround("pearson", 6),
            "spearman": F.bround("spearman", 6),
            "pearson_p_value": F.col("pearson_p"),
            "spearman_p_value": F.col("spearman_p"),
            "rows": F.col("n"),
            "method": F.col("method"),
            **thresholds(s),
        },
        correlation_coefficient=F.col("r"),
        p_value=F.col("p_value"),
        mutual_information_score=F.col("mi"),
        impact=F.abs("r"),
    )


def shortlist(profile: DatasetProfile, columns: list[str], s: RelationshipSettings, full: bool = False) -> list[str]:
    """Columns for pairwise mutual information: by coverage, distinct values and name, downwards; as many as the pair budget allows."""
    by = sorted(columns, key=lambda c: (profile.column(c).filled, profile.column(c).unique_count, c), reverse=True)[: s.mi_columns]
    return by if full else by[: (1 + isqrt(1 + 8 * s.mi_pairs)) // 2]


def pairwise_information(
    df: DataFrame, profile: DatasetProfile, columns: list[str], s: RelationshipSettings, full: bool = False, n: int | None = None
) -> list[tuple[str, str, float]]:
    """(a, b, score) of pairs with a score of 0.20 or more; in the full profile the mean of both directions."""
    names = shortlist(profile, columns, s, full)
    pairs = [tuple(sorted(p)) for p in combinations(names, 2)]
    n = profile.row_count if n is None else n
    got = {(r.a, r.b): r.score for r in mutual_information(df, pairs, s.mi_rows, s.neighbours, min_rows=s.min_rows, n=n).collect()}
    if full:
        turned = mutual_information(df, [(b, a) for a, b in pairs], s.mi_rows, s.neighbours, min_rows=s.min_rows, n=n)
        back = {(r.b, r.a): r.score for r in turned.collect()}
        got = {p: (x + back[p]) / 2 for p, x in got.items()}
    return sorted((a, b, x) for (a, b), x in got.items() if x >= s.mutual_information)


def information_findings(
    spark: SparkSession,
    scores: list[tuple[str, str, float]],
    pairs: list[dict],
    s: RelationshipSettings,
) -> DataFrame:
    """A finding for each pair whose information no strong correlation explains."""
    known = {(p["a"], p["b"]) for p in pairs if strength(p) >= s.pearson}
    left = [x for x in scores if x[:2] not in known]
    if not left:
        return none(spark)
    got = spark.createDataFrame(left, "a string, b string, score double")
    return finding(
        got,
        MODULE,
        "mutual_information",
        title=F.format_string("'%s' and '%s' depend on each other nonlinearly", F.col("a"), F.col("b")),
        description=F.format_string("Mutual information of %s nats", F.bround("score", 4).cast("string")),
        severity=severity_by_strength(F.col("score"), 0.5, 1.0),
        confidence=F.lit(0.8),
        columns=F.array("a", "b"),
        recommendation="Plot the two columns.",
        evidence={"mutual_information_score": F.bround("score", 4), **thresholds(s)},
        mutual_information_score=F.col("score"),
        impact=F.least(F.lit(1.0), F.col("score")),
    )


def target_information(df: DataFrame, profile: DatasetProfile, target: str, columns: list[str], s: RelationshipSettings) -> DataFrame:
    """(a, b, n, score) of each feature with the target: a class if boolean, not numeric, or of ten values or fewer."""
    kind, unique = df.schema[target].dataType, profile.column(target).unique_count
    discrete = isinstance(kind, T.BooleanType) or not is_numeric(kind) or unique <= 10
    pairs = [(c, target) for c in columns if c != target]
    return mutual_information(df, pairs, s.mi_rows, s.neighbours, discrete, s.min_rows, profile.row_count)


def target_findings(df: DataFrame, profile: DatasetProfile, target: str, columns: list[str], s: RelationshipSettings) -> DataFrame:
    """One finding for the ten features that tell most about the target."""
    top = target_information(df, profile, target, columns, s).where(
        F.col("score") >= s.mutual_information,
    ).orderBy(F.desc("score"), "a").limit(10)
    got = top.agg(F.sort_array(F.collect_list(F.struct("score", "a")), asc=False).alias("best")).where(F.size("best") > 0)
    names = F.transform("best", lambda x: x["a"])
    return finding(
        got,
        MODULE,
        "target_information",
        title=F.format_string("%d feature(s) inform '%s'", F.size("best"), F.lit(target)),
        description=F.format_string("Strongest: %s", F.array_join(names, ", ")),
        severity=F.lit("medium"),
        confidence=F.lit(0.85),
        columns=F.concat(names, F.array(F.lit(target))),
        recommendation="Check the strongest for leakage.",
        evidence={"scores": F.to_json("best"), "target": F.lit(target), **thresholds(s)},
        mutual_information_score=F.col("best")[0]["score"],
        impact=F.lit(0.5),
    )


def vif_findings(df: DataFrame, columns: list[str], s: RelationshipSettings, full: bool = False, n: int | None = None) -> DataFrame:
    """A finding for each column of a variance inflation of 5 or more."""
    held = df if full else row_sample(df.select(*(F.col(f"`{c}`") for c in columns)), s.vif_rows, n=n)
    found = [x for x in vif(held, columns) if x[1] >= s.vif[1]]
    if not found:
        return none(df.sparkSession)
    got = df.sparkSession.createDataFrame(found, "name string, v double")
    return finding(
        got,
        MODULE,
        "multicollinearity",
        title=F.format_string("'%s' follows from other columns", F.col("name")),
        description=F.format_string("Variance inflation factor %s", F.bround("v", 2).cast("string")),
        severity=F.when(F.col("v") >= s.vif[0], "critical").otherwise("high"),
        confidence=F.lit(0.95),
        columns=F.array("name"),
        recommendation="Drop or combine collinear columns.",
        evidence={"vif": F.bround("v", 4), **thresholds(s)},
        vif=F.col("v"),
        impact=F.least(F.lit(1.0), F.col("v") / s.vif[0]),
    )


def feature_groups(pairs: list[dict], s: RelationshipSettings) -> list[tuple[str, list[str], list[dict]]]:
    """(kind, members, edges): components of the pairs at the cutoffs for redundant, strong and community groups."""
    out = []
    size = lambda p: max(strength(p), p["mi"] or 0.0)
    for kind, cut, least in (("redundant_features", s.redundancy, 2), ("strong_group", s.strong, 3), ("feature_community", s.community, 3)):
        edges = [p for p in pairs if size(p) >= cut]
        for g in local_components(sorted({c for p in edges for c in (p["a"], p["b"])}), [(p["a"], p["b"]) for p in edges]):
            if len(g) >= least:
                out.append((kind, g, [p for p in edges if p["a"] in g]))
    return out


def group_findings(spark: SparkSession, pairs: list[dict], n_columns: int, s: RelationshipSettings) -> DataFrame:
    rows = []
    for kind, g, edges in feature_groups(pairs, s):
        r = max((x for p in edges for x in (p["pearson"], p["spearman"]) if x is not None), key=abs, default=None)
        p, mi = min(
            (e["p_value"] for e in edges if e["p_value"] is not None),
            default=None,
        ), max((e["mi"] for e in edges if e["mi"] is not None), default=None)
        rows.append((kind, g, r, p, mi, len(g) / max(1, n_columns)))
    if not rows:
        return none(spark)
    got = spark.createDataFrame(rows, "kind string, names array<string>, r double, p double, mi double, impact double")
    made = finding(
        got,
        MODULE,
        "redundant_features",
        title=F.format_string("%s: %s", F.initcap(F.translate("kind", "_", " ")), F.array_join("names", ", ")),
        description=F.format_string("%d columns move together", F.size("names")),
        severity=F.when(F.col("kind") == "redundant_features", "high").otherwise("medium"),
        confidence=F.lit(0.9),
        columns=F.col("names"),
        recommendation="Keep a representative of the group.",
        evidence={
            "kind": F.col("kind"),
            "members": F.array_join("names", ","),
            "correlation_coefficient": F.bround("r", 6),
            "p_value": F.col("p"),
            "mutual_information_score": F.bround("mi", 6),
            **thresholds(s),
        },
        correlation_coefficient=F.col("r"),
        p_value=F.col("p"),
        mutual_information_score=F.col("mi"),
        impact=F.col("impact"),
    )
    return made.withColumn("category", F.element_at("evidence", F.lit("kind")))
