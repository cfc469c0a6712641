"""Integrity detectors: each takes a DataFrame (or its profile table) and gives findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifter.config import IntegritySettings
from sifter.functions.scalars import SEVERITIES, is_number_text, severity_by_ratio, value_type
from sifter.operators.findings import finding, none
from sifter.operators.graph import local_components
from sifter.operators.moments import pearson
from sifter.operators.profile import duplicate_rows, row_key, value_counts
from sifter.operators.identity import duplicate_places
from sifter.operators.sampling import row_sample

MODULE = "integrity"
#: Points off a domain's score by severity, and the domains' weights.
POINTS = {"critical": 25.0, "high": 15.0, "medium": 8.0, "low": 3.0, "info": 1.0}
DOMAINS = {
    "missing_values": 0.25,
    "missingness_correlation": 0.25,
    "duplicate_rows": 0.15,
    "duplicate_features": 0.15,
    "constant_features": 0.10,
    "near_constant_features": 0.10,
    "datatype_integrity": 0.20,
    "identifier_integrity": 0.15,
    "cardinality": 0.15,
}


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _text(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def missing_ratios(profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """(name, null_count, row_count, ratio, severity) of every column with nulls, empty columns included."""
    ratio = _ratio(F.col("null_count"), F.col("row_count"))
    return profile.where("null_count > 0").select(
        "ordinal",
        "name",
        "null_count",
        "row_count",
        ratio.alias("ratio"),
        severity_by_ratio(ratio, s.missing).alias("severity"),
    )


def empty_columns(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """One critical finding that lists the columns with a null ratio of 0.99 or more."""
    got = missing_ratios(profile, s).where(F.col("ratio") >= s.empty).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"),
        F.max("row_count").alias("rows"),
    ).where(F.size("names") > 0)
    k = F.size("names")
    return finding(
        got,
        MODULE,
        "missing_values",
        title=_text("%d empty column(s): %s", k, F.array_join("names", ", ")),
        description=_text("%d column(s) have (nearly) no values", k),
        severity=F.lit("critical"),
        confidence=F.lit(1.0),
        columns=F.col("names"),
        recommendation="Drop the columns or repair their source.",
        evidence={"total_rows": F.col("rows"), "empty_columns": F.array_join("names", ",")},
        anomaly_strength=F.lit(1.0),
        impact=k / F.lit(float(len(df.columns))),
        missing_ratio=F.lit(1.0),
    )


def missing_values(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """A finding for each column whose null ratio is 0.05 or more, unless it is empty."""
    got = missing_ratios(profile, s).where((F.col("ratio") >= s.missing[-1]) & (F.col("ratio") < s.empty))
    return finding(
        got,
        MODULE,
        "missing_values",
        title=_text("Missing values in '%s'", F.col("name")),
        description=_text("%d of %d values are missing", F.col("null_count"), F.col("row_count")),
        severity=F.col("severity"),
        confidence=F.lit(1.0),
        columns=F.array("name"),
        recommendation="Find out why values are missing before filling them in.",
        evidence={"missing_count": F.col("null_count"), "missing_ratio": F.bround("ratio", 4), "total_rows": F.col("row_count")},
        anomaly_strength=F.col("ratio"),
        impact=F.col("ratio"),
        missing_ratio=F.bround("ratio", 4),
    )


def malformed_rows(spark: SparkSession, corrupt: int, rows: int, s: IntegritySettings, example: str = "") -> DataFrame:
    """A finding if lines of a delimited source did not fit its header, by their share of all."""
    if not corrupt:
        return none(spark)
    ratio = F.lit(corrupt / max(rows, 1))
    return finding(
        spark.range(1),
        MODULE,
        "malformed_rows",
        title=_text("%d malformed lines", F.lit(corrupt)),
        description=_text("%d of %d lines have other fields than the header, and were read only in part", F.lit(corrupt), F.lit(rows)),
        severity=F.coalesce(severity_by_ratio(ratio, s.duplicates), F.lit("low")),
        confidence=F.lit(1.0),
        columns=F.array().cast("array<string>"),
        recommendation="Look at separators and quotes where the source is written.",
        evidence={"malformed_count": F.lit(corrupt), "malformed_ratio": F.bround(ratio, 6), "total_rows": F.lit(rows), "example": F.lit(example)},
        anomaly_strength=ratio,
        impact=ratio,
    )


def duplicate_row_counts(df: DataFrame, s: IntegritySettings) -> DataFrame:
    """(rows, duplicates, ratio, severity)."""
    ratio = _ratio(F.col("duplicates"), F.col("rows"))
    return duplicate_rows(df).select("rows", "duplicates", ratio.alias("ratio"), severity_by_ratio(ratio, s.duplicates).alias("severity"))


def duplicates(df: DataFrame, profile: DataFrame, s: IntegritySettings, counted: tuple[int, int] | None = None) -> DataFrame:
    """A finding if at least 0.01 of two or more rows repeat an earlier one; the numbers of the first 100 such rows go with it.

    Rows are numbered from 0 over the source's files; where rows have no places (see identity), up to 100 hashes of repeated
    rows stand instead, and the evidence says so.

    counted: rows and duplicates, if they are known.
    """
    spark = df.sparkSession
    if counted is None:
        rows, repeats = duplicate_rows(df).first()
    else:
        rows, repeats = counted
    if rows < 2 or repeats / rows < s.duplicates[-1]:
        return none(spark)
    ratio = F.lit(repeats / rows)
    numbered = duplicate_places(df, 100)
    if numbered is not None:
        sample = numbered.agg(F.sort_array(F.collect_list("row")).alias("keys"))
    else:
        keys = row_key(df)
        again = df.groupBy(keys[0].alias("k"), keys[1].alias("k2")).agg(F.count("*").alias("n")).where("n > 1")
        sample = again.orderBy("k", "k2").limit(100).agg(F.sort_array(F.collect_list("k")).alias("keys"))
    return finding(
        sample,
        MODULE,
        "duplicate_rows",
        title=_text("%d duplicate rows", F.lit(repeats)),
        description=_text("%d of %d rows repeat an earlier row", F.lit(repeats), F.lit(rows)),
        severity=severity_by_ratio(ratio, s.duplicates),
        confidence=F.lit(1.0),
        columns=F.array(*map(F.lit, df.columns)),
        rows=F.col("keys"),
        recommendation="Check joins and loads for repeated input.",
        evidence={
            "duplicate_count": F.lit(repeats),
            "duplicate_ratio": F.bround(ratio, 4),
            "total_rows": F.lit(rows),
            "rows_are": F.lit("hashes" if numbered is None else "numbers"),
        },
        anomaly_strength=ratio,
        impact=ratio,
    )


def duplicate_feature_pairs(df: DataFrame) -> DataFrame:
    """(a, b): pairs of columns of one type with equal values in every row, nulls included.

    Columns are grouped by a fingerprint (bit_xor and a decimal sum of hashes) in one aggregation; only pairs with
    equal fingerprints are then compared row by row, in a second one.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)}
    h = lambda c: F.xxhash64(F.lit(7), F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))
    if len(kinds) < 2:
        return spark.createDataFrame([], "a string, b string")
    names = list(kinds)
    one = df.agg(
        *(
            x
            for k, c in enumerate(names)
            for x in (F.bit_xor(h(c)).alias(f"x{k}"), F.sum(h(c).cast("decimal(38,0)")).alias(f"s{k}"))
        ),
    ).first()
    alike = [
        (a, b)
        for (i, a), (j, b) in combinations(enumerate(names), 2) if kinds[a] == kinds[b] and one[f"s{i}"] is not None and (
            one[f"x{i}"],
            one[f"s{i}"],
        ) == (one[f"x{j}"], one[f"s{j}"])
    ]
    if not alike:
        return spark.createDataFrame([], "a string, b string")
    same = df.agg(*(F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{k}") for k, (a, b) in enumerate(alike)))
    return same.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}").alias("same"))
                    for k, (a, b) in enumerate(alike)
                ),
            ),
        ),
    ).where("same").select("a", "b")


def duplicate_features(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """A finding for each group of equal columns."""
    pairs = [(r.a, r.b) for r in duplicate_feature_pairs(df).collect()]
    groups = local_components(sorted({c for p in pairs for c in p}), pairs)
    if not groups:
        return none(df.sparkSession)
    got = df.sparkSession.createDataFrame([(g,) for g in groups], "names array<string>")
    return finding(
        got,
        MODULE,
        "duplicate_features",
        title=_text("Identical columns: %s", F.array_join("names", ", ")),
        description=_text("%d columns hold the same values in every row", F.size("names")),
        severity=F.lit("medium"),
        confidence=F.lit(1.0),
        columns=F.col("names"),
        recommendation="Keep one of the columns.",
        evidence={"group": F.array_join("names", ",")},
        anomaly_strength=F.lit(1.0),
        impact=F.size("names") / F.lit(float(len(df.columns))),
    )


def is_id_name(name: str, s: IntegritySettings) -> bool:
    """Whether the name, lower-cased and without _, - and spaces, has an identifier's part in it."""
    plain = name.lower().replace("_", "").replace("-", "").replace(" ", "")
    return any(p in plain for p in s.id_patterns)


def identifiers(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """(name, nulls, duplicates, null_ratio, duplicate_ratio, severity) of identifier columns: a name's part, and over half unique."""
    names = [c for c in df.columns if is_id_name(c, s)]
    unique = _ratio(F.col("unique_count"), F.col("row_count"))
    got = profile.where(F.col("name").isin(names) & ((unique > 0.5) | (unique >= s.id_unique))) if names else profile.where("false")
    dup = F.col("row_count") - F.col("null_count") - F.col("unique_count")
    worst = F.greatest(_ratio(F.col("null_count"), F.col("row_count")), _ratio(dup, F.col("row_count")))
    return got.select(
        "name",
        "row_count",
        F.col("null_count").alias("nulls"),
        dup.alias("duplicates"),
        _ratio(F.col("null_count"), F.col("row_count")).alias("null_ratio"),
        _ratio(dup, F.col("row_count")).alias("duplicate_ratio"),
        severity_by_ratio(worst, (0.10, 0.05, 0.01, 0.001)).alias("severity"),
    )


def identifier_integrity(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """A finding for each identifier column with nulls or repeats."""
    got = identifiers(df, profile, s).where("nulls > 0 or duplicates > 0")
    return finding(
        got,
        MODULE,
        "identifier_integrity",
        title=_text("Identifier '%s' is not a clean key", F.col("name")),
        description=_text("%d null and %d repeated identifiers", F.col("nulls"), F.col("duplicates")),
        severity=F.col("severity"),
        confidence=F.lit(0.85),
        columns=F.array("name"),
        recommendation="Repair the key before joining on it.",
        evidence={"null_count": F.col("nulls"), "duplicate_count": F.col("duplicates"), "total_rows": F.col("row_count")},
        anomaly_strength=F.greatest("null_ratio", "duplicate_ratio"),
        impact=F.greatest("null_ratio", "duplicate_ratio"),
    )


def constant_features(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """One finding that lists the columns with at most one value."""
    got = profile.where("unique_count <= 1 and row_count > 0").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name", "top_value"))), lambda x: x["name"]).alias("names"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("top_value", F.lit("null")).alias("v")))),
            lambda x: x["v"],
        ).alias("values"),
    ).where(F.size("names") > 0)
    return finding(
        got,
        MODULE,
        "constant_features",
        title=_text("%d constant column(s): %s", F.size("names"), F.array_join("names", ", ")),
        description=_text("%d column(s) have a single value", F.size("names")),
        severity=F.lit("medium"),
        confidence=F.lit(1.0),
        columns=F.col("names"),
        recommendation="Drop constant columns.",
        evidence={"values": F.array_join("values", ","), "unique_count": F.lit(1), "variance": F.lit(0)},
        anomaly_strength=F.lit(1.0),
        impact=F.size("names") / F.lit(float(len(df.columns))),
    )


def near_constants(profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """(name, top_value, top_count, filled, share) of columns that one value dominates without filling them."""
    filled = F.col("row_count") - F.col("null_count")
    share = _ratio(F.col("top_count"), filled)
    return profile.where(
        (share >= s.near_constant) & (share < s.constant) & (F.col("unique_count") > 1),
    ).select("name", "top_value", "top_count", filled.alias("filled"), share.alias("share"))


def near_constant_features(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    got = near_constants(profile, s)
    return finding(
        got,
        MODULE,
        "near_constant_features",
        title=_text("'%s' is nearly constant", F.col("name")),
        description=_text("One value makes up %s of the column", F.bround("share", 4).cast("string")),
        severity=F.lit("low"),
        confidence=F.lit(0.9),
        columns=F.array("name"),
        recommendation="Check whether the column says anything.",
        evidence={
            "dominance_ratio": F.bround("share", 4),
            "dominant_value": F.col("top_value"),
            "dominant_count": F.col("top_count"),
        },
        anomaly_strength=F.col("share"),
        impact=F.col("share"),
    )


def text_kinds(df: DataFrame, s: IntegritySettings) -> DataFrame:
    """(name, kind, n): how many values of each text column are of each kind, nulls left out.

    One scan and one aggregation for all columns, over every row; over s.type_sample rows drawn at random if that isn't 0.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "name string, kind string, n bigint")
    held = df.select(*(F.col(f"`{c}`") for c in names))
    held = row_sample(held, s.type_sample) if s.type_sample else held
    cells = F.array(
        *(
            F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("name"), value_type(F.col(f"`{c}`")).alias("kind")))
            for c in names
        ),
    )
    return held.select(F.inline(F.array_compact(cells))).groupBy("name", "kind").agg(F.count("*").alias("n"))


def numeric_text(kinds: DataFrame) -> DataFrame:
    """(name, sampled, numeric, ratio) of each text column with a value, from text_kinds()."""
    got = kinds.groupBy("name").agg(
        F.sum("n").alias("sampled"),
        F.coalesce(F.sum(F.when(F.col("kind") == "numeric", F.col("n"))), F.lit(0)).alias("numeric"),
    )
    return got.select("name", "sampled", "numeric", _ratio(F.col("numeric"), F.col("sampled")).alias("ratio"))


def type_mix(kinds: DataFrame) -> DataFrame:
    """(name, sampled, kinds, minority) of each text column with two kinds of values or more: the share that isn't of the main kind."""
    got = kinds.groupBy("name").agg(
        F.sum("n").alias("sampled"),
        F.count("*").alias("kinds"),
        (1 - F.max("n") / F.sum("n")).alias("minority"),
    )
    return got.where((F.col("sampled") >= 10) & (F.col("kinds") > 1))


def datatype_integrity(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """Findings for numbers kept as text, and for text columns of mixed kinds."""
    if not any(isinstance(f.dataType, T.StringType) for f in df.schema):
        return none(df.sparkSession)
    kinds = text_kinds(df, s)
    kinds = df.sparkSession.createDataFrame(kinds.collect(), kinds.schema)  # at most five rows for each column
    numbers = numeric_text(kinds).where(F.col("ratio") >= s.numeric_text)
    mixed = type_mix(kinds).where(F.col("minority") >= s.mixed_minority)
    a = finding(
        numbers,
        MODULE,
        "datatype_integrity",
        title=_text("'%s' holds numbers as text", F.col("name")),
        description=_text("%d of %d sampled values are numbers", F.col("numeric"), F.col("sampled")),
        severity=F.lit("high"),
        confidence=F.col("ratio"),
        columns=F.array("name"),
        recommendation="Cast the column to a number.",
        evidence={"parseable_ratio": F.bround("ratio", 4), "sample_size": F.col("sampled")},
        impact=F.col("ratio"),
    )
    b = finding(
        mixed,
        MODULE,
        "datatype_integrity",
        title=_text("'%s' mixes %d kinds of values", F.col("name"), F.col("kinds")),
        description=_text("%s of sampled values are not of the main kind", F.bround("minority", 4).cast("string")),
        severity=F.when(F.col("minority") > 0.1, "medium").otherwise("low"),
        confidence=F.lit(0.8),
        columns=F.array("name"),
        recommendation="Split or normalise the column.",
        evidence={"minority_share": F.bround("minority", 4), "kinds": F.col("kinds")},
        impact=F.col("minority"),
    )
    return a.unionByName(b)


def high_cardinality_columns(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """(name, unique_count, ratio) of text columns, not identifiers, with over 100 values that seldom repeat."""
    filled = F.col("row_count") - F.col("null_count")
    ids = [c for c in df.columns if is_id_name(c, s)]
    is_id = (F.col("name").isin(ids) & (_ratio(F.col("unique_count"), F.col("row_count")) > 0.5)) if ids else F.lit(False)
    return profile.where(F.col("is_text") & ~is_id & (F.col("unique_count") > 100)).select(
        "name",
        "unique_count",
        _ratio(F.col("unique_count"), filled).alias("ratio"),
    ).where(F.col("ratio") >= s.high_cardinality)


def low_cardinality_columns(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    """(name, unique_count, values) of columns of one or two values over more than 100 rows, but booleans and numbers of 0 and 1."""
    few = profile.where(
        (
            F.col("unique_count") <= s.low_cardinality
        ) & (F.col("unique_count") > 0) & ~F.col("is_boolean") & (F.col("row_count") > 100),
    ).select("ordinal", "name", "is_numeric", "unique_count")
    chosen = few.collect()
    if not chosen:
        return df.sparkSession.createDataFrame([], "name string, unique_count bigint, values array<string>")
    slim = df.select(*(F.col(f"`{r.name}`") for r in chosen))
    known = df.sparkSession.createDataFrame(
        [(k, r.name, r.is_numeric, r.unique_count) for k, r in enumerate(chosen)],
        "ordinal int, name string, is_numeric boolean, unique_count bigint",
    )
    # At most low_cardinality rows for each column.
    counts = value_counts(slim).where("value is not null").join(F.broadcast(known), "ordinal")
    held = counts.groupBy("ordinal", "name", "is_numeric", "unique_count").agg(F.sort_array(F.collect_set("value")).alias("values"))
    zero_one = F.forall("values", lambda v: v.isin("0", "1", "0.0", "1.0"))
    return held.where(~(F.col("is_numeric") & zero_one)).select("name", "unique_count", "values")


def cardinality(df: DataFrame, profile: DataFrame, s: IntegritySettings) -> DataFrame:
    high, low = high_cardinality_columns(df, profile, s), low_cardinality_columns(df, profile, s)
    a = finding(
        high,
        MODULE,
        "cardinality",
        title=_text("'%s' has high cardinality", F.col("name")),
        description=_text("%d distinct values", F.col("unique_count")),
        severity=F.lit("medium"),
        confidence=F.lit(0.85),
        columns=F.array("name"),
        recommendation="Treat the column as free text or a key.",
        evidence={"unique_count": F.col("unique_count"), "unique_ratio": F.bround("ratio", 4)},
        impact=F.col("ratio"),
    )
    b = finding(
        low,
        MODULE,
        "cardinality",
        title=_text("'%s' has %d value(s)", F.col("name"), F.col("unique_count")),
        description=_text("Values: %s", F.array_join("values", ", ")),
        severity=F.lit("info"),
        confidence=F.lit(0.7),
        columns=F.array("name"),
        recommendation="Consider a flag.",
        evidence={"values": F.array_join("values", ",")},
        impact=F.lit(0.0),
    )
    return a.unionByName(b)


def missingness_edges(df: DataFrame, profile: DataFrame, s: IntegritySettings, full: bool = False) -> DataFrame:
    """(a, b, r): pairs of columns whose null indicators correlate by missing_r or more in size."""
    names = [
        r.name
        for r in profile.where(_ratio(F.col("null_count"), F.col("row_count")) >= s.missing_min_ratio).orderBy("ordinal").collect()
    ]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    flags = df.select(*(F.col(f"`{c}`").isNull().cast("int").alias(c) for c in names))
    flags = flags if full else row_sample(flags, s.missing_rows, n=profile.first().row_count)
    return pearson(flags, names, 1).where(F.abs("r") >= s.missing_r).select("a", "b", "r")


def missingness_correlation(df: DataFrame, profile: DataFrame, s: IntegritySettings, full: bool = False) -> DataFrame:
    """A finding for each group of columns that go missing together, with its strongest edge and exact joint count."""
    edges = [(r.a, r.b, r.r) for r in missingness_edges(df, profile, s, full).collect()]
    groups = local_components(sorted({c for e in edges for c in e[:2]}), edges)
    if not groups:
        return none(df.sparkSession)
    best = [max((e for e in edges if e[0] in g), key=lambda e: (abs(e[2]), e[0], e[1])) for g in groups]
    both = df.agg(
        *(F.count_if(F.col(f"`{a}`").isNull() & F.col(f"`{b}`").isNull()).alias(f"n{k}") for k, (a, b, _) in enumerate(best)),
    ).first()
    rows = [
        (g, *e, both[k], sorted(f"{a}~{b}:{r:.4f}" for a, b, r in edges if a in g)[:25])
        for k, (g, e) in enumerate(zip(groups, best, strict=True))
    ]
    got = df.sparkSession.createDataFrame(rows, "names array<string>, a string, b string, r double, both bigint, pairs array<string>")
    return finding(
        got,
        MODULE,
        "missingness_correlation",
        title=_text("Columns go missing together: %s", F.array_join("names", ", ")),
        description=_text("'%s' and '%s' are both missing in %d rows", F.col("a"), F.col("b"), F.col("both")),
        severity=F.when(F.abs("r") > 0.85, "medium").otherwise("low"),
        confidence=F.abs("r"),
        columns=F.col("names"),
        recommendation="Look for a shared cause in the source.",
        evidence={"missingness_correlation": F.bround("r", 4), "both_missing": F.col("both"), "pairs": F.array_join("pairs", ",")},
        impact=F.size("names") / F.lit(float(len(df.columns))),
        missingness_correlation=F.bround("r", 4),
    )


DETECTORS: dict[str, list[Callable]] = {
    "missing_values": [empty_columns, missing_values],
    "duplicate_rows": [duplicates],
    "duplicate_features": [duplicate_features],
    "identifier_integrity": [identifier_integrity],
    "constant_features": [constant_features],
    "near_constant_features": [near_constant_features],
    "datatype_integrity": [datatype_integrity],
    "cardinality": [cardinality],
    "missingness_correlation": [missingness_correlation],
}


def domain_scores(findings: DataFrame, failed: tuple[str, ...] = ()) -> DataFrame:
    """(domain, weight, score): 100 less the points of a domain's findings, 0 at least; 50 for a domain that failed."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(d, w, d in failed) for d, w in DOMAINS.items()], "domain string, weight double, failed boolean")
    points = reduce(lambda out, s: F.when(F.col("severity") == s, F.lit(POINTS[s])).otherwise(out), SEVERITIES, F.lit(0.0))
    lost = findings.groupBy(F.col("category").alias("domain")).agg(F.sum(points).alias("lost"))
    score = F.when(F.col("failed"), F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), 100 - F.coalesce("lost", F.lit(0.0))))
    return names.join(lost, "domain", "left").select("domain", "weight", score.alias("score"))


def health_score(findings: DataFrame, failed: tuple[str, ...] = ()) -> DataFrame:
    """(score, severity): the weighted mean of the domains' scores to one place."""
    score = F.bround(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")), 1)
    got = domain_scores(findings, failed).agg(score.alias("score"))
    return got.select(
        "score",
        F.when(F.col("score") >= 90, "info").when(F.col("score") >= 70, "low").when(
            F.col("score") >= 50,
            "medium",
        ).when(F.col("score") >= 30, "high").otherwise("critical").alias("severity"),
    )


def health_finding(findings: DataFrame, failed: tuple[str, ...] = ()) -> DataFrame:
    got = health_score(findings, failed)
    return finding(
        got,
        MODULE,
        "structural_health_score",
        title=_text("Structural health %s of 100", F.col("score").cast("string")),
        description=F.lit("Weighted score of all integrity domains"),
        severity=F.col("severity"),
        confidence=F.lit(1.0),
        columns=F.array().cast("array<string>"),
        recommendation="Start with the most urgent findings.",
        evidence={"health_score": F.col("score")},
        impact=1 - F.col("score") / 100,
    )
