"""Queries for sources, profile, integrity and relationship operators over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.config import IntegritySettings, RelationshipSettings
from sifter.functions import stats
from sifter.functions.scalars import value_type
from sifter.operators import graph, integrity, moments, relationship
from sifter.operators.identity import duplicate_places
from sifter.operators.profile import clean, duplicate_rows, profile, profile_table
from sifter.operators.sampling import row_sample as sample_rows

I, R = IntegritySettings(), RelationshipSettings()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with their labels, which most of them lack; texts by their length and digest only."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, d, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def prices(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    p, disc = F.col("l_extendedprice"), 1 - F.col("l_discount")
    return li.select("l_quantity", "l_tax", p.alias("price"), (p * disc).alias("net"), (p * disc * (1 + F.col("l_tax"))).alias("gross"))


PRICES = (
    "(SELECT l_quantity, l_tax, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - "
    "l_discount) * (1 + l_tax) AS gross FROM lineitem)"
)


def messy_orders(spark: SparkSession, d: str) -> DataFrame:
    """orders with null keys at low priority, repeats of some keys, a constant, a rare flag and an empty column."""
    o = read(spark, d, "orders")
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey"))
    base = o.select(
        key.alias("order_id"),
        "o_orderstatus",
        "o_orderpriority",
        F.lit("x").alias("fixed"),
        F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0).alias("rare"),
        F.lit(None).cast("double").alias("empty"),
    )
    return base.union(base.where("order_id % 20 = 0"))


_BASE = (
    "SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS order_id, o_orderstatus, o_orderpriority, 'x' AS fixed, "
    "CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS rare, CAST(NULL AS DOUBLE) AS empty FROM orders"
)
MESSY = f"({_BASE} UNION ALL SELECT * FROM ({_BASE}) WHERE order_id % 20 = 0)"


def texts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(k.alias("k"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(k).alias("mix"), "event_type")


TEXTS = (
    "(SELECT json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 7 = 0 THEN event_type ELSE json_extract_string(props, "
    "'$.k') END AS mix, event_type FROM events)"
)
TYPE = (
    "CASE WHEN trim(v) = '' THEN 'empty' WHEN TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL THEN 'numeric' WHEN lower(trim(v)) IN "
    "('true','false','yes','no') THEN 'boolean' WHEN regexp_matches(trim(v), '^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}') THEN "
    "'datetime' ELSE 'string' END"
)


def _severity(ratio: str, cuts: tuple) -> str:
    return "CASE " + " ".join(
        f"WHEN {ratio} >= {c} THEN '{n}'" for n, c in zip(("critical", "high", "medium", "low"), cuts, strict=True)
    ) + " ELSE 'info' END"


def _union(table: str, columns: list[str], each: str) -> str:
    return " UNION ALL ".join(each.replace("{c}", c).replace("{t}", table) for c in columns)


def _profile_sql(table: str, columns: list[str]) -> str:
    return _union(
        table,
        columns,
        "SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count "
        "FROM {t}",
    )


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def held(df: DataFrame) -> DataFrame:
    """The profile table, computed once: a row for each column."""
    table = profile_table(df)
    return df.sparkSession.createDataFrame(table.collect(), table.schema)


def _slim(df: DataFrame) -> DataFrame:
    return profile_table(df).select("name", "row_count", "null_count", "unique_count")


LI = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
LAB = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


@query("profile_lineitem", _profile_sql("lineitem", LI))
def profile_lineitem(spark, d):
    return _slim(read(spark, d, "lineitem"))


@query("profile_labelled_documents", _profile_sql(LABELLED, LAB))
def profile_labelled(spark, d):
    return _slim(labelled(spark, d))


@query("profile_documents_text", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def profile_text(spark, d):
    return _slim(read(spark, d, "documents"))


_FLAGS = [
    ("o_orderkey", "bigint", "n"),
    ("o_custkey", "bigint", "n"),
    ("o_orderstatus", "string", "c"),
    ("o_totalprice", "double", "n"),
    ("o_orderdate", "timestamp_ntz", "d"),
    ("o_orderpriority", "string", "c"),
]


@query(
    "profile_type_flags",
    "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', '{t}', {k == 'n'}, {k == 'c'}, {k == 'd'}, false)" for n, t, k in _FLAGS
    ) + ") AS v(name, dtype, is_numeric, is_categorical, is_datetime, is_boolean)",
)
def type_flags(spark, d):
    return profile_table(read(spark, d, "orders")).select("name", "dtype", "is_numeric", "is_categorical", "is_datetime", "is_boolean")


@query(
    "profile_missing_ratio",
    "SELECT round(1.0 * (2 * count(*) - count(quality) - count(toxic)) / (6 * count(*)), 6) AS missing_ratio FROM " + LABELLED,
)
def missing_ratio(spark, d):
    return profile_table(labelled(spark, d)).agg(F.round(F.sum("null_count") / F.sum("row_count"), 6).alias("missing_ratio"))


@query(
    "missing_values",
    f"WITH p AS ({_profile_sql(LABELLED, LAB)}) SELECT name, null_count, row_count, round(1.0 * null_count / row_count, 4) AS "
    f"ratio, {_severity('1.0 * null_count / row_count', I.missing)} AS severity FROM p WHERE null_count > 0",
)
def missing(spark, d):
    return integrity.missing_ratios(profile_table(labelled(spark, d)), I).select(
        "name",
        "null_count",
        "row_count",
        F.round("ratio", 4).alias("ratio"),
        "severity",
    )


@query("empty_columns", f"SELECT 'empty' AS name, 'critical' AS severity FROM {MESSY} HAVING count(empty) = 0")
def empty(spark, d):
    df = messy_orders(spark, d)
    return integrity.empty_columns(df, held(df), I).select(F.explode("affected_columns").alias("name"), "severity")


@query(
    "duplicate_rows",
    f"WITH c AS (SELECT count(*) AS n FROM events GROUP BY user_id, event_type), t AS (SELECT CAST(sum(n) AS BIGINT) AS rows, "
    f"CAST(sum(n - 1) AS BIGINT) AS duplicates FROM c) SELECT rows, duplicates, round(1.0 * duplicates / rows, 4) AS ratio, "
    f"{_severity('1.0 * duplicates / rows', I.duplicates)} AS severity FROM t",
)
def dup_rows(spark, d):
    return integrity.duplicate_row_counts(read(spark, d, "events").select("user_id", "event_type"), I).select(
        "rows",
        "duplicates",
        F.round("ratio", 4).alias("ratio"),
        "severity",
    )


@query(
    "duplicate_features",
    "SELECT 'n_chars' AS a, 'n_text' AS b FROM documents HAVING bool_and(n_chars IS NOT DISTINCT FROM CAST(length(text) AS "
    "BIGINT))",
)
def dup_features(spark, d):
    docs = read(spark, d, "documents")
    return integrity.duplicate_feature_pairs(
        docs.select("doc_id", "n_chars", F.length("text").cast("bigint").alias("n_text"), "lang", "source"),
    )


@query(
    "identifier_integrity",
    f"WITH p AS (SELECT count(*) AS n, count(*) - count(order_id) AS nulls, count(order_id) - count(DISTINCT order_id) AS "
    f"duplicates, count(DISTINCT order_id) AS u FROM {MESSY}) SELECT 'order_id' AS name, nulls, duplicates, "
    f"{_severity('greatest(1.0 * nulls / n, 1.0 * duplicates / n)', (0.10, 0.05, 0.01, 0.001))} AS severity FROM p WHERE 1.0 * "
    f"u / n > 0.5",
)
def ids(spark, d):
    df = messy_orders(spark, d)
    return integrity.identifiers(df, profile_table(df), I).select("name", "nulls", "duplicates", "severity")


@query(
    "constant_features",
    f"SELECT name FROM (SELECT 'fixed' AS name, count(DISTINCT fixed) AS u FROM {MESSY} UNION ALL SELECT 'empty', "
    f"count(DISTINCT empty) FROM {MESSY} UNION ALL SELECT 'rare', count(DISTINCT rare) FROM {MESSY}) WHERE u <= 1",
)
def constants(spark, d):
    df = messy_orders(spark, d)
    return integrity.constant_features(df, profile_table(df), I).select(F.explode("affected_columns").alias("name"))


@query(
    "near_constant_features",
    f"WITH c AS (SELECT rare, count(*) AS n FROM {MESSY} GROUP BY rare) SELECT 'rare' AS name, max(n) AS top_count, "
    f"CAST(sum(n) AS BIGINT) AS filled, round(1.0 * max(n) / sum(n), 4) AS share FROM c HAVING 1.0 * max(n) / sum(n) >= 0.95 "
    f"AND 1.0 * max(n) / sum(n) < 0.9999",
)
def near(spark, d):
    return integrity.near_constants(profile_table(messy_orders(spark, d)), I).select(
        "name",
        "top_count",
        "filled",
        F.round("share", 4).alias("share"),
    )


_ALL_TYPES = _union(TEXTS, ["k", "mix", "event_type"], "SELECT '{c}' AS name, {c} AS v FROM {t} WHERE {c} IS NOT NULL")


@query("value_types", f"SELECT name, {TYPE} AS kind, count(*) AS n FROM ({_ALL_TYPES}) GROUP BY ALL")
def kinds(spark, d):
    t = texts(spark, d)
    long = t.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in t.columns)))).where("v is not null")
    return long.groupBy("name", value_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


_KINDS = f"(SELECT name, {TYPE} AS kind, count(*) AS n FROM ({_ALL_TYPES}) GROUP BY ALL)"


@query(
    "numeric_as_string",
    f"SELECT name, CAST(sum(n) AS BIGINT) AS sampled, round(coalesce(sum(n) FILTER (kind = 'numeric'), 0) / sum(n), 3) AS "
    f"ratio FROM {_KINDS} GROUP BY name",
)
def numeric_text(spark, d):
    return integrity.numeric_text(integrity.text_kinds(texts(spark, d), I)).select("name", "sampled", F.round("ratio", 3).alias("ratio"))


@query(
    "mixed_types",
    f"SELECT name, CAST(sum(n) AS BIGINT) AS sampled, count(*) AS kinds, round(1 - max(n) / sum(n), 6) AS minority FROM "
    f"{_KINDS} GROUP BY name HAVING count(*) > 1 AND sum(n) >= 10",
)
def mixed(spark, d):
    return integrity.type_mix(integrity.text_kinds(texts(spark, d), I)).select(
        "name",
        "sampled",
        "kinds",
        F.round("minority", 6).alias("minority"),
    )


@query(
    "high_cardinality",
    "SELECT 'text' AS name, count(DISTINCT text) AS unique_count, round(1.0 * count(DISTINCT text) / count(text), 4) AS ratio "
    "FROM documents HAVING count(DISTINCT text) > 100 AND 1.0 * count(DISTINCT text) / count(text) >= 0.9",
)
def high(spark, d):
    df = read(spark, d, "documents")
    return integrity.high_cardinality_columns(df, profile_table(df), I).select("name", "unique_count", F.round("ratio", 4).alias("ratio"))


@query(
    "low_cardinality",
    "SELECT 'l_linestatus' AS name, count(DISTINCT l_linestatus) AS unique_count, string_agg(DISTINCT l_linestatus, ',' ORDER "
    "BY l_linestatus) AS values FROM lineitem HAVING count(DISTINCT l_linestatus) <= 2",
)
def low(spark, d):
    df = read(spark, d, "lineitem")
    return integrity.low_cardinality_columns(df, held(df), I).select("name", "unique_count", F.array_join("values", ",").alias("values"))


_JOINT = (
    "SELECT 'quality' AS a, 'toxic' AS b, "
    "round(corr(CAST(quality IS NULL AS INT), CAST(toxic IS NULL AS INT)), {places}) AS r FROM " + LABELLED
)


@query("missingness_correlation", _JOINT.format(places=6))
def together(spark, d):
    df = labelled(spark, d)
    return integrity.missingness_edges(df, held(df), I, full=True).select("a", "b", F.round("r", 6).alias("r"))


@query("missingness_balanced", _JOINT.format(places=2))
def together_sampled(spark, d):
    """The balanced profile: where the table has more rows than the budget, a sample of rows stands for it."""
    df = labelled(spark, d)
    return integrity.missingness_edges(df, held(df), I).select("a", "b", F.round("r", 2).alias("r"))


def _findings(spark, d):
    df = messy_orders(spark, d)
    p = held(df)
    out = None
    for detectors in integrity.DETECTORS.values():
        for detect in detectors:
            extra = {"full": True} if detect is integrity.missingness_correlation else {}
            made = detect(df, p, I, **extra)
            out = made if out is None else out.unionByName(made)
    return out


_FOUND = f"""m AS (SELECT * FROM {MESSY}), t AS (SELECT count(*) AS n, count(*) - count(order_id) AS nulls,
    count(order_id) - count(DISTINCT order_id) AS again, avg(CASE WHEN rare = 0 THEN 1.0 ELSE 0 END) AS share FROM m),
  r AS (SELECT 1.0 * (max(t.n) - count(*)) / max(t.n) AS ratio FROM (SELECT DISTINCT * FROM m), t),
  f AS (SELECT 'missing_values' AS category, 'critical' AS severity, 'empty' AS columns
  UNION ALL SELECT 'missing_values', {_severity('1.0 * nulls / n', I.missing)}, 'order_id' FROM t WHERE 1.0 * nulls / n >= 0.05
  UNION ALL SELECT 'duplicate_rows', {
      _severity('ratio', I.duplicates)
  }, 'order_id,o_orderstatus,o_orderpriority,fixed,rare,empty' FROM r WHERE ratio >= 0.01
  UNION ALL SELECT 'identifier_integrity', {
      _severity('greatest(1.0 * nulls / n, 1.0 * again / n)', (0.10, 0.05, 0.01, 0.001))
  }, 'order_id' FROM t
  UNION ALL SELECT 'constant_features', 'medium', 'fixed,empty'
  UNION ALL SELECT 'near_constant_features', 'low', 'rare' FROM t WHERE share >= 0.95
  UNION ALL SELECT 'cardinality', 'info', 'fixed')"""


@query("integrity_findings", f"WITH {_FOUND} SELECT * FROM f")
def all_findings(spark, d):
    return _findings(spark, d).select("category", "severity", F.array_join("affected_columns", ",").alias("columns"))


def _health_sql(found: str, by_domain: bool) -> str:
    """Scores of the domains over a table f of findings, or their weighted mean."""
    points = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in integrity.POINTS.items()) + " END"
    domains = ", ".join(f"('{k}', {v})" for k, v in integrity.DOMAINS.items())
    scored = (
        f"SELECT domain, CAST(any_value(weight) AS DOUBLE) AS weight, CAST(greatest(0, 100 - coalesce(sum({points}), 0)) AS "
        f"DOUBLE) AS score FROM w LEFT JOIN f ON f.category = domain GROUP BY domain"
    )
    parts = f"WITH {found}, w AS (SELECT * FROM (VALUES {domains}) AS v(domain, weight)), s AS ({scored})"
    if by_domain:
        return f"{parts} SELECT domain, weight, score FROM s"
    total = "SELECT round_even(sum(weight * score) / sum(weight), 1) AS score FROM s"
    cuts = "WHEN score >= 90 THEN 'info' WHEN score >= 70 THEN 'low' WHEN score >= 50 THEN 'medium' WHEN score >= 30 THEN 'high'"
    return f"{parts} SELECT score, CASE {cuts} ELSE 'critical' END AS severity FROM ({total})"


@query("structural_health", _health_sql(_FOUND, False))
def health(spark, d):
    return integrity.health_score(_findings(spark, d))


@query("health_domain_scores", _health_sql(_FOUND, True))
def health_domains(spark, d):
    return integrity.domain_scores(_findings(spark, d))


def _corr_sql(columns: list[str], table: str, f: str = "{c}") -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({f.format(c=a)}, {f.format(c=b)}), 6) AS r FROM {table}"
        for a, b in pairs
    )


PRICE = ["l_quantity", "l_tax", "price", "net", "gross"]


@query("pearson", _corr_sql(PRICE, PRICES))
def pearsons(spark, d):
    return moments.pearson(prices(spark, d), PRICE).select("a", "b", "n", F.round("r", 6).alias("r"))


_rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
_RANKS = f"(SELECT {', '.join(map(_rank, PRICE))} FROM {PRICES})"


@query("spearman", _corr_sql(["l_quantity", "price", "net"], _RANKS))
def spearmans(spark, d):
    return moments.spearman(prices(spark, d), ["l_quantity", "price", "net"]).select("a", "b", "n", F.round("r", 6).alias("r"))


def _strong_sql() -> str:
    """CTEs up to q: pairs at or over a cutoff, both coefficients (null below it), and the larger one."""
    pairs = [(a, b) for i, a in enumerate(PRICE) for b in PRICE[i + 1 :]]
    each = lambda table: " UNION ALL ".join(
        f"SELECT '{min(a, b)}' AS a, '{max(a, b)}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM {table}" for a, b in pairs
    )
    cut = lambda r: f"CASE WHEN abs({r}) >= 0.8 THEN {r} END"
    both = f"SELECT p.a, p.b, p.n, {cut('p.r')} AS pearson, {cut('s.r')} AS spearman FROM pp p JOIN ss s ON p.a = s.a AND p.b = s.b"
    larger = "CASE WHEN abs(coalesce(pearson, 0)) >= abs(coalesce(spearman, 0)) THEN pearson ELSE spearman END"
    known = "pearson IS NOT NULL OR spearman IS NOT NULL"
    return f"pp AS ({each(PRICES)}), ss AS ({each(_RANKS)}), b AS ({both}), q AS (SELECT *, {larger} AS r FROM b WHERE {known})"


_STRONG = _strong_sql()


@query(
    "correlated_pairs",
    f"WITH {_STRONG} SELECT a, b, round(pearson, 4) AS pearson, round(spearman, 4) AS spearman, 0.0::DOUBLE AS p_value, n FROM q",
)
def pairs(spark, d):
    found = relationship.pair_table(spark, relationship.correlated_pairs(prices(spark, d), PRICE, R, full=True))
    return found.select(
        "a",
        "b",
        F.round("pearson", 4).alias("pearson"),
        F.round("spearman", 4).alias("spearman"),
        F.round("p_value", 9).alias("p_value"),
        "n",
    )


@query("balanced_pairs", f"WITH {_STRONG} SELECT a, b FROM q")
def sampled_pairs(spark, d):
    """The balanced profile flags the same pairs from its sample of rows."""
    return relationship.pair_table(spark, relationship.correlated_pairs(prices(spark, d), PRICE, R)).select("a", "b")


_QUOTED = "chr(39) || a || chr(39) || ' and ' || chr(39) || b || chr(39)"


@query(
    "correlation_findings",
    f"WITH {_STRONG} SELECT {_QUOTED} || ' correlate' AS title, CASE WHEN abs(r) >= 0.95 THEN 'high' ELSE 'medium' END AS "
    f"severity, 1.0::DOUBLE AS confidence, round(r, 4) AS correlation_coefficient FROM q",
)
def pair_findings(spark, d):
    found = relationship.correlation_findings(spark, relationship.correlated_pairs(prices(spark, d), PRICE, R, full=True), R)
    return found.select("title", "severity", "confidence", F.round("correlation_coefficient", 4).alias("correlation_coefficient"))


@query("correlation_topk", f"WITH p AS ({_corr_sql(PRICE, PRICES)}) SELECT a, b, r FROM p ORDER BY abs(r) DESC, a, b LIMIT 3")
def strongest_pairs(spark, d):
    """The three strongest pairs: the limit is the query's feature."""
    found = moments.pearson(prices(spark, d), PRICE).orderBy(F.desc(F.abs("r")), "a", "b").limit(3)
    return found.select("a", "b", F.round("r", 6).alias("r"))


@query(
    "correlation_tstat",
    "SELECT round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM (SELECT corr(l_quantity, l_tax) AS r, count(*) AS n FROM lineitem)",
)
def t_values(spark, d):
    found = moments.pearson(prices(spark, d), ["l_quantity", "l_tax"]).first()
    return spark.createDataFrame([(moments.t_statistic(found.r, found.n),)], "t double").select(F.round("t", 4).alias("t"))


_GROUPS = f"""WITH RECURSIVE {_STRONG}, k AS (SELECT * FROM (VALUES ('redundant_features', 0.95, 2), ('strong_group', 0.90, 3),
    ('feature_community', 0.75, 3)) AS v(kind, cut, least)),
  e AS (SELECT kind, least, a AS x, b AS y FROM k JOIN q ON abs(r) >= cut UNION ALL SELECT kind, least, b, a FROM k
    JOIN q ON abs(r) >= cut),
  w AS (SELECT DISTINCT kind, least, x AS start, x AS stop FROM e UNION SELECT w.kind, w.least, w.start, e.y FROM w
    JOIN e ON e.kind = w.kind AND e.x = w.stop),
  c AS (SELECT kind, least, start, min(stop) AS root FROM w GROUP BY ALL)
SELECT kind AS category, string_agg(start, ',' ORDER BY start) AS columns, CASE WHEN kind = 'redundant_features' THEN 'high'
    ELSE 'medium' END AS severity, round(count(*) / {len(PRICE)}.0, 4) AS impact
FROM c GROUP BY kind, least, root HAVING count(*) >= least"""


@query("feature_groups", _GROUPS)
def groups(spark, d):
    found = relationship.group_findings(spark, relationship.correlated_pairs(prices(spark, d), PRICE, R, full=True), len(PRICE), R)
    return found.select(
        "category",
        F.array_join("affected_columns", ",").alias("columns"),
        "severity",
        F.round("impact", 4).alias("impact"),
    )


_THREE = ["l_quantity", "price", "l_tax"]
_R = "(SELECT corr(l_quantity, price) AS a, corr(l_quantity, l_tax) AS b, corr(price, l_tax) AS c FROM " + PRICES + ")"


@query(
    "variance_inflation",
    f"WITH r AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM {_R}) SELECT 'l_quantity' AS name, round((1 - c "
    f"* c) / d, 3) AS vif FROM r UNION ALL SELECT 'price', round((1 - b * b) / d, 3) FROM r UNION ALL SELECT 'l_tax', round((1 "
    f"- a * a) / d, 3) FROM r",
)
def inflation(spark, d):
    found = moments.vif(prices(spark, d), _THREE)
    return spark.createDataFrame(found, "name string, vif double").withColumn("vif", F.round("vif", 3))


@query("pairwise_information")
def information(spark, d):
    li = read(spark, d, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_quantity") - 25).alias("off"),
    ).withColumn("square", F.col("off") * F.col("off"))
    return moments.mutual_information(
        li,
        [("l_quantity", "square"), ("l_quantity", "l_discount")],
    ).select("a", "b", "n", F.round("score", 3).alias("score"))


@query("target_information")
def target(spark, d):
    df = labelled(spark, d).where("quality is not null").withColumn("half", F.col("quality") + F.col("n_chars") / 1e6)
    return relationship.target_information(
        df,
        profile(df),
        "quality",
        ["n_chars", "toxic", "half"],
        R,
    ).select("a", "b", "n", F.round("score", 3).alias("score"))


@query(
    "z_scores",
    "WITH m AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, "
    "round((o_totalprice - m) / s, 5) AS z FROM orders, m",
)
def zs(spark, d):
    return stats.z_scores(
        read(spark, d, "orders").select("o_orderkey", "o_totalprice"),
        "o_totalprice",
    ).select("o_orderkey", F.round("z", 5).alias("z"))


@query(
    "iqr_bounds",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT "
    "round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high FROM q",
)
def iqr(spark, d):
    return stats.iqr_bounds(read(spark, d, "orders"), "o_totalprice").select(
        F.round("low", 4).alias("low"),
        F.round("high", 4).alias("high"),
    )


@query(
    "cohens_d",
    "WITH m AS (SELECT count(*) FILTER (f) AS na, avg(v) FILTER (f) AS ma, var_samp(v) FILTER (f) AS va, count(*) FILTER (NOT "
    "f) AS nb, avg(v) FILTER (NOT f) AS mb, var_samp(v) FILTER (NOT f) AS vb FROM (SELECT o_totalprice AS v, o_orderstatus = "
    "'F' AS f FROM orders)) SELECT round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM m",
)
def cohen(spark, d):
    return stats.cohens_d(read(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").select(F.round("d", 6).alias("d"))


@query(
    "cramers_v",
    "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, "
    "sum(n) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c), x AS "
    "(SELECT sum(power(coalesce(n, 0) - ra * cb / t, 2) / (ra * cb / t)) AS chi2, max(t) AS t FROM r CROSS JOIN k CROSS JOIN t "
    "LEFT JOIN c ON c.a = r.a AND c.b = k.b) SELECT round(sqrt(chi2 / (t * (least((SELECT count(*) FROM r), (SELECT count(*) "
    "FROM k)) - 1))), 6) AS v FROM x",
)
def cramer(spark, d):
    return stats.cramers_v(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(F.round("v", 6).alias("v"))


@query(
    "entropy",
    "WITH c AS (SELECT 1.0 * count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) SELECT round(sum(-p * "
    "log2(p)), 6) AS bits FROM c",
)
def bits(spark, d):
    return stats.entropy(read(spark, d, "events"), "event_type").select(F.round("bits", 6).alias("bits"))


@query("coefficient_of_variation", "SELECT round(abs(stddev_samp(value) / avg(value)), 6) AS cv FROM events")
def cv(spark, d):
    return stats.coefficient_of_variation(read(spark, d, "events"), "value").select(F.round("cv", 6).alias("cv"))


@query("skewness", "SELECT round(skewness(value), 5) AS skewness FROM events")
def skew(spark, d):
    return stats.skewness(read(spark, d, "events"), "value").select(F.round("skewness", 5).alias("skewness"))


@query("kurtosis", "SELECT round(kurtosis(value), 5) AS kurtosis FROM events")
def kurt(spark, d):
    return stats.kurtosis(read(spark, d, "events"), "value").select(F.round("kurtosis", 5).alias("kurtosis"))


@query("normality")
def normal(spark, d):
    """Moments over all rows; test_statistics holds the p-values against known distributions."""
    df = read(spark, d, "orders")
    rows = [(c, *map(float, stats.normality(df, c))) for c in ("o_totalprice", "o_orderkey")]
    return spark.createDataFrame(rows, "name string, normal double, p double").withColumn("p", F.round("p", 6))


_TAU = """WITH c AS (SELECT l_quantity AS x, l_tax AS y, count(*) AS w FROM lineitem GROUP BY ALL),
  s AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS s FROM c a, c b),
  n AS (SELECT sum(w) AS n FROM c), x AS (SELECT sum(t * (t - 1)) / 2.0 AS t FROM (SELECT sum(w) AS t FROM c GROUP BY x)),
    y AS (SELECT sum(t * (t - 1)) / 2.0 AS t FROM (SELECT sum(w) AS t FROM c GROUP BY y))
SELECT 'l_quantity' AS a, 'l_tax' AS b, CAST(n AS BIGINT) AS n,
    round(s / (sqrt(n * (n - 1) / 2.0 - x.t) * sqrt(n * (n - 1) / 2.0 - y.t)), 6) AS r FROM s, n, x, y"""


@query("kendall", _TAU)
def tau(spark, d):
    return stats.kendall(read(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumn("r", F.round("r", 6))


@query(
    "connected_components",
    "WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS a, c_custkey - 1 AS b FROM customer WHERE c_custkey % 5 <> 0), v AS "
    "(SELECT a AS vertex FROM e UNION SELECT b FROM e), r AS (SELECT vertex, vertex AS up FROM v UNION SELECT r.vertex, e.b "
    "FROM r JOIN e ON r.up = e.a) SELECT vertex, min(up) AS component FROM r GROUP BY vertex",
)
def parts(spark, d):
    c = read(spark, d, "customer").where("c_custkey % 5 <> 0")
    return graph.components(c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") - 1).alias("dst")))


_NATIONS = (
    "(SELECT n_nationkey AS src, (n_nationkey + 5) % 25 AS dst, 1.0 AS weight FROM nation UNION ALL SELECT n_nationkey, "
    "(n_nationkey + 1) % 25, 0.5 FROM nation)"
)


@query(
    "modularity",
    f"WITH e AS {_NATIONS}, t AS (SELECT sum(weight) AS m, sum(weight) FILTER (src % 5 = dst % 5) AS i FROM e), s AS (SELECT "
    f"c, sum(weight) AS d FROM (SELECT src % 5 AS c, weight FROM e UNION ALL SELECT dst % 5, weight FROM e) GROUP BY c) SELECT "
    f"round(max(i) / max(m) - sum(d * d) / (4 * max(m) * max(m)), 6) AS modularity FROM s, t",
)
def q_score(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    e = n.select(
        F.col("k").alias("src"),
        ((F.col("k") + 5) % 25).alias("dst"),
        F.lit(1.0).alias("weight"),
    ).union(n.select("k", (F.col("k") + 1) % 25, F.lit(0.5)))
    return graph.modularity(
        e,
        n.select(F.col("k").alias("vertex"), (F.col("k") % 5).alias("community")),
    ).select(F.round("modularity", 6).alias("modularity"))


@query(
    "graph_density",
    "SELECT n AS vertices, n AS edges, round(2.0 * n / (n * (n - 1)), 6) AS density, 2.0 AS average_degree FROM (SELECT "
    "count(*) AS n FROM nation)",
)
def dense(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("vertex"))
    e = n.select(F.col("vertex").alias("src"), ((F.col("vertex") + 1) % 25).alias("dst"))
    return graph.density(n, e).withColumn("density", F.round("density", 6))


_NUMBERED = "SELECT row_number() OVER () - 1 AS row, {} FROM {}"


@query(
    "duplicate_places",
    f"WITH n AS MATERIALIZED ({_NUMBERED.format('user_id, event_type', 'events')}), f AS (SELECT row, min(row) OVER (PARTITION BY "
    f"user_id, event_type) AS first FROM n) SELECT row, first FROM f WHERE row <> first",
)
def dup_places(spark, d):
    """The number of every row of events that repeats an earlier one in two columns, and of the first of its kind."""
    return duplicate_places(read(spark, d, "events").select("user_id", "event_type"))


@query("row_sample", "SELECT l_returnflag, l_linestatus, CAST(least(5000, (SELECT count(*) FROM lineitem)) AS INT) AS rows, true AS even FROM "
    "lineitem GROUP BY ALL")
def sampled(spark, d):
    """5,000 rows of the two columns of fewest values: every pair of values is drawn, and as often as its share says, to 0.03."""
    li = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    drawn = sample_rows(li, 5000).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    known = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("all"))
    total = known.agg(F.sum("all").alias("total"), F.lit(1).alias("one")).join(
        drawn.agg(F.sum("n").cast("int").alias("rows"), F.lit(1).alias("one")),
        "one",
    ).drop("one")
    both = known.join(drawn, ["l_returnflag", "l_linestatus"]).join(F.broadcast(total))
    return both.select(
        "l_returnflag",
        "l_linestatus",
        "rows",
        (F.abs(F.col("n") / F.col("rows") - F.col("all") / F.col("total")) < 0.03).alias("even"),
    )


@query(
    "duplicate_row_profile",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM "
    "lineitem)) AS duplicates FROM lineitem",
)
def dup_profile(spark, d):
    return duplicate_rows(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))
