"""Evidence units as a plan: what the findings of each community have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.functions.scalars import WEIGHTS, severity_rank, severity_weight
from sifter.operators.communities import HELD, communities
from sifter.plans import tables
from sifter.plans.detect import query, read

#: Columns that a unit shows, and reasons it gives.
SHOWN, REASONS = 5, 4


def category_of(kinds: Column) -> Column:
    """Category of a unit by the first row of the table one of whose categories is among its findings'."""

    def met(wanted: str) -> Column:
        return F.exists(kinds, lambda k: F.contains(k, F.lit(wanted)) if wanted in ("outlier", "cluster") else k == wanted)

    def any_of(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for name in names:
            out = out | met(name)
        return out

    return F.coalesce(*(F.when(any_of(names), F.lit(said)) for said, names in tables.EVIDENCE_RULES), F.lit(tables.DEFAULT_CATEGORY))


def evidence(findings: DataFrame, ties: DataFrame, membership: DataFrame) -> DataFrame:
    """A row for each unit: unit, findings, category, severity, confidence, community, strength, columns, modules, kinds, shown, why.

    findings: id, category, severity, confidence, module, affected_columns; ties: left, right, weight, reasons; membership: vertex
    (a finding's id), community (its unit). confidence: the mean; severity: the worst; community: the mean weight of the ties inside
    times their density, 1 for a single finding; shown: the most frequent columns, then by name; why: the most frequent reasons.
    Sums come before shuffles: no unit's findings are brought together but as distinct names. Null columns and reasons are none.
    """
    unit = membership.select(F.col("vertex").alias("id"), F.col("community").alias("unit"))
    own = findings.select("id", "category", "severity", "confidence", "module", "affected_columns").join(unit, "id")
    ties = ties.select("left", "right", "weight", "reasons")
    worst = F.min(F.struct(severity_rank(F.col("severity")).alias("rank"), "severity"))
    base = own.groupBy("unit").agg(
        F.count("*").alias("findings"),
        worst.alias("worst"),
        F.round(F.avg("confidence"), 2).alias("confidence"),
        F.array_sort(F.collect_set("module")).alias("modules"),
        F.array_sort(F.collect_set("category")).alias("kinds"),
    )
    inside = ties.join(unit.select(F.col("id").alias("left"), F.col("unit").alias("a")), "left").join(
        unit.select(F.col("id").alias("right"), F.col("unit").alias("b")),
        "right",
    ).where("a = b")
    edges = inside.groupBy(F.col("a").alias("unit")).agg(F.count("*").alias("ties"), F.avg("weight").alias("weight"))

    def common(rows: DataFrame, name: str, most: int) -> DataFrame:
        """(unit, name): the most frequent values of a unit, then by value."""
        order = Window.partitionBy("unit").orderBy(F.desc("n"), "value")
        top = rows.groupBy("unit", "value").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        held = F.array_sort(F.collect_list(F.struct("k", "value")))
        return top.groupBy("unit").agg(F.transform(held, lambda x: x["value"]).alias(name))

    named = own.select("unit", F.explode("affected_columns").alias("value"))
    reasons = inside.select(F.col("a").alias("unit"), F.explode("reasons").alias("value"))
    every = named.groupBy("unit").agg(F.array_sort(F.collect_set("value")).alias("columns"))
    rows = base.join(edges, "unit", "left").join(every, "unit", "left")
    rows = rows.join(common(named, "shown", SHOWN), "unit", "left").join(common(reasons, "why", REASONS), "unit", "left")
    n, empty = F.col("findings"), F.array().cast("array<string>")
    tight = F.coalesce(F.col("weight") * 2 * F.col("ties") / (n * (n - 1)), F.lit(0.0))
    community = F.when(n == 1, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), tight), 4))
    rows = rows.withColumns({"community": community, "severity": F.col("worst.severity"), "category": category_of(F.col("kinds"))})
    strength = 55 * severity_weight(F.col("severity")) + 25 * F.col("confidence") + 20 * F.col("community")
    lists = [F.coalesce(c, empty).alias(c) for c in ("columns", "modules", "kinds", "shown", "why")]
    plain = ["unit", "findings", "category", "severity", "confidence", "community"]
    return rows.select(*plain, F.round(F.least(F.lit(100.0), strength), 1).alias("strength"), *lists)


_KINDS = ["missing_values", "correlation", "duplicate_features", "constant_features", "cardinality", "outlier_rows"]
_LEVELS = list(WEIGHTS)
_FOUND = f"""f AS (SELECT c_custkey AS id, c_nationkey AS unit, {_KINDS}[c_custkey // 40 % 6 + 1] AS category, {_LEVELS}[c_custkey % 5 + 1] AS severity,
    (c_custkey % 50 + 50) / 100.0::DOUBLE AS confidence, 'm' || (c_custkey % 3) AS module, ['col' || (c_custkey % 9), c_mktsegment] AS cols FROM customer
    WHERE c_nationkey > 0 OR c_custkey % 7 = 0),
  t AS (SELECT a.id AS x, b.id AS y, (a.id % 10) / 10.0::DOUBLE AS weight, ['r' || (a.id % 3), 's' || (b.id % 5)] AS reasons FROM f a JOIN f b ON b.id IN (a.id + 1, a.id + 2, a.id + 25)
    AND a.unit = b.unit)"""


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("c_custkey")
    said = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    rows = read(spark, d, "customer").where("c_nationkey > 0 or c_custkey % 7 = 0").select(
        k.alias("id"),
        F.col("c_nationkey").alias("unit"),
        said(_KINDS, F.floor(k / 40) % 6).alias("category"),
        said(_LEVELS, k % 5).alias("severity"),
        ((k % 50 + 50) / 100.0).alias("confidence"),
        F.concat(F.lit("m"), k % 3).alias("module"),
        F.array(F.concat(F.lit("col"), k % 9), F.col("c_mktsegment")).alias("affected_columns"),
    )
    steps = rows.select(F.col("id").alias("left"), F.col("unit").alias("a"), F.explode(F.array(*(F.col("id") + s for s in (1, 2, 25)))).alias("right"))
    ties = steps.join(rows.select(F.col("id").alias("right"), F.col("unit").alias("b")), "right").where("a = b")
    reasons = F.array(F.concat(F.lit("r"), F.col("left") % 3), F.concat(F.lit("s"), F.col("right") % 5))
    ties = ties.select("left", "right", ((F.col("left") % 10) / 10.0).alias("weight"), reasons.alias("reasons"))
    return rows, ties, rows.select(F.col("id").alias("vertex"), F.col("unit").alias("community"))


def _case(names: list[str], of: dict[str, float]) -> str:
    return "CASE severity " + " ".join(f"WHEN '{x}' THEN {of[x]}" for x in names) + " END"


def _category_sql() -> str:
    kind = lambda p: f"contains(x, '{p}')" if p in ("outlier", "cluster") else f"x = '{p}'"
    rows = " ".join(f"WHEN len(list_filter(kinds, lambda x: {' OR '.join(map(kind, ps))})) > 0 THEN '{name}'" for name, ps in tables.EVIDENCE_RULES)
    return f"CASE {rows} ELSE '{tables.DEFAULT_CATEGORY}' END"


_TOP = "SELECT unit, string_agg(value, ',' ORDER BY k) AS {0} FROM (SELECT unit, value, row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, value) AS k FROM ({1}) GROUP BY unit, value) WHERE k <= {2} GROUP BY unit"
_EVIDENCE = f"""WITH {_FOUND},
  b AS (SELECT unit, count(*) AS findings, min({_case(_LEVELS, {x: k for k, x in enumerate(_LEVELS)})}) AS worst, round(avg(confidence), 2) AS confidence,
    list_sort(list(DISTINCT module)) AS modules, list_sort(list(DISTINCT category)) AS kinds FROM f GROUP BY unit),
  e AS (SELECT f.unit, count(*) AS ties, avg(weight) AS weight FROM t JOIN f ON f.id = t.x GROUP BY f.unit),
  c AS (SELECT unit, unnest(cols) AS value FROM f), r AS (SELECT f.unit, unnest(reasons) AS value FROM t JOIN f ON f.id = t.x),
  cs AS (SELECT unit, string_agg(DISTINCT value, ',' ORDER BY value) AS columns FROM c GROUP BY unit),
  shown AS ({_TOP.format("shown", "SELECT * FROM c", SHOWN)}), why AS ({_TOP.format("why", "SELECT * FROM r", REASONS)}),
  x AS (SELECT b.*, {_LEVELS}[worst + 1] AS severity, CASE WHEN findings = 1 THEN 1.0 ELSE round(least(1.0, coalesce(weight * 2 * ties / (findings * (findings - 1)), 0)), 4) END::DOUBLE
    AS community FROM b LEFT JOIN e USING (unit))
SELECT unit, findings, {_category_sql()} AS category, severity, confidence, community, round(55 * {_case(_LEVELS, WEIGHTS)} + 25 * confidence + 20 * community, 1)::DOUBLE AS strength,
  columns, array_to_string(modules, ',') AS modules, array_to_string(kinds, ',') AS kinds, shown, coalesce(why, '') AS why
FROM x LEFT JOIN cs USING (unit) LEFT JOIN shown USING (unit) LEFT JOIN why USING (unit)"""


@query("evidence_rollup", _EVIDENCE)
def evidence_rollup(spark, d):
    """Findings made from customers, those of a nation being one unit, with ties between neighbours by key."""
    got = evidence(*_found(spark, d))
    return got.withColumns({c: F.array_join(c, ",") for c in ("columns", "modules", "kinds", "shown", "why")})


@query("trade_communities")
def trade_communities(spark, d):
    """Communities of the graph of customers and suppliers, a tie weighing the lines that one has of the other."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    sold = lines.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").where("l_suppkey is not null and o_custkey is not null")
    edges = sold.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return communities(edges, held=HELD)
