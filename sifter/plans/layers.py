"""Queries for the scores between reasoning layers, over artifacts made from the rows of customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.operators.links import Likeness, classes, links
from sifter.plans import links as plans
from sifter.plans.detect import query, read

#: Columns of an artifact by an expression of k (customer's key), n (its nation) and s (its segment): neighbours by key share members,
#: and segments, remainders and words are members that many rows share.
ARTIFACT = {
    "columns": ["'col' || (k // 16)", "'reg' || (k // 48)"],
    "words": ["'alpha' || (k // 6)", "'beta' || (k % 5)", "'item'", "'col' || (k // 16)"],
    "terms": ["'alpha' || (k // 6)", "'beta' || (k // 40)"],
    "categories": ["'c' || (k // 12)", "'d' || s"],
    "concepts": ["'p' || (k // 10)", "'q' || (k // 45)"],
    "families": ["'f' || (k // 30)", "'n' || (k // 60)"],
    "evidence": ["'e' || (k // 5)", "'g' || (k // 9)"],
    "modules": ["'m' || (k % 2)", "'o' || (k % 3)"],
    "listed": ["'t' || (k // 2 * 2 + 1 - k % 2)"],
}
#: Its other columns.
SINGLE = {
    "name": "'t' || k",
    "category": "'c' || (k // 12)",
    "workstream": "'w' || (k % 3)",
    "concept": "'key' || (k // 8)",
    "confidence": "(k % 50 + 50) / 100.0",
    "community": "(k % 4) / 4.0",
    "strength": "((k * 37) % 101) * 1.0",
}
_BASE = "SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer"
_ROWS = f"""i AS (SELECT k AS id, n, {', '.join(f"[{', '.join(v)}] AS {c}" for c, v in ARTIFACT.items())},
    {', '.join(f'({v})::{"DOUBLE" if c in ("confidence", "community", "strength") else "VARCHAR"} AS {c}' for c, v in SINGLE.items())} FROM ({_BASE}))"""


def artifacts(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """An artifact for each row of a table with a whole-numbered key; sets are sorted."""
    rows = read(spark, sf_dir, table)
    if table == "customer":
        rows = rows.select(F.col(key).alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"))
    else:
        rows = rows.select(F.col(key).alias("k"), (F.col(key) % 25).alias("n"), (F.col(key) % 5).alias("s"))
    said = lambda v: v.replace("k // ", "k div ")
    sets = [F.expr(f"array_sort(array({', '.join(map(said, v))}))").alias(c) for c, v in ARTIFACT.items()]
    numbers = ("confidence", "community", "strength")
    single = [F.expr(said(v)).cast("double" if c in numbers else "string").alias(c) for c, v in SINGLE.items()]
    return rows.select(F.col("k").cast("long").alias("id"), "n", *sets, *single)


def _share(name: str) -> str:
    return f"(1.0 * len(list_intersect(a.{name}, b.{name})) / len(list_distinct(list_concat(a.{name}, b.{name}))))::DOUBLE"


def _sql(like: Likeness) -> str:
    """All pairs, scored."""
    parts = [f"{w} * {_share(c)}" for c, w in like.sets.items()]
    parts += [f"{w} * (1 - abs(a.{c} - b.{c}))" for c, w in like.near.items()]
    parts += [f"CASE WHEN a.{c} = b.{c} THEN {w} ELSE 0 END" for c, w in like.same.items()]
    parts += [f"CASE WHEN list_contains(a.listed, b.name) THEN {like.listed} ELSE 0 END"] if like.listed else []
    met = [f"a.{c} = b.{c}" if c in like.same else f"len(list_intersect(a.{c}, b.{c})) > 0" for c in like.gate]
    score = f"({' + '.join(parts)})" + (f" * CASE WHEN {' OR '.join(met)} THEN 1 ELSE {like.outside} END" if met else "")
    pairs = f"SELECT a.id AS a, b.id AS b, {score} AS weight FROM i a JOIN i b ON a.id < b.id"
    return f"WITH {_ROWS}, s AS ({pairs}) SELECT a, b, round(weight, 3) AS weight FROM s WHERE weight >= {like.cut} - 1e-9"


def _links(spark: SparkSession, d: str, like: Likeness) -> DataFrame:
    return links(artifacts(spark, d), like).select("a", "b", F.round("weight", 3).alias("weight"))


@query("knowledge_links", _sql(plans.KNOWLEDGE))
def knowledge_links(spark, d):
    return _links(spark, d, plans.KNOWLEDGE)


@query("concept_links", _sql(plans.CONCEPTS))
def concept_links(spark, d):
    return _links(spark, d, plans.CONCEPTS)


@query("hypothesis_links", _sql(plans.HYPOTHESES))
def hypothesis_links(spark, d):
    return _links(spark, d, plans.HYPOTHESES)


@query(
    "artifact_classes",
    f"WITH {_ROWS}, k AS (SELECT id, [columns, categories] AS x FROM i) SELECT id, min(id) OVER (PARTITION BY x) AS rep FROM k",
)
def artifact_classes(spark, d):
    """Artifacts that are alike in columns and categories go by one of them."""
    return classes(artifacts(spark, d), Likeness(cut=0.5, sets={"columns": 0.5, "categories": 0.5}))


_CONFIDENCE = f"""WITH {_ROWS}, h AS (SELECT unnest(concepts) AS h, * FROM i WHERE id % 3 > 0),
  a AS (SELECT unnest(concepts) AS h, avg(strength) AS other FROM i WHERE id % 3 = 0 GROUP BY 1),
  u AS (SELECT unnest(concepts) AS h, count(DISTINCT id % 11) AS missing FROM i WHERE id % 7 = 0 GROUP BY 1),
  m AS (SELECT h, count(DISTINCT x) AS modules FROM (SELECT h, unnest(modules) AS x FROM h) GROUP BY h),
  g AS (SELECT h, avg(strength) AS strength, avg(community) AS community FROM h GROUP BY h),
  p AS (SELECT g.h, round_even(0.38 * (strength / 100), 2) + round_even(0.27 * community, 2) + round_even(0.22 * least(1.0, modules / 2.0), 2)
    + round_even(-0.08 * least(1.0, coalesce(other, 0) / 100), 2) + round_even(-0.05 * least(1.0, coalesce(missing, 0) / 5.0), 2) AS s
    FROM g JOIN m ON m.h = g.h LEFT JOIN a ON a.h = g.h LEFT JOIN u ON u.h = g.h)
SELECT h AS id, round(greatest(0, least(1, s)), 2)::DOUBLE AS score FROM p"""


@query("confidence_score", _CONFIDENCE)
def confidence_score(spark, d):
    """For each concept: two of three artifacts that name it support it, the third contradicts it, every seventh leaves something open."""
    named = artifacts(spark, d).select(F.col("id").alias("k"), F.explode("concepts").alias("id"), "strength", "community", "modules")
    unknown = named.where("k % 7 = 0").select("id", (F.col("k") % 11).alias("what"))
    return plans.confidence(named.where("k % 3 > 0"), named.where("k % 3 = 0"), unknown)


_PRIORITY = f"""WITH {_ROWS} SELECT id, round(greatest(0, least(100, 0.30 * strength + 20 * confidence / 7.3 + 15 * least(1.0, (id % 10) / 8.0)
    + 15 * ((n % 5) / 4.0) + 10 * least(1.0, (id % 3) / 2.0)
  + 10 * least(1.0, (id % 7) / 3.0) + 10 * community - 20 * ((id % 2) / 2.0))), 1)::DOUBLE AS priority FROM i"""


@query("priority_score", _PRIORITY)
def priority_score(spark, d):
    k = F.col("id")
    counts = {"columns": k % 10, "modules": k % 3, "hypotheses": k % 7}
    parts = {"confidence": F.col("confidence") / 7.3, "severity": (F.col("n") % 5) / 4, "cohesion": F.col("community"), "contradiction": (k % 2) / 2}
    return plans.priority(artifacts(spark, d).withColumns(counts | parts))


_CONTRA = f"""WITH {_ROWS}, x AS (SELECT h.id AS hypothesis, u.id AS unit, row_number() OVER (PARTITION BY h.id ORDER BY u.strength DESC, u.name, u.id) AS place
  FROM i h JOIN i u ON len(list_intersect(h.columns, u.columns)) > 0 AND NOT list_contains(h.categories, u.category) AND h.id <> u.id
  WHERE h.id % 10 = 0)
SELECT hypothesis, unit, place::INT AS place FROM x WHERE place <= 4"""


@query("contradictions", _CONTRA)
def contradictions(spark, d):
    """For every tenth artifact, as a hypothesis with itself as evidence, the four strongest others that touch its columns and are of no
    category of its."""
    units = artifacts(spark, d).withColumnRenamed("name", "title")
    asked = units.where("id % 10 = 0").withColumn("evidence", F.array("id"))
    return plans.contradictions(asked, units)
