"""Likenesses of evidence, concepts and hypotheses, as theta self-joins; scores over them; all as plans over tables of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.operators.links import Likeness
from sifter.plans import tables

#: What each part of a likeness weighs.
KNOWLEDGE = Likeness(
    cut=tables.KNOWLEDGE_EDGE,
    sets={"words": 0.30, "columns": 0.20, "categories": 0.20},
    near={"confidence": 0.10, "community": 0.10},
    same={"concept": 0.10},
    gate=("concept", "columns"),
    outside=0.20,
)
CONCEPTS = Likeness(cut=tables.HYPOTHESIS_EDGE, sets={"columns": 0.25, "terms": 0.35, "categories": 0.25}, listed=0.15)
HYPOTHESES = Likeness(
    cut=tables.QUEUE_EDGE,
    sets={"columns": 0.20, "concepts": 0.25, "evidence": 0.15, "families": 0.15},
    near={"confidence": 0.10},
    same={"workstream": 0.15},
)


def _added(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, x in parts.items():
        total = total + F.bround(F.lit(weights[name]) * x, 2)
    return total


def confidence(support: DataFrame, against: DataFrame, unknown: DataFrame) -> DataFrame:
    """(id, score): how sure a hypothesis is, in [0, 1]; each part is rounded before the sum.

    support: id, strength, community, modules (an array); against: id, strength; a row for each unit of evidence. unknown: id, what,
    a row for each thing not known. Null strengths count for no mean.
    """
    held = support.groupBy("id").agg(F.avg("strength").alias("strength"), F.avg("community").alias("community"))
    agree = support.select("id", F.explode("modules").alias("m")).groupBy("id").agg(F.countDistinct("m").alias("modules"))
    other = against.groupBy("id").agg(F.avg("strength").alias("other"))
    missing = unknown.groupBy("id").agg(F.countDistinct("what").alias("missing"))
    rows = held.join(agree, "id", "left").join(other, "id", "left").join(missing, "id", "left")
    full = lambda c, n: F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / n)
    parts = {
        "evidence_strength": F.coalesce(F.col("strength"), F.lit(0.0)) / 100,
        "community_strength": F.coalesce(F.col("community"), F.lit(0.0)),
        "cross_investigator_agreement": full("modules", 2),
        "contradicting_evidence": full("other", 100),
        "unknown_evidence": full("missing", 5),
    }
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _added(parts, tables.CONFIDENCE)))
    return rows.select("id", F.round(score, 2).alias("score"))


def priority(items: DataFrame) -> DataFrame:
    """(id, priority) of work items from the columns named in tables.PRIORITY, counts as shares of a full one, within 0 and 100."""
    total = F.lit(0.0)
    for name, w in tables.PRIORITY.items():
        x = F.least(F.lit(1.0), F.col(name) / tables.FULL[name]) if name in tables.FULL else F.col(name)
        total = total + F.lit(w) * x
    return items.select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1).alias("priority"))


def contradictions(hypotheses: DataFrame, units: DataFrame, most: int = 4) -> DataFrame:
    """(hypothesis, unit, place): the strongest units that touch a hypothesis's columns, are not among its evidence and of none
    of its categories; as many as `most`, by strength descending, then title.

    hypotheses: id, columns, categories, evidence (arrays); units: id, title, strength, category, columns. They meet at columns; the
    windows are cut to `most` before they are shuffled.
    """
    wanted = hypotheses.select(F.col("id").alias("hypothesis"), "categories", "evidence", F.explode(F.array_distinct("columns")).alias("column"))
    other = units.select(F.col("id").alias("unit"), "title", "strength", "category", F.explode(F.array_distinct("columns")).alias("column"))
    fits = ~F.array_contains("categories", F.col("category")) & ~F.array_contains("evidence", F.col("unit"))
    met = wanted.join(other, "column").where(fits).select("hypothesis", "unit", "title", "strength").distinct()
    order = Window.partitionBy("hypothesis").orderBy(F.desc("strength"), "title", "unit")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("hypothesis", "unit", "place")
