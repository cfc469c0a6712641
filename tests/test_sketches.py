"""Sketch profiles against exact ones, whole and merged."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sifter.operators.sketches import estimates, merge, sketch


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    return e.withColumn("value", F.when(F.col("event_id") % 9 == 0, None).otherwise(F.col("value"))).withColumn("none", F.lit(None).cast("double"))


def near(spark, got: DataFrame, df: DataFrame) -> None:
    exact = df.agg(*(x for c in df.columns for x in (F.countDistinct(c).alias(f"d {c}"), F.count_if(F.col(c).isNull()).alias(f"n {c}")))).first()
    rows = df.count()
    for r in got.collect():
        assert r["rows"] == rows and r.nulls == exact[f"n {r.name}"]
        assert abs(r.distinct - exact[f"d {r.name}"]) <= max(1, 0.06 * exact[f"d {r.name}"])
        if r.quantiles is not None:
            low = [df.agg(F.count_if(F.col(r.name) < q) / F.count(r.name)).first()[0] for q in r.quantiles]
            high = [df.agg(F.count_if(F.col(r.name) <= q) / F.count(r.name)).first()[0] for q in r.quantiles]
            assert all(a - 0.03 <= s <= b + 0.03 for s, a, b in zip((0.25, 0.5, 0.75), low, high, strict=True))


def test_estimates_are_near(spark, events):
    got = estimates(sketch(events))
    near(spark, got, events)
    assert {r.name for r in got.collect() if r.quantiles is None} >= {"event_type", "none"}


def test_merged_days_are_near(spark, events):
    days = [sketch(events.where(F.col("event_id") % 5 == k)) for k in range(5)] + [sketch(events.limit(0))]
    near(spark, estimates(merge(reduce(DataFrame.union, days))), events)


def test_states_are_small_and_alone_are_shuffled(events):
    state = sketch(events)
    size = F.octet_length("distinct") + F.coalesce(F.octet_length("values"), F.lit(0))
    assert state.agg(F.max(size)).first()[0] < 16_000
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in plan


def test_no_rows_and_no_columns(spark, events):
    got = {r.name: r for r in estimates(sketch(events.limit(0))).collect()}
    assert all((r["rows"], r.nulls, r.distinct, r.quantiles) == (0, 0, 0, None) for r in got.values())
    assert sketch(spark.range(3).select()).count() == 0
    odd = spark.createDataFrame([({"a": 1}, float("nan")), ({"a": 1}, 2.0)], "m map<string,int>, x double")
    assert {r.name: (r.nulls, r.distinct) for r in estimates(sketch(odd)).collect()} == {"m": (0, 1), "x": (1, 1)}
