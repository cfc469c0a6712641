"""Ranks, Kendall's tau and components where one value or vertex is most of the table, and where groups are cut more than once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter.functions import stats
from sifter.operators import joins, moments
from sifter.operators.graph import components


def brute_tau(x: np.ndarray, y: np.ndarray) -> float:
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))


@pytest.fixture(scope="module")
def skewed():
    """Nine of ten values of a are zero; b follows a; c is spread wide, with ties and holes."""
    rng = np.random.default_rng(3)
    a = np.where(rng.random(1500) < 0.9, 0.0, rng.integers(1, 400, 1500))
    c = rng.integers(0, 900, 1500).astype(float)
    b = a + rng.normal(size=1500) * 50 + c / 30
    return a, b, c


@pytest.mark.parametrize(("task_rows", "most"), [(1 << 15, 256), (60, 4), (25, 3)])
def test_kendall_cut_again_and_again(spark, skewed, task_rows, most):
    rows = [tuple(map(float, r)) for r in zip(*skewed, strict=True)]
    rows += [(None, 1.0, 2.0), (float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    got = {(r.a, r.b): r.r for r in stats.kendall(df.limit(10_000), ["a", "b", "c"], task_rows=task_rows, most=most).collect()}
    a, b, c = skewed
    assert got["a", "b"] == pytest.approx(brute_tau(a, b), abs=1e-12)
    assert got["a", "c"] == pytest.approx(brute_tau(a, c), abs=1e-12)
    whole = np.r_[b, 1.0, 1.0], np.r_[c, 2.0, 2.0]
    assert got["b", "c"] == pytest.approx(brute_tau(*whole), abs=1e-12)


def test_groups_of_kendall_are_bounded(spark, skewed):
    """No group that a task gets has more rows than asked for, or than there are cells."""
    sizes = []
    held = stats.durable
    stats.durable = lambda df, name: (sizes.append(held(df, name)) or sizes[-1]) if name == "sizes" else held(df, name)
    try:
        df = spark.createDataFrame([(0, float(x), float(y), 1) for x, y in zip(skewed[2], skewed[1], strict=True)], "pair int, x double, y double, w long")
        stats.sign_sums(df, 40, 4).collect()
    finally:
        stats.durable = held
    assert len(sizes) >= 3 and sizes[-1].agg(F.max("m")).first()[0] <= 40
    assert [s.agg(F.max("m")).first()[0] for s in sizes] == sorted((s.agg(F.max("m")).first()[0] for s in sizes), reverse=True)


def test_spearman_of_a_frequent_value(spark, skewed, monkeypatch):
    import pandas as pd

    pdf = pd.DataFrame(dict(zip("abc", skewed, strict=True)))
    pdf["d"] = pdf["b"].where(pdf["c"] > 100)
    df = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, d double")
    for name, value in (("TASK_CELLS", 0), ("RANKS_SENT", 1)):
        monkeypatch.setattr(moments, name, value)
    monkeypatch.setattr(joins, "HOT_SHARE", 2)
    got = {(r.a, r.b): (r.n, r.r) for r in moments.spearman(df, list("abcd")).collect()}
    for (a, b), (n, r) in got.items():
        both = pdf[[a, b]].dropna()
        assert n == len(both) and r == pytest.approx(both[a].rank().corr(both[b].rank()), abs=1e-9)


def test_components_around_a_hub(spark):
    star = spark.range(1, 30_000).selectExpr("0L as src", "id as dst")
    chain = spark.range(50_000, 50_020).selectExpr("id as src", "id + 1 as dst")
    got = components(star.union(chain).union(spark.createDataFrame([(29_999, 40_000)], "src long, dst long")))
    assert {r.component: r["count"] for r in got.groupBy("component").count().collect()} == {0: 30_001, 50_000: 21}


def test_a_large_table_is_read_three_times_for_its_ranks(spark, skewed, monkeypatch):
    """Nulls, counts and products: a pass each, however many columns are ranked, and however many pieces the ranks are cut into."""
    monkeypatch.setattr(moments, "TASK_CELLS", 0)
    monkeypatch.setattr(moments.average_ranks, "__defaults__", (100,))
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    a, b, c = skewed
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, b - c, strict=True)], "a double, b double, c double, d double")
    got = {(r.a, r.b): r.r for r in moments.spearman(df.mapInArrow(passed, df.schema), list("abcd")).collect()}
    monkeypatch.undo()
    want = {(r.a, r.b): r.r for r in moments.spearman(df, list("abcd")).collect()}
    assert got == pytest.approx(want, abs=1e-9) and read.value <= 3 * len(a)


def test_a_batch_is_counted_where_it_is_merged(spark):
    """One table of values in a task: the batch is not counted on its own before; sums are those of all rows, nulls too."""
    from sifter.operators.profile import value_counts
    from sifter.streaming.incremental import merge_counts

    df = spark.range(2_000).selectExpr("id", "id % 7 AS k", "CASE WHEN id % 5 > 0 THEN 'x' || id % 3 END AS t")
    known = spark.createDataFrame(value_counts(df.where("id < 1500")).collect(), "ordinal int, value string, n long")
    merged = merge_counts(known, df.where("id >= 1500"))
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    key = lambda x: sorted(map(str, x.select("ordinal", "value", "n").collect()))
    assert key(merged) == key(value_counts(df))


def test_a_value_finds_its_piece_without_a_look_at_all_cuts(spark):
    """Ranks of many pieces: no row runs through a list of cuts; several keys of other sizes, ties and a frequent value."""
    import pandas as pd

    from sifter.operators.ranks import average_ranks

    rng = np.random.default_rng(5)
    x = {0: rng.integers(-900, 900, 4000) / 8, 1: np.r_[np.zeros(3000), rng.normal(size=300)], 2: np.array([3.0, 3.0])}
    rows = [(k, float(v)) for k, vs in x.items() for v in vs]
    counts = spark.createDataFrame(rows, "k int, v double").groupBy("k", "v").agg(F.count("*").alias("w"))
    got = average_ranks(counts, "k", "v", "w", 100)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(k, v): r for k, vs in x.items() for v, r in zip(vs, pd.Series(vs).rank(), strict=True)}
    assert {(r.k, r.v): r["rank"] for r in got.collect()} == want
