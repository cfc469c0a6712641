"""Communities found in rounds against those of the driver's lists."""

from __future__ import annotations

import random

import pytest

from sifter.operators.communities import communities
from sifter.operators.graph import greedy_modularity, local_modularity, louvain

SCHEMA = "src long, dst long, weight double"


def groups(rows) -> list[list]:
    out: dict = {}
    for r in rows:
        out.setdefault(r.community, []).append(r.vertex)
    assert all(c == min(g) for c, g in out.items())
    return sorted(map(sorted, out.values()))


@pytest.fixture(scope="module")
def planted():
    """Fifteen groups of twenty, seven of ten edges inside, a hub that a tenth of all vertices know."""
    rng, edges = random.Random(1), {}
    for _ in range(2400):
        a = rng.randrange(300)
        b = a // 20 * 20 + rng.randrange(20) if rng.random() < 0.7 else rng.randrange(300)
        if a != b:
            edges[min(a, b), max(a, b)] = 1.0 + a * b % 3
    edges |= {(0, k): 0.5 for k in range(1, 300, 10)}
    return [(a, b, w) for (a, b), w in sorted(edges.items())]


@pytest.mark.parametrize(("algorithm", "local", "finish"), [("louvain", louvain, 300), ("greedy_modularity", greedy_modularity, 900)])
def test_modularity_is_near_that_of_the_lists(spark, planted, algorithm, local, finish):
    """The first levels run in rounds, the rest on the driver; twice the same for other partitions."""
    df = spark.createDataFrame(planted, SCHEMA)
    got = groups(communities(df.repartition(3), algorithm=algorithm, finish=finish).collect())
    want = local(sorted({x for a, b, _ in planted for x in (a, b)}), planted, 1.0)
    assert sorted(v for g in got for v in g) == sorted(v for g in want for v in g)
    assert local_modularity(got, planted) > local_modularity(want, planted) - 0.02


def test_cliques_lone_vertices_and_rounds_alone(spark):
    rows = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)]
    rows += [(4, 10, 0.1), (4, 10, 0.1), (None, 3, 1.0), (2, 2, 0.5), (1, 11, 0.0), (30, 31, -2.0)]
    vertices = spark.createDataFrame([(50,), (50,), (None,), (0,)], "vertex long")
    got = groups(communities(spark.createDataFrame(rows, SCHEMA), vertices, finish=0).collect())
    assert got == [list(range(5)), list(range(10, 15)), [50]]


def test_no_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert communities(none).count() == 0
    assert groups(communities(none, spark.createDataFrame([(3,), (4,)], "vertex long")).collect()) == [[3], [4]]
    with pytest.raises(ValueError, match="unknown"):
        communities(none, algorithm="other")


def test_edges_are_made_once_and_half_of_them_are_shuffled_a_round(spark, planted, monkeypatch):
    from sifter.operators import communities as module

    made, sent = spark.sparkContext.accumulator(0), []

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    join = module.spread_join
    monkeypatch.setattr(module, "spread_join", lambda big, unique, key, *rest: (sent.append(big.count()) if key == "dst" and "load" in unique.columns else None) or join(big, unique, key, *rest))
    df = spark.createDataFrame(planted, SCHEMA)
    got = groups(communities(df.mapInArrow(passed, df.schema), finish=300).collect())
    assert made.value == len(planted) and sent and sent[0] < 1.3 * len(planted)
    assert got == groups(communities(df, finish=300).collect())


def test_held_vertices_are_not_shuffled_in_rounds(spark, planted, monkeypatch):
    """The same communities as by joins, with names for vertices, loops and lone ones, and levels in rounds alone or finished by the driver."""
    from sifter.operators import communities as module

    rows = [*planted, (5, 5, 2.0), (9, 9, 1.0), (400, 400, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("concat('v', src) as src", "concat('v', dst) as dst", "weight")
    lone = spark.createDataFrame([("v7",), ("w",), (None,)], "vertex string")
    want = {finish: groups(communities(df, lone, finish=finish).collect()) for finish in (0, 300)}

    def moved(*_):
        raise AssertionError("a round of joins")

    monkeypatch.setattr(module, "_moved", moved)
    for finish, groups_by_joins in want.items():
        assert groups(communities(df.repartition(5), lone, finish=finish, held=1000).collect()) == groups_by_joins
        with pytest.raises(AssertionError, match="joins"):  # more vertices than may be held
            communities(df, lone, finish=finish, held=100)
