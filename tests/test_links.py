"""Theta self-joins against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sifter.operators import links as ops
from sifter.operators.joins import spread_join
from sifter.operators.links import Likeness, classes, links
from sifter.plans import layers
from sifter.plans import links as plans
from sifter.plans import reasoning

SCHEMA = "id long, a array<string>, b array<string>, x double, key string, name string, listed array<string>"
PLAIN = Likeness(cut=0.4, sets={"a": 0.4, "b": 0.3}, near={"x": 0.2}, same={"key": 0.1})
GATED = Likeness(cut=0.3, sets={"a": 0.4, "b": 0.3}, near={"x": 0.2}, same={"key": 0.1}, gate=("key", "b"), outside=0.2)
LOOSE = Likeness(cut=0.35, sets={"a": 0.5, "b": 0.3}, listed=0.2, gate=("b",), outside=0.9)


def likeness(like: Likeness, p: dict, q: dict) -> float:
    share = lambda u, v: len(set(u) & set(v)) / len(set(u) | set(v)) if u and v else 0.0
    total = sum(w * share(p[c] or [], q[c] or []) for c, w in like.sets.items())
    total += sum(w * (1 - abs(p[c] - q[c])) for c, w in like.near.items() if p[c] is not None and q[c] is not None)
    total += sum(w for c, w in like.same.items() if p[c] is not None and p[c] == q[c])
    total += like.listed * (q["name"] in (p["listed"] or []))
    if not like.gate:
        return total
    met = any(p[c] is not None and p[c] == q[c] if c in like.same else set(p[c] or []) & set(q[c] or []) for c in like.gate)
    return total if met else like.outside * total


def made(n: int, seed: int) -> list[dict]:
    """Small sets over few members, one of which half of the rows have; null and empty sets, null numbers and keys."""
    rng = random.Random(seed)
    pick = lambda p, k: sorted({rng.choice([f"{p}0", f"{p}{rng.randrange(k)}"]) for _ in range(rng.randrange(4))}) or rng.choice([[], None])
    return [
        {"id": 3 * k, "a": pick("a", 12), "b": pick("b", 9), "x": rng.choice([None, 0.0, 0.5, 1.0]), "key": rng.choice([None, "k1", "k2", "k3"]),
         "name": f"n{k % 7}", "listed": rng.choice([None, [], [f"n{rng.randrange(7)}"]])}
        for k in range(n)
    ]


@pytest.mark.parametrize("like", [PLAIN, GATED, LOOSE])
@pytest.mark.parametrize("block", [1024, 8])
def test_links_are_all_pairs_at_the_cut(spark, like, block):
    rows = made(150, 5)
    got = {(r.a, r.b): r.weight for r in links(spark.createDataFrame(rows, SCHEMA).repartition(3), like, block).collect()}
    want = {(p["id"], q["id"]): w for p, q in combinations(rows, 2) if (w := likeness(like, p, q)) >= like.cut - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_each_pair_once(spark):
    got = links(spark.createDataFrame(made(120, 9), SCHEMA), PLAIN, 4)
    assert got.count() == got.select("a", "b").distinct().count() > 0


def test_no_rows_and_no_bound(spark):
    assert links(spark.createDataFrame([], SCHEMA), PLAIN).count() == 0
    with pytest.raises(ValueError, match="all pairs"):
        links(spark.createDataFrame([], SCHEMA), Likeness(cut=0.2, sets={"a": 0.5}, near={"x": 0.3}))


def test_blocks_bound_what_meets(spark):
    """A member that every row must offer is met in blocks: no task's side has much more than a block."""
    rows = [{**r, "a": ["same"], "b": None} for r in made(400, 2)]
    df, block = spark.createDataFrame(rows, SCHEMA), 20
    offered = ops.offers(df, PLAIN)
    assert offered.where("offer = 'a:same'").count() == 400
    own = offered.where("offer = 'a:same'").select("id", F.pmod(F.xxhash64("id"), F.lit(400 // block)).alias("own")).groupBy("own").count()
    assert own.agg(F.max("count")).first()[0] < 2.5 * block
    assert ops.blocks_of(400, block) == 210


def test_frequent_members_are_not_offered(spark):
    """What everybody has is worth less than the cut asks for, so that it brings no two rows together."""
    rows = [{**r, "a": [f"own{r['id']}", f"too{r['id']}", "everywhere"], "b": [f"b{r['id']}"], "key": None} for r in made(200, 4)]
    offered = ops.offers(spark.createDataFrame(rows, SCHEMA), PLAIN)
    assert offered.where("offer = 'a:everywhere'").count() == 0


def test_links_of_a_larger_table(spark):
    """4,000 artifacts: the links of every 100th of them against all are those of brute force."""
    rows = layers.artifacts(spark, "/root/testdata/sf0.1", "orders", "o_orderkey").orderBy("id").limit(4_000).cache()
    for like in (plans.KNOWLEDGE, plans.HYPOTHESES):
        got = links(rows, like)
        asked = got.where("a % 100 = 0 or b % 100 = 0")
        x, y = (rows.select(F.struct("id", *like.columns).alias(s)) for s in ("x", "y"))
        every = F.broadcast(x.where("x.id % 100 = 0")).join(y, F.col("x.id") != F.col("y.id")).where(like.score("x", "y") >= like.cut - 1e-9)
        want = every.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        found = asked.select("a", "b")
        assert found.count() == want.count() == found.intersect(want).count() > 0
    rows.unpersist()


def test_plans_agree_with_the_lists(spark):
    """The likenesses are those that the layers of one dataset's findings use."""
    rows = [r.asDict() for r in layers.artifacts(spark, "/root/testdata/sf0.001").limit(40).collect()]
    df = spark.createDataFrame(rows, layers.artifacts(spark, "/root/testdata/sf0.001").schema)
    items = []
    for r in rows:
        more = {"terms": r["terms"], "categories": r["categories"], "related": r["listed"], "concepts": r["concepts"], "families": r["families"], "workstream": r["workstream"]}
        items.append(reasoning.Item(r["id"], r["name"], r["category"], r["columns"], r["confidence"], r["strength"], r["community"], r["evidence"], more))
    for like, score in ((plans.CONCEPTS, reasoning.knowledge_link), (plans.HYPOTHESES, reasoning.hypothesis_link)):
        got = {(r.a, r.b): r.weight for r in links(df, like).collect()}
        pairs = [sorted(p, key=lambda i: i.id) for p in combinations(items, 2)]
        want = {(a.id, b.id): w for a, b in pairs if (w := score(a, b)) >= like.cut - 1e-9}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_classes(spark):
    rows = [{**r, "id": r["id"] + 1000 * c} for r in made(30, 1) for c in range(3)]
    got = {r.id: r.rep for r in classes(spark.createDataFrame(rows, SCHEMA), PLAIN).collect()}
    key = lambda r: repr([r[c] for c in PLAIN.columns])
    want = {r["id"]: min(x["id"] for x in rows if key(x) == key(r)) for r in rows}
    assert got == want


def test_spread_join_of_a_hot_key(spark):
    big = spark.range(60_000).select((F.col("id") % 3 * (F.col("id") % 7 > 2).cast("int")).alias("k"), "id")
    unique = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("said", F.col("k") * 10)
    got = spread_join(big, unique, "k", "n")
    assert got.count() == 60_000 and got.where("said <> k * 10").count() == 0
    assert spread_join(big.withColumn("j", F.lit(1)), unique.withColumn("j", F.lit(1)), ["k", "j"], "n").count() == 60_000


def test_rare_members_of_the_gate_are_met_alone(spark):
    """A row comes once for each, however many tokens it offers, and no union is made for a pair."""
    df = spark.createDataFrame(made(150, 6), SCHEMA)
    offered = ops.offers(df, GATED)
    times = {r.gate: r["count"] for r in offered.groupBy("gate").agg(F.countDistinct("id").alias("count")).collect()}
    assert 0 < min(times.values()) <= ops.ALONE
    for r in offered.groupBy("gate", "id").count().collect():
        assert r["count"] == 1 or times[r.gate] > ops.ALONE
    got = links(df, GATED)
    x, y = (df.select(F.struct("id", *GATED.columns).alias(s)) for s in ("x", "y"))
    want = x.join(y, F.col("x.id") < F.col("y.id")).where(GATED.score("x", "y") >= GATED.cut - 1e-9).select("x.id", "y.id")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got.select("a", "b")) == key(want)
    assert "array_union" not in got._jdf.queryExecution().optimizedPlan().toString()
