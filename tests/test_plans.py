"""Row places, lineage and rule tables as plans, against pandas and the driver's own evaluator."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sifter.config import IntegritySettings
from sifter.operators import integrity
from sifter.operators.identity import duplicate_places, place_sample, placed, row_numbers
from sifter.operators.profile import clean, profile, profile_frame
from sifter.operators.sampling import row_sample
from sifter.plans import lineage, ruleplans, tables
from sifter.plans.rules import Facts, first, fitting, split_words


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Rows with many repeats and nulls in three files, one of them empty; the same rows in pandas, files by path."""
    rng, folder, parts = random.Random(4), tmp_path_factory.mktemp("places"), []
    for k, n in enumerate((3000, 0, 1700)):
        part = pd.DataFrame({"a": [rng.choice([None, 1, 2, 3]) for _ in range(n)], "b": [rng.choice(["x", "y", None, f"u{rng.randrange(500)}"]) for _ in range(n)]})
        part["a"] = part["a"].astype("Int64")
        part.astype({"b": "string"}).to_parquet(folder / f"part{k}.parquet", row_group_size=200)
        parts.append(part)
    return str(folder), pd.concat(parts, ignore_index=True)


def test_duplicates_are_those_of_pandas(spark, files):
    path, rows = files
    want = rows.index[rows.duplicated(keep="first")].tolist()
    got = duplicate_places(clean(spark.read.parquet(path))).collect()
    assert sorted(r.row for r in got) == want
    firsts = rows.reset_index().groupby(["a", "b"], dropna=False)["index"].min()
    assert {r.first for r in got} <= set(firsts)
    assert sorted(r.row for r in duplicate_places(spark.read.parquet(path), 100).collect()) == want[:100]


def test_finding_has_row_numbers(spark, files):
    path, rows = files
    df = clean(spark.read.parquet(path))
    found = integrity.duplicates(df, profile_frame(spark, profile(df)), IntegritySettings()).first()
    assert found.affected_rows == rows.index[rows.duplicated(keep="first")].tolist()[:100]
    assert found.evidence["rows_are"] == "numbers"
    held = spark.createDataFrame(df.collect(), df.schema)
    found = integrity.duplicates(held, profile_frame(spark, profile(held)), IntegritySettings()).first()
    assert found.evidence["rows_are"] == "hashes" and len(found.affected_rows) == len(set(found.affected_rows)) > 0


def test_sample_by_place_is_the_same_for_any_partitioning(spark, files):
    path, rows = files
    key = lambda df: sorted(map(str, df.collect()))
    one = key(place_sample(spark.read.parquet(path), 500, seed=7))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        many = spark.read.parquet(path)
        assert many.rdd.getNumPartitions() > 4 and key(place_sample(many, 500, seed=7)) == one and len(one) == 500
        assert key(row_sample(many.select("a", "b"), 500, seed=7)) == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert key(place_sample(spark.read.parquet(path), 500, seed=8)) != one
    assert place_sample(spark.read.parquet(path), 10_000).count() == len(rows)
    plan = place_sample(spark.read.parquet(path), 500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_sample_is_even(spark, files):
    """Over forty seeds each of the rows is drawn about as often."""
    path, rows = files
    at = placed(spark.read.parquet(path))
    numbered = at.join(row_numbers(at), "sifter file").select((F.col("first") + F.col("sifter row")).alias("n"))
    assert sorted(r.n for r in numbered.collect()) == list(range(len(rows)))
    drawn = [place_sample(spark.read.parquet(path).where("b like 'u1%'"), 100, seed=s).groupBy("b").count() for s in range(8)]
    total = drawn[0]
    for x in drawn[1:]:
        total = total.union(x)
    assert total.agg(F.sum("count")).first()[0] == 800


def test_no_places_where_a_row_could_come_twice(spark, files):
    df = spark.read.parquet(files[0])
    assert placed(df.where("a > 1").select("a")) is not None
    for other in (df.union(df), df.join(df.limit(1).withColumnRenamed("b", "c"), "a"), df.groupBy("a").count(), spark.range(5), df.limit(3)):
        assert placed(other) is None and place_sample(other, 1) is None and duplicate_places(other) is None


def test_lineage_of_a_diamond(spark):
    edges = spark.createDataFrame([("w", "h"), ("h", "k1"), ("h", "k2"), ("k1", "e"), ("k2", "e"), ("k2", "e"), ("e", None), (None, "e"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("w",), ("w",), (None,), ("lone",)], "node string")
    paths = lineage.descend(edges, roots)
    assert sorted("/".join(r.path) for r in paths.collect()) == ["lone", "w", "w/h", "w/h/k1", "w/h/k1/e", "w/h/k2", "w/h/k2/e"]
    assert {(r.node, r.depth): r.leaves for r in lineage.below(paths, 3).collect()} == {("w", 0): 1, ("h", 1): 1, ("k1", 2): 1, ("k2", 2): 1}
    titles = spark.createDataFrame([("w", "Work"), ("e", "Evidence")], "node string, title string")
    lines = [r.line for r in lineage.tree(paths, titles).where("root = 'w'").orderBy("place").collect()]
    assert lines == ["Work", "  h", "    k1", "      Evidence", "    k2", "      Evidence"]
    nodes = spark.createDataFrame([("e",), ("y",), ("w",)], "node string")
    assert [r.node for r in lineage.loose(nodes, paths).collect()] == ["y"]
    assert lineage.descend(edges.limit(0), roots.limit(0)).count() == 0


def test_a_cycle_raises(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    with pytest.raises(RuntimeError, match="cycle"):
        lineage.descend(edges, spark.createDataFrame([("a",)], "node string"), deepest=6)


def expected(words: list, kinds: list, columns: list, concepts: list) -> tuple:
    """By the evaluator of the driver's lists."""
    from sifter.plans.reasoning import concept_of, evidence_category, made_concept

    by_unit = Facts.of(words, kinds, columns, concepts)
    own = set(words)
    concept = concept_of(own, kinds, columns)
    made = made_concept(own, kinds, columns)
    title = first(tables.STATEMENTS, by_unit)
    return evidence_category(set(kinds)), concept or made, title and title[0], first(tables.WORKSTREAMS, by_unit), [c[0] for c in fitting(tables.CAUSES, by_unit)]


def test_rule_plans_agree_with_the_lists_and_reach_every_rule(spark):
    facts = ruleplans.facts_of(spark.range(0, 400_000, 37).withColumnRenamed("id", "k"))
    rows = facts.collect()
    got = {r.k: (r.category, r.concept, r.title, r.workstream, r.causes) for r in ruleplans.verdicts(facts).collect()}
    for r in rows:
        assert got[r.k] == expected(r.words, r.kinds, r.columns, r.concepts), r
    seen = [Facts.of(set(r.words).union(*map(split_words, r.columns)), r.kinds, r.columns, r.concepts) for r in rows]
    for table in (tables.CONCEPTS, tables.FAMILIES, tables.ENDINGS, tables.STATEMENTS, tables.WORKSTREAMS, tables.CAUSES):
        for rule in table:
            assert any(rule.holds(f) for f in seen), rule.says


def test_rule_plans_of_null_and_empty_facts(spark):
    rows = [(1, None, None, None, None), (2, [], [], [], []), (3, ["neighbor"], [], ["Neighbor_PCI"], None)]
    df = spark.createDataFrame(rows, "k long, words array<string>, kinds array<string>, columns array<string>, concepts array<string>")
    got = {r.k: r for r in ruleplans.verdicts(df).collect()}
    assert got[1][1:] == got[2][1:] and got[1].concept == "Measurement Telemetry Subsystem"
    assert got[3].concept == expected(["neighbor"], [], ["Neighbor_PCI"], [])[1]
    plan = ruleplans.verdicts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_words(spark):
    df = spark.createDataFrame([("Ab-abc ABC d12 x",), (None,)], "t string")
    assert [sorted(r.w) if r.w else r.w for r in df.select(ruleplans.words_of(F.col("t")).alias("w")).collect()] == [sorted(split_words("Ab-abc ABC d12 x")), None]


def test_a_tree_stops_at_the_depth_it_is_asked_for(spark):
    """Six levels, and a cycle below the third: paths of three levels don't depend on what lies deeper, nor are they joined to it."""
    edges = spark.createDataFrame([*((f"n{k}", f"n{k + 1}") for k in range(6)), ("n0", "m1"), ("n6", "n4")], "parent string, child string")
    roots = spark.createDataFrame([("n0",)], "node string")
    got = {tuple(r.path) for r in lineage.descend(edges, roots, to=3).collect()}
    assert got == {tuple(f"n{k}" for k in range(n)) for n in range(1, 5)} | {("n0", "m1")}
    assert [r.node for r in lineage.descend(edges, roots, to=0).collect()] == ["n0"]
    with pytest.raises(RuntimeError, match="cycle"):
        lineage.descend(edges, roots, deepest=8)


def test_layers_agree_with_paths_of_all_links(spark):
    """Repeated links, null ends, children without leaves, nodes that no root reaches, a customer of two nations: as by descend() and below()."""
    two = "parent string, child string"
    layers = [
        spark.createDataFrame([("w", "n1"), ("w", "n2"), ("w", "n2"), ("z", "n9"), (None, "n1")], two),
        spark.createDataFrame([("n1", "c1"), ("n2", "c1"), ("n2", "c2"), ("n9", "c9"), ("n1", None)], two),
    ]
    rows = [("c1", "l1", "p1"), ("c1", "l1", "p1"), ("c1", "l1", "p2"), ("c1", "l1", None), ("c1", "l2", "p1"), ("c2", "l3", "p1"), ("c2", "l4", None), ("c2", "l4", None)]
    ends = spark.createDataFrame([*rows, ("c9", "l9", "p9"), (None, "l5", "p1"), ("c2", None, "p1")], "parent string, child string, leaf string")
    roots = spark.createDataFrame([("w",), ("w",), (None,)], "node string")
    edges = layers[0].union(layers[1]).union(ends.select("parent", "child")).union(ends.select("child", "leaf"))
    paths = lineage.descend(edges, roots)
    key = lambda df: sorted((r.root, r.node, r.depth, "/".join(r.path)) for r in df.collect())
    *above, last = lineage.levels(layers, roots)
    got = lineage.to_leaves(last, ends)
    for level in (*above, last):
        got = got.union(level)
    assert key(got) == key(paths)
    counts = lambda df: sorted((r.node, r.depth, r.leaves) for r in df.collect())
    assert counts(lineage.below_ends(last, ends)) == counts(lineage.below(paths, 4))


@pytest.mark.parametrize("name", ["provenance", "provenance_counts"])
def test_paths_to_lines_and_parts_are_not_written(spark, name):
    from sifter.plans.queries import Q
    from sifter.sources import shared

    mark = shared.written(spark)
    assert Q[name](spark, "/root/testdata/sf0.001").count()
    made = shared._WRITTEN[spark.sparkContext.applicationId][mark:]
    deepest = max(spark.read.parquet(p).agg(F.max("depth")).first()[0] for p in made)
    assert deepest == 4
