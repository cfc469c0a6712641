"""Detectors, statistics and reasoning on small frames with known answers."""

from __future__ import annotations

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sifter import cli, engine
from sifter.config import CompressionSettings, EngineSettings, IntegritySettings, RelationshipSettings, Settings
from sifter.engine import Engine, Module, RegistrationError, register
from sifter.functions import scalars, stats
from sifter.operators import findings as found
from sifter.operators import graph, integrity, moments, ranks, relationship, sampling, similarity
from sifter.operators.profile import clean, profile, profile_table
from sifter.plans import compare, queries, reasoning, rules, tables
from sifter.sources import loader, sinks
from sifter.streaming import incremental

I, R = IntegritySettings(), RelationshipSettings()
DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark, rows, schema):
    return clean(spark.createDataFrame(rows, schema))


def categories(df):
    return {r.category for r in df.collect()}


def test_profile_and_missing(spark):
    df = frame(
        spark,
        [(i, None if i % 3 == 0 else float(i), None if i % 2 == 0 else math.nan if i == 1 else 1.0, "") for i in range(1000)],
        "clean long, moderate double, severe double, text string",
    )
    p = profile(df)
    assert [c.null_count for c in p.columns] == [0, 334, 501, 0] and p.column("clean").unique_count == 1000 and p.duplicate_rows == 0
    got = {r.affected_columns[0]: r.severity for r in integrity.missing_values(df, profile_table(df), I).collect()}
    assert got == {"moderate": "high", "severe": "critical"}


def test_empty_frame(spark):
    df = frame(spark, [], "a long, b string")
    p = profile(df)
    assert p.row_count == 0 and not p.has_missing
    r = Engine(spark).investigate_dataframe(df)
    assert [e.status for e in r.executions] == ["skipped", "skipped"] and r.reasoning.queue == []


def test_empty_column(spark):
    df = frame(spark, [(i, None) for i in range(100)], "normal long, empty string")
    (r,) = integrity.empty_columns(df, profile_table(df), I).collect()
    assert r.severity == "critical" and r.affected_columns == ["empty"]


def test_duplicates(spark):
    df = frame(spark, [(i, i) for i in [*range(80), *range(20)]], "a long, b long")
    (r,) = integrity.duplicates(df, profile_table(df), I).collect()
    assert r.evidence["duplicate_count"] == "20" and r.severity == "critical"
    swapped = frame(spark, [(None, 1), (1, None), (None, None)], "a long, b long")
    assert profile(swapped).duplicate_rows == 0


def test_duplicate_features(spark):
    df = frame(
        spark,
        [(i, i, None if i == 3 else i, None if i == 3 else i, str(i)) for i in range(100)],
        "original long, copy long, hole long, hole2 long, text string",
    )
    assert sorted(
        tuple(r.affected_columns) for r in integrity.duplicate_features(df, profile_table(df), I).collect()
    ) == [("copy", "original"), ("hole", "hole2")]


def test_identifiers(spark):
    df = frame(spark, [(None if i < 2 else float(i), i) for i in range(100)], "record_id double, value long")
    (r,) = integrity.identifier_integrity(df, profile_table(df), I).collect()
    assert r.evidence["null_count"] == "2" and r.severity == "medium"
    few = frame(spark, [(i % 9, i) for i in range(100)], "user_id long, value long")
    assert integrity.identifier_integrity(few, profile_table(few), I).count() == 0


def test_constants(spark):
    df = frame(spark, [(42, 1 if i < 970 else 2, i) for i in range(1000)], "constant long, near long, normal long")
    p = profile_table(df)
    assert integrity.constant_features(df, p, I).first().affected_columns == ["constant"]
    (r,) = integrity.near_constants(p, I).collect()
    assert r.name == "near" and r.share == 0.97


def test_types(spark):
    df = frame(
        spark,
        [(str(i / 2), "word" if i % 5 == 0 else str(i), f"text {i}") for i in range(100)],
        "numbers string, mixed string, words string",
    )
    got = {(r.affected_columns[0], r.severity) for r in integrity.datatype_integrity(df, profile_table(df), I).collect()}
    kinds = {(r.name, r.kind): r.n for r in integrity.text_kinds(df, I).collect()}
    assert kinds["mixed", "numeric"] == 80 and kinds["mixed", "string"] == 20
    assert sum(r.n for r in integrity.text_kinds(df, IntegritySettings(type_sample=40)).where("name = 'mixed'").collect()) == 40
    assert ("numbers", "high") in got and ("mixed", "medium") in got and not any(c == "words" for c, _ in got)


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("1", "numeric"),
        ("-2.5e3", "numeric"),
        ("1_000", "numeric"),
        ("nan", "numeric"),
        ("inf", "numeric"),
        ("1d", "string"),
        ("1.0f", "string"),
        ("", "empty"),
        ("  ", "empty"),
        ("Yes", "boolean"),
        ("2024-01-05", "datetime"),
        (".", "string"),
        ("e5", "string"),
        ("abc", "string"),
    ],
)
def test_value_type(spark, value, kind):
    assert spark.range(1).select(scalars.value_type(F.lit(value)).alias("k")).first().k == kind


def test_cardinality(spark):
    df = frame(
        spark,
        [(f"v{i}", "abc"[i % 3], i % 2, "xy"[i % 2]) for i in range(1000)],
        "high string, three string, flag long, two string",
    )
    got = {r.affected_columns[0]: r.severity for r in integrity.cardinality(df, profile_table(df), I).collect()}
    assert got == {"high": "medium", "two": "info"}


def test_joint_missingness(spark):
    df = frame(
        spark,
        [(None if i % 5 == 0 else 1.0 * i, None if i % 5 == 0 else 2.0 * i, i) for i in range(1000)],
        "a double, b double, c long",
    )
    (r,) = integrity.missingness_correlation(df, profile_table(df), I).collect()
    assert r.affected_columns == ["a", "b"] and r.missingness_correlation == 1.0 and r.evidence["both_missing"] == "200"


def test_health(spark):
    rows = [("x", c, s) for c, s in (("missing_values", "critical"), ("missing_values", "high"), ("cardinality", "low"))]
    df = spark.createDataFrame(rows, "id string, category string, severity string")
    weights = sum(integrity.DOMAINS.values())
    want = (100 * weights - 40 * 0.25 - 3 * 0.15) / weights
    assert integrity.health_score(df).first().score == round(want, 1)
    assert integrity.health_score(df.where("false"), ("cardinality",)).first().score == round((100 * weights - 50 * 0.15) / weights, 1)


def numbers(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    return [
        (float(a), float(3 * a), float(math.exp(a * 3)), float(b), None if i % 4 == 0 else float(-a), 1.0)
        for i, (a, b) in enumerate(zip(x, rng.normal(size=n), strict=True))
    ]


COLS = ["x", "triple", "curve", "noise", "holes", "fixed"]


def test_correlations_against_numpy(spark):
    import pandas as pd

    df = frame(spark, numbers(), ", ".join(f"{c} double" for c in COLS))
    pdf = pd.DataFrame(numbers(), columns=COLS)
    ranks = lambda a, b: pdf[[a, b]].dropna().rank().corr().iloc[0, 1]
    for r in moments.pearson(df, COLS).collect():
        want = pdf[[r.a, r.b]].dropna().astype(float).corr().iloc[0, 1]
        assert r.r is None if math.isnan(want) else abs(r.r - want) < 1e-9
    for r in moments.spearman(df, COLS[:5]).collect():
        assert abs(r.r - ranks(r.a, r.b)) < 1e-9
    wide = {(r.a, r.b): r.r for r in moments._gram(df, COLS, 30).collect()}
    assert all(
        (wide[r.a, r.b] is None) == (r.r is None) and (r.r is None or abs(wide[r.a, r.b] - r.r) < 1e-9)
        for r in moments.pearson(df, COLS).collect()
    )
    assert moments.pearson(df.limit(10), COLS).where("r is not null").count() == 0


def test_p_value():
    # Student's t with 8 degrees: a correlation of 0.6319 over 10 rows is the 5 % point; 3 rows have one degree.
    assert abs(moments.p_value(0.6319, 10) - 0.05) < 1e-4 and moments.p_value(1.0, 10) == 0.0 and moments.p_value(0.0, 50) == 1.0
    assert abs(moments.p_value(math.sqrt(0.5), 3) - 0.5) < 1e-9


def test_vif(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.normal(size=500)
    rows = [(float(x), float(y), float(2 * x - 0.5 * y + 0.001 * z)) for x, y, z in zip(a, b, rng.normal(size=500), strict=True)]
    got = dict(moments.vif(frame(spark, rows, "x1 double, x2 double, x3 double"), ["x1", "x2", "x3"]))
    assert got["x3"] > 10
    same = frame(spark, [(float(x), float(x)) for x in a], "p double, q double")
    assert all(abs(v - 1) < 1e-9 for _, v in moments.vif(same, ["p", "q"]))


def test_information(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, 600)
    assert moments.mi_continuous(x, x * x + 0.05 * rng.normal(size=600)) > 0.8 and moments.mi_continuous(x, rng.normal(size=600)) < 0.15
    r = 0.8
    g = rng.multivariate_normal([0, 0], [[1, r], [r, 1]], 3000)
    assert abs(moments.mi_continuous(g[:, 0], g[:, 1]) + 0.5 * math.log(1 - r * r)) < 0.08
    assert moments.mi_classes(x, (x > 0).astype(float)) > 0.6 and moments.mi_classes(x, rng.integers(0, 2, 600).astype(float)) < 0.1
    df = frame(
        spark,
        [(float(a), float(a * a), float(b)) for a, b in zip(x, rng.normal(size=600), strict=True)],
        "x double, square double, noise double",
    )
    got = relationship.pairwise_information(df, profile(df), ["x", "square", "noise"], R)
    assert [g[:2] for g in got] == [("square", "x")]


def test_groups():
    pair = lambda a, b, r: {"a": a, "b": b, "pearson": r, "spearman": None, "p_value": 0.0, "mi": None, "n": 100}
    got = {(k, tuple(g)) for k, g, _ in relationship.feature_groups([pair("a", "b", 0.99), pair("b", "c", -0.92), pair("c", "d", 0.8)], R)}
    assert got == {("redundant_features", ("a", "b")), ("strong_group", ("a", "b", "c")), ("feature_community", ("a", "b", "c", "d"))}


def test_row_sample_is_exact_and_stable(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    one, two = (sorted(r.id for r in moments.row_sample(df.repartition(k), 100).collect()) for k in (3, 11))
    assert one == two and len(one) == 100


def test_statistics(spark):
    df = frame(spark, [(1.0,), (2.0,), (2.0,), (10.0,), (4.0,), (None,)], "v double")
    assert abs(stats.skewness(df, "v").first()[0] - 1.7789) < 1e-3
    assert stats.coefficient_of_variation(frame(spark, [(-1.0,), (1.0,)], "v double"), "v").first()[0] == math.inf
    assert stats.iqr_bounds(frame(spark, [(1.0,)], "v double"), "v").first().low == -math.inf
    assert [r.z for r in stats.z_scores(frame(spark, [(3.0,), (3.0,)], "v double"), "v").collect()] == [0.0, 0.0]
    assert stats.cohens_d(frame(spark, [(1.0, 1)], "v double, g int"), "v", F.col("g") == 1).first().d == 0.0
    assert stats.entropy(frame(spark, [("a",), ("b",), (None,)], "v string"), "v").first().bits == 1.0
    two = frame(spark, [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 10 + [("b", "y")] * 30, "p string, q string")
    assert abs(stats.cramers_v(two, "p", "q").first().v - math.sqrt(80 * (30 * 30 - 100 - 40) ** 2 / 40**4 / 80)) < 1e-9
    rng = np.random.default_rng(5)
    normal, skewed = frame(spark, [(float(x),) for x in rng.normal(size=200)], "v double"), frame(
        spark,
        [(float(x),) for x in rng.exponential(size=200)],
        "v double",
    )
    for small in (5000, 10):
        assert stats.normality(normal, "v", small=small)[0] and not stats.normality(skewed, "v", small=small)[0]
    assert stats.normality(df.limit(3), "v") == (True, 1.0)
    t = stats.kendall(frame(spark, [(float(i), float(i * i)) for i in range(40)], "a double, b double"), ["a", "b"]).first()
    assert t.r == 1.0


def test_graph(spark):
    e = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)]
    nodes = list("abcdef")
    two = [["a", "b", "c"], ["d", "e", "f"]]
    assert graph.louvain(nodes, e) == two and graph.greedy_modularity(nodes, e) == two and graph.louvain(nodes, []) == [[v] for v in nodes]
    df = spark.createDataFrame(e, "src string, dst string, weight double")
    member = spark.createDataFrame([(v, int(v > "c")) for v in nodes], "vertex string, community int")
    m = 6.1
    assert abs(graph.modularity(df, member).first().modularity - (6 / m - 2 * (6.1 / (2 * m)) ** 2)) < 1e-9
    got = {
        r.vertex: r.component
        for r in graph.components(df.where("weight = 1"), spark.createDataFrame([("z",)], "vertex string")).collect()
    }
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "z": "z"}


def finding_rows(spark, rows):
    return found.finding(
        spark.createDataFrame(rows, "m string, c string, t string, s string, conf double, cols array<string>, r double"),
        "x",
        "x",
        title=F.col("t"),
        description=F.lit("d"),
        severity=F.col("s"),
        confidence=F.col("conf"),
        columns=F.col("cols"),
        recommendation="r",
        evidence={"m": F.col("m"), "c": F.col("c")},
        correlation_coefficient=F.col("r"),
    ).withColumns({"module": F.element_at("evidence", F.lit("m")), "category": F.element_at("evidence", F.lit("c"))})


def test_similarity_and_reasoning(spark):
    rows = [
        (
            "relationship",
            "correlation",
            f"neighbor{k} pair",
            "medium",
            0.9,
            ["neighbor1_rsrp", "neighbor1_rsrq", "neighbor1_sinr"],
            0.9,
        )
        for k in range(6)
    ]
    rows += [
        ("integrity", "identifier_integrity", "Identifier 'account_id'", "critical", 0.85, ["account_id"], None),
        ("integrity", "missing_values", "Missing values in 'neighbor1_rsrp'", "high", 1.0, ["neighbor1_rsrp"], None),
    ]
    df = finding_rows(spark, rows)
    r = reasoning.reason(df)
    m = r.metrics()
    assert m["evidence"] < m["findings"] and m["work_items"] <= m["hypotheses"] <= m["knowledge"] <= m["evidence"]
    assert {i for e in r.evidence for i in e.below} == {f["id"] for f in r.findings}
    for h in r.hypotheses:
        assert round(min(1.0, max(0.0, sum(h.breakdown.values()))), 2) == h.confidence
    again = reasoning.reason(df.repartition(3))
    assert [i.id for i in again.queue] == [i.id for i in r.queue] and r.tree(r.queue[0])
    top = {i.category: i.priority for i in r.queue}
    assert top["Identifier Integrity Failure"] >= 0
    pair = similarity.scores(df.limit(1))
    assert pair.count() == 0
    with pytest.raises(ValueError):
        CompressionSettings(algorithm="other")
    assert [x["variant"] for x in compare.ablations(df, Settings())] == list(compare.VARIANTS)
    raw, rules, by_graph = compare.methods(df, Settings())
    assert raw["evidence"] == 8 and rules["evidence"] < 8 and by_graph["evidence"] == m["evidence"] and rules["deterministic"] and by_graph["deterministic"]


def test_engine_on_messy_data(spark):
    rng = random.Random(1)
    rows = [
        (
            i if i % 100 else 1,
            None if i % 2 else 1.0 * i,
            None,
            "on",
            "a" if i % 50 else "b",
            f"{i / 10}",
            f"text {i}",
            float(i),
            float(i),
            rng.random(),
        )
        for i in range(500)
    ]
    df = spark.createDataFrame(
        rows,
        "record_id long, high_missing double, empty string, status string, near string, price string, words string, m double, "
        "m_copy double, noise double",
    )
    r = Engine(spark).investigate_dataframe(df, name="messy")
    assert {
        "missing_values",
        "constant_features",
        "structural_health_score",
        "duplicate_features",
        "datatype_integrity",
        "correlation",
    } <= categories(r.findings)
    assert all(e.status == "success" for e in r.executions) and r.reasoning.queue[0].priority > 0 and r.reasoning.queue[-1].priority == 0
    assert json.loads(json.dumps(r.document(), default=str))["dataset"]["row_count"] == 500
    capped = Engine(spark, Settings(engine=EngineSettings(max_findings=2))).investigate_dataframe(df)
    assert capped.by_module("integrity").count() == 3 and "structural_health_score" in categories(capped.findings)


def test_failures_are_isolated(spark):
    class Broken(Module):
        name = "broken"

        def investigate(self, df, p):
            raise RuntimeError("no")

    register(Broken)
    try:
        with pytest.raises(RegistrationError):
            register(Broken)
        r = Engine(spark).investigate_dataframe(spark.range(50).toDF("a"), modules=["broken", "integrity", "unknown"])
        assert [(e.module, e.status) for e in r.executions] == [("broken", "failed"), ("integrity", "success")]
    finally:
        from sifter.engine import REGISTRY

        del REGISTRY["broken"]


def test_a_failure_is_no_result(spark, monkeypatch):
    """The investigate queries raise what fails in a module or in one of its domains; without fail_fast the executions name it."""

    def broken(*a, **k):
        raise RuntimeError("no")

    def late(df, table, s):
        return integrity.constant_features(df, table, s).withColumn("title", F.raise_error(F.lit("no")).cast("string"))

    df = spark.range(50).select("id", F.lit(1.5).alias("c"))
    monkeypatch.setattr(queries, "prices", lambda *_: df.withColumn("b", F.col("id") * 2))
    monkeypatch.setattr(queries, "labelled", lambda *_: df)
    with monkeypatch.context() as m:
        m.setattr(relationship, "correlated_pairs", broken)
        with pytest.raises(RuntimeError, match="no"):
            queries.queries()["investigate_prices"](spark, DATA)
    for detector in (broken, late):
        with monkeypatch.context() as m:
            m.setitem(integrity.DETECTORS, "constant_features", [detector])
            with pytest.raises(Exception, match="no"):
                queries.queries()["investigate_labelled"](spark, DATA)
    r = Engine(spark).investigate_dataframe(df, modules=["integrity"])
    assert [(e.status, e.message) for e in r.executions] == [("success", "")]
    with monkeypatch.context() as m:
        m.setitem(integrity.DETECTORS, "constant_features", [broken])
        r = Engine(spark).investigate_dataframe(df, modules=["integrity"])
    assert [(e.status, e.message) for e in r.executions] == [("partial", "failed: constant_features")]
    assert "structural_health_score" in categories(r.findings)


def test_loader_and_cli(spark, tmp_path, capsys):
    path = tmp_path / "some.csv"
    path.write_text("a,b,c\n" + "".join(f"{i},{2 * i},{'x' if i % 3 else ''}\n" for i in range(60)))
    (tmp_path / "some.tsv").write_text("a\tb\n1\t2\n")
    df, meta = loader.load(spark, str(path), 10)
    assert df.count() == 10 and meta["sampled"] and dict(df.dtypes)["a"] == "int"
    assert loader.read(spark, str(tmp_path / "some.tsv")).columns == ["a", "b"]
    for bad in ("x.unknown", str(tmp_path / "absent.csv")):
        with pytest.raises(loader.LoadError):
            loader.load(spark, bad, 10)
    with pytest.raises(loader.LoadError):
        loader.jdbc_options("postgresql://u:p@h/db", "t; drop", None)
    o = loader.jdbc_options("postgres://u:p@h:1/db", None, "select 1")
    assert o["url"] == "jdbc:postgresql://h:1/db" and o["query"] == "select 1" and loader.redacted(
        "postgres://u:p@h/db",
    ) == "postgres://h/db" and loader.name_of("postgres://u:p@h/db") == "db"
    out = tmp_path / "out.json"
    assert cli.main(
        ["investigate", str(path), "--explain", "--metrics", "--output", str(out)],
        spark,
    ) == 0 and json.loads(out.read_text())["findings"]
    assert cli.main(["info"]) == 0 and cli.main(["schema"]) == 0 and "integrity" in capsys.readouterr().out


def test_sinks(spark, tmp_path):
    rows = [{"a": 1, "b": {"x": [1, 2]}}, {"c": "p|q_&"}]
    made = sinks.table_bundle(str(tmp_path), "t", rows, "T")
    assert len(made) == 4 and "\\_" in (tmp_path / "t.tex").read_text() and "\\|" in (tmp_path / "t.md").read_text() and (tmp_path / "t.csv").read_text().splitlines()[0] == "a,b,c"
    with pytest.raises(ValueError):
        sinks.write_report(str(tmp_path / "t.xml"), rows)
    assert sinks.markdown_table([]) == "_no rows_\n"
    flat = sinks.flatten(spark.sql("select named_struct('x', 1, 'y', named_struct('z', 2)) as s, 3 as t"))
    assert flat.columns == ["s_x", "s_y_z", "t"] and sinks.flatten_dict({"s": {"y": {"z": 2}}}) == {"s_y_z": 2}
    made = sinks.GraphExport([("a", "A <1>"), ("b", "B")], [("a", "b", 0.5)]).write(str(tmp_path / "g"))
    import xml.dom.minidom

    for path in made:
        if path.endswith((".svg", ".graphml", ".gexf")):
            xml.dom.minidom.parse(path)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, None if i % 4 == 0 else "x") for i in range(100)], "a long, b string")
    for k in range(3):
        df.where(f"a % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    q = incremental.profile_stream(
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")),
        str(tmp_path / "state"),
        lambda p, epoch: got.append(sorted(map(tuple, p.collect()))),
    )
    q.awaitTermination(120)
    assert len(got) == 3 and got[-1] == [(0, 100, 0, 5), (1, 100, 25, 1)]


def test_queries_against_sql(spark):
    """A few of the registered queries and their SQL, on the same tables (the rest go through the same comparison elsewhere)."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name in ("missing_values", "pearson", "low_cardinality", "finding_similarity", "severity_histogram", "cramers_v"):
        got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        norm = lambda d: sorted(map(repr, d[cols].astype(object).itertuples(index=False, name=None)))  # noqa: B023, E731
        assert norm(got) == norm(want), name


def test_kendall_takes_all_rows(spark):
    """tau-b of more rows than a sample held, with ties, nulls and a constant, whatever the cuts."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 60, 6000).astype(float), rng.normal(size=6000)
    y = np.where(rng.random(6000) < 0.3, np.round(x / 9), y + x / 20)
    rows = [(float(a), None if k % 50 == 0 else float(b), 1.0) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df, keep = frame(spark, rows, "a double, b double, c double"), np.arange(6000) % 50 != 0
    dx, dy = (np.sign(v[keep][:, None] - v[keep][None]) for v in (x, y))
    want = (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())
    for task_rows in (1 << 15, 100):
        got = {(r.a, r.b): (r.n, r.r) for r in stats.kendall(df, ["a", "b", "c"], task_rows=task_rows).collect()}
        assert got["a", "b"][0] == keep.sum() and abs(got["a", "b"][1] - want) < 1e-9 and got["a", "c"] == (6000, None)


def test_sample_draws_rows_not_values(spark):
    """Of many rows of few values each value keeps its share, whatever the partitioning, and no row is drawn twice."""
    df = spark.range(200_000).select((F.col("id") % 5).alias("v"), F.when(F.col("id") % 10 == 0, 1).alias("w"))
    got = sampling.row_sample(df, 20_000).groupBy("v").agg(F.count("*").alias("n"), F.count("w").alias("w")).collect()
    assert sum(r.n for r in got) == 20_000 and all(abs(r.n - 4000) < 300 for r in got) and abs(sum(r.w for r in got) - 2000) < 200
    again = sampling.row_sample(df.repartition(7, "v"), 20_000).groupBy("v").agg(F.count("*").alias("n"), F.count("w").alias("w"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
    one = sampling.row_sample(spark.range(150_000).select(F.lit("same").alias("s"), F.col("id")), 999)
    assert one.count() == 999 and one.distinct().count() == 999
    assert sampling.row_sample(df, 300_000).count() == 200_000 and sampling.row_sample(df.where("false"), 5).count() == 0


def test_balanced_profile_finds_what_full_finds(spark):
    """Above the row budgets: joint missingness, and correlation over three values."""
    holes = spark.range(200_000).select("id", *(F.when(F.col("id") % 4 != 0, F.col("id") * k).alias(f"h{k}") for k in (1, 2)))
    table = profile_table(holes)
    full, balanced = (integrity.missingness_edges(holes, table, I, full=f).collect() for f in (True, False))
    assert [(r.a, r.b, r.r) for r in full] == [("h1", "h2", 1.0)] and [(r.a, r.b) for r in balanced] == [("h1", "h2")]
    few = spark.range(120_000).select((F.col("id") % 3).alias("x"), (2 * (F.col("id") % 3)).alias("y"))
    (pair,) = relationship.correlated_pairs(few, ["x", "y"], R)
    assert abs(pair["pearson"] - 1) < 1e-9 and abs(pair["spearman"] - 1) < 1e-9


def test_ranks_and_quantiles_in_pieces(spark):
    """Cut into pieces, ranks and quantiles are those of the whole."""
    import pandas as pd

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=5000), 2)
    counts = spark.createDataFrame(
        [(0, float(v)) for v in x] + [(1, 3.0)],
        "k int, v double",
    ).groupBy("k", "v").agg(F.count("*").alias("w"))
    want = dict(zip(x, pd.Series(x).rank(), strict=True))
    for most in (1 << 18, 50):
        got = {(r.k, r.v): r["rank"] for r in ranks.average_ranks(counts, "k", "v", "w", most).collect()}
        assert got[1, 3.0] == 1 and all(got[0, v] == want[v] for v in want)
    df = frame(spark, [(float(v),) for v in rng.exponential(size=4001)] + [(None,), (math.nan,)], "v double")
    values = np.array([r.v for r in df.where("v is not null").collect()])
    for most in (1 << 18, 100):
        assert np.allclose(ranks.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], most), np.quantile(values, [0, 0.25, 0.5, 0.9, 1]))
    assert ranks.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_spearman_over_shuffled_ranks(spark, monkeypatch):
    """The plan for tables that no task holds gives what one task gives, with nulls and without, with broadcast ranks and without."""
    df = frame(spark, numbers(), ", ".join(f"{c} double" for c in COLS))
    want = {(r.a, r.b): (r.n, r.r) for r in moments.spearman(df, COLS).collect()}
    monkeypatch.setattr(moments, "TASK_CELLS", 0)
    for sent in (1 << 20, 0):
        monkeypatch.setattr(moments, "RANKS_SENT", sent)
        got = {(r.a, r.b): (r.n, r.r) for r in moments.spearman(df, COLS).collect()}
        assert got.keys() == want.keys()
        for k, (n, r) in got.items():
            assert n == want[k][0] and (r is None) == (want[k][1] is None) and (r is None or abs(r - want[k][1]) < 1e-9)


def test_cramers_v_without_empty_cells(spark):
    rng = random.Random(6)
    rows = [(f"a{(k := rng.randrange(9))}", f"b{k if rng.random() < 0.5 else rng.randrange(30)}") for _ in range(2000)] + [(None, "b1")]
    cells = {(a, b): sum(x == (a, b) for x in rows) for a, b in rows if a}
    n = sum(cells.values())
    left, right = ({k: sum(v for c, v in cells.items() if c[i] == k) for k in {c[i] for c in cells}} for i in (0, 1))
    chi2 = sum((cells.get((a, b), 0) - left[a] * right[b] / n) ** 2 / (left[a] * right[b] / n) for a in left for b in right)
    got = stats.cramers_v(frame(spark, rows, "p string, q string"), "p", "q").first().v
    assert abs(got - math.sqrt(chi2 / n / (min(len(left), len(right)) - 1))) < 1e-9
    assert stats.cramers_v(frame(spark, [("a", "x")] * 9, "p string, q string"), "p", "q").first().v == 0.0


def test_settings_are_checked(monkeypatch):
    for bad in (
        lambda: EngineSettings(max_findings=501),
        lambda: EngineSettings(profile="fast"),
        lambda: IntegritySettings(empty=1.5),
        lambda: IntegritySettings(missing=(0.1, 0.2, 0.3, 0.4)),
        lambda: RelationshipSettings(vif=(5.0, 10.0)),
    ):
        with pytest.raises(ValueError):
            bad()
    monkeypatch.setenv("SIFTER_INTEGRITY__MISSING", "0.9, 0.5,0.2,0.1")
    monkeypatch.setenv("SIFTER_ENGINE__DISABLED_MODULES", "relationship")
    monkeypatch.setenv("SIFTER_COMPRESSION__EDGE", "0.3")
    made = Settings.from_environment()
    assert made.integrity.missing == (0.9, 0.5, 0.2, 0.1) and made.engine.disabled_modules == ("relationship",) and made.compression.edge == 0.3


def test_modules_and_known_sets(tmp_path, monkeypatch):
    (tmp_path / "addons").mkdir()
    (tmp_path / "addons" / "__init__.py").write_text("")
    (tmp_path / "addons" / "one.py").write_text(
        "from sifter.engine import Module, register\n\n@register\nclass One(Module):\n    name = 'one'\n",
    )
    (tmp_path / "addons" / "broken.py").write_text("import not_there\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        assert engine.discover_modules("addons") == 1 and engine.module_of("one").name == "one" and "one" in engine.module_names()
    finally:
        engine.REGISTRY.pop("one", None)
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "titanic.csv").write_text("a\n1\n")
    assert loader.local_sets([str(tmp_path)]) == [
        str(tmp_path / "data" / "titanic.csv")
    ] and loader.local_set("V2X", [str(tmp_path)]) is None
    schema = found.json_schema()
    assert schema["properties"]["affected_columns"]["items"] == {"type": "string"} and "critical" in schema["properties"]["severity"]["enum"]


def test_jdbc_is_cut_by_a_column():
    class Reader:
        seen: list = []

        def __getattr__(self, name):
            return self

        def __call__(self, *a, **o):
            self.seen += [o] if o else []
            return self

        def load(self):
            return self

        def first(self):
            return (1, 900)

    spark = Reader()
    loader._jdbc(spark, loader.jdbc_options("postgresql://h/db", "t", None), {"partition_column": "id", "partitions": 8})
    asked, made = spark.seen
    assert asked["query"] == "select min(id) as low, max(id) as high from t"
    assert made["partitionColumn"] == "id" and (
        made["lowerBound"],
        made["upperBound"],
        made["numPartitions"],
    ) == ("1", "900", "8") and made["dbtable"] == "t"
    with pytest.raises(loader.LoadError):
        loader._jdbc(spark, {}, {"partition_column": "id; drop"})


def test_rule_tables():
    f = rules.Facts.of(["neighbor", "missing"], ["missing_values"], ["Neighbor1_rsrp"], ["Identifier Integrity"])
    assert reasoning.concept_of({"neighbor", "missing"}, ["missing_values"], ["Neighbor1_rsrp"]) == "Neighbor Cell Availability"
    assert reasoning.concept_of(
        {"alpha"},
        ["pearson"],
        ["serving_x"],
    ) == "Serving Cell Signal Quality" and reasoning.concept_of({"alpha"}, [], ["x"]) is None
    assert reasoning.made_concept(
        {"alpha"},
        ["correlation"],
        ["gear_box_size"],
    ) == "Gear Box Telemetry Subsystem" and reasoning.made_concept(set(), [], []) == "Measurement Telemetry Subsystem"
    assert rules.Rule(1).holds(f) and not rules.Rule(1, two=("neighbor", "pci")).holds(f) and rules.Rule(
        1,
        any_of=(rules.Rule(0, words=("x",)), rules.Rule(0, inside=("rsrp",))),
    ).holds(f)
    assert len(tables.CAUSES) == 6 and list(rules.fitting(tables.CAUSES, f)) == [tables.CAUSES[4].says]


def test_samples_of_sparse_columns(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") >= 2990, F.col("id")).alias("late"), F.lit(None).cast("string").alias("none"))
    p = profile(df)
    assert len(p.column("late").samples) == 5 and p.column("none").samples == []


def test_report_sections(spark):
    rows = [("integrity", "missing_values", f"Missing values in 'a{k}'", "high", 1.0, [f"a{k}"], None) for k in range(3)]
    r = reasoning.reason(finding_rows(spark, rows))
    made = r.report({"x": 1.5}, 10)
    assert made["sizes"]["findings"] == 3 and made["runtime"]["total_seconds"] == 1.5 and made["memory"]["dataset_bytes"] == 10 and made["memory"]["driver_peak_bytes"] > 0
    assert [s["layer"] for s in made["flow"]["stages"]] == [
        "findings",
        "evidence",
        "knowledge",
        "hypotheses",
        "work_items",
    ] and not r.unlinked()
    parts = {f for e in r.evidence for f in e.below}
    assert graph.local_modularity([sorted(parts)], [("x", "y", 1.0)]) == 0.0


def test_all_numeric_evidence_counts(spark):
    """Findings that differ in one of the nine numbers alone are scored apart."""
    base = found.finding(
        spark.range(2).select(F.col("id").alias("k")),
        "m",
        "c",
        title=F.format_string("Same words %d", "k"),
        description=F.lit("d"),
        severity=F.lit("low"),
        confidence=F.lit(0.5),
        columns=F.array(F.lit("x")),
        recommendation="r",
        evidence={"k": F.col("k")},
    )
    plain = similarity.scores(base).first().statistical
    for name in ("duplicate_ratio", "dominance_ratio", "health_score"):
        numbered = base.withColumn("evidence", F.map_concat("evidence", F.create_map(F.lit(name), F.element_at("evidence", F.lit("k")))))
        assert similarity.scores(numbered).first().statistical == plain  # 0 and 1 have nothing in common
        same = base.withColumn("evidence", F.map_concat("evidence", F.create_map(F.lit(name), F.lit("0.5"))))
        assert similarity.scores(same).first().statistical == plain + 0.75
