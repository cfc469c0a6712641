"""Lines that do not fit, and titles and causes by their tables."""

from __future__ import annotations

import pytest

from sifter.engine import Engine
from sifter.plans import tables
from sifter.plans.reasoning import Item, likely_causes, work_title
from sifter.sources.loader import load, malformed


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    """Two files of 300 lines; seven lines lack a field or have one too many."""
    folder = tmp_path_factory.mktemp("lines") / "sales.csv"
    folder.mkdir()
    for part, bad in (("a.csv", {5: "5", 9: "9,x9,0.9,more", 100: "100,x100"}), ("b.csv", {1: "1", 2: "2", 3: "3,x,1.0,2,3", 299: "299,y"})):
        lines = [bad.get(k, f"{k},x{k % 40},{k / 10}") for k in range(300)]
        (folder / part).write_text("\n".join(["id,name,amount", *lines]) + "\n")
    return str(folder)


def test_malformed_lines_are_counted(spark, source):
    got = {r.file.rsplit("/", 1)[-1]: (r.lines, r.corrupt, r.example) for r in malformed(spark, source).collect()}
    assert got == {"a.csv": (300, 3, "100,x100"), "b.csv": (300, 4, "1")}
    df, meta = load(spark, source, 1000)
    assert df.count() == 600 and df.columns == ["id", "name", "amount"]
    assert (meta["original_rows"], meta["malformed_rows"], meta["malformed_example"]) == (600, 7, "1")
    df, meta = load(spark, source, 50)
    assert df.count() == 50 and meta["sampled"]


def test_sound_files_and_other_kinds(spark, tmp_path):
    spark.range(20).selectExpr("id", "id * 2 as two").coalesce(1).write.csv(str(tmp_path / "fine.csv"), header=True)
    assert load(spark, str(tmp_path / "fine.csv"), 100)[1]["malformed_rows"] == 0
    spark.range(20).write.parquet(str(tmp_path / "fine.parquet"))
    assert malformed(spark, str(tmp_path / "fine.parquet")).count() == 0
    assert load(spark, str(tmp_path / "fine.parquet"), 100)[1]["malformed_rows"] == 0
    assert malformed(spark, str(tmp_path / "fine.csv"), mode="DROPMALFORMED").count() == 0


def test_a_finding_tells_of_malformed_lines(spark, source):
    got = Engine(spark).investigate(source, modules=["integrity"]).findings.where("category = 'malformed_rows'").collect()
    assert [(r.title, r.severity, r.evidence["malformed_count"]) for r in got] == [("7 malformed lines", "low", "7")]


def hypothesis(title: str = "Something else.", concepts=(), category: str = "Outlier Community", workstream: str = "measurement_pipeline", columns=()) -> Item:
    return Item("h", title, category, list(columns), 0.5, more={"concepts": list(concepts), "workstream": workstream})


@pytest.mark.parametrize(
    ("given", "title"),
    [
        ({"title": "Neighbor-cell measurements are systematically unavailable."}, "Systematic Neighbor Cell Measurement Loss"),
        ({"title": "Record ids may be compromised"}, "Record ids Risk"),
        ({"title": "x may be limiting signal quality."}, "Low-Information Configuration Feature Structure"),
        ({"title": "Cell Feature Set deserve investigation"}, "Cell Feature Set Consistency Risk"),
        ({"workstream": "neighbor_collection", "concepts": ["Radio Signal Quality"]}, "Correlated Neighbor Cell Reporting Failure"),
        ({"workstream": "neighbor_collection", "category": "Correlation Community"}, "Correlated Neighbor Cell Reporting Failure"),
        ({"workstream": "neighbor_collection"}, "Systematic Neighbor Cell Measurement Loss"),
        ({"workstream": "configuration_pipeline", "columns": ["Batch_size"]}, "Constant Configuration Parameter"),
        ({"workstream": "configuration_pipeline", "columns": ["other"]}, "Low-Variation Configuration Parameter"),
        ({"workstream": "feature_engineering", "columns": ["sample_flag"]}, "Near-Constant Sample Degradation Indicator"),
        ({"workstream": "feature_engineering"}, "Low-Information Feature Engineering Signal"),
        ({"workstream": "signal_quality", "concepts": ["Measurement Availability"]}, "Incomplete Radio Signal Collection"),
        ({"workstream": "signal_quality"}, "Coupled Signal Quality Feature Behavior"),
        ({"category": "Systematic Missingness"}, "Systematic Measurement Availability Loss"),
        ({"concepts": ["Measurement Availability"]}, "Systematic Measurement Availability Loss"),
        ({"workstream": "record_linkage", "concepts": ["Identifier Integrity"]}, "Record Linkage Integrity Risk"),
        ({"concepts": ["Spatial Context"], "columns": ["LTE_cell_load"]}, "LTE Cell Load Consistency Risk"),
        ({"concepts": ["Radio Signal Quality"]}, "Signal Quality Consistency Risk"),
        ({"concepts": ["Radio Configuration"]}, "Configuration Pipeline Consistency Risk"),
        ({"concepts": ["Feature Engineering Artifact"]}, "Feature Engineering Consistency Risk"),
        ({"concepts": ["Neighbor Cell Telemetry"]}, "Neighbor Cell Collection Consistency Risk"),
        ({"concepts": ["Identifier Integrity"]}, "Record Linkage Integrity Consistency Risk"),
        ({"concepts": ["Spatial Context"]}, "Measurement Pipeline Consistency Risk"),
    ],
)
def test_titles(given, title):
    assert work_title([hypothesis(**given)]) == title


def test_without_concepts_a_title_speaks_of_availability():
    assert work_title([hypothesis()]) == "Systematic Measurement Availability Loss"


def test_causes_have_findings_and_unknowns():
    units = [
        Item("e1", "Account ids may compromise record linkage", "Identifier Integrity Failure", ["account_id"], below=["f2", "f1"]),
        Item("e2", "Weather", "Outlier Community", ["wind"], below=["f3"]),
        Item("e3", "Duplicate entities", "Redundant Feature Group", ["b"], below=["f1", "f9"]),
    ]
    ideas = [Item("k1", "Identifier Integrity"), Item("k2", "Spatial Context")]
    got = likely_causes(units, [Item("x", "t", "c", ["b"])], ideas, 0.8, ["u1", "u2", "u3"])
    assert len(got) == 1
    assert {k: got[0][k] for k in ("evidence", "findings", "concepts", "contradicting", "unknown")} == {
        "evidence": ["e1", "e3"], "findings": ["f1", "f2", "f9"], "concepts": ["k1"], "contradicting": ["x"], "unknown": ["u1", "u2"],
    }
    assert got[0]["confidence"] == round(0.56 + 0.16 + 0.04 - 0.05, 2)
    other = likely_causes(units[1:2], [], [Item("k2", "Spatial Context")], 0.8)
    assert [(c["cause"], c["findings"], c["unknown"]) for c in other] == [(tables.OTHER_CAUSE, ["f3"], [])]
