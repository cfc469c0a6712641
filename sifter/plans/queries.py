"""All queries of the triage engine, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.config import CompressionSettings, EngineSettings, Settings
from sifter.engine import Engine
from sifter.functions.scalars import jaccard, severity_rank, severity_weight
from sifter.operators import findings as found
from sifter.operators import similarity
from sifter.operators.sketches import estimates, merge, sketch
from sifter.plans import compare, detect, evidence as evidence_plans, layers, lineage, ruleplans  # noqa: F401  (the last four register their queries)
from sifter.plans.detect import SQL, Q, labelled, prices, query, read
from sifter.plans.reasoning import reason
from sifter.streaming.incremental import merge_counts, profiled, windowed_counts


#: A query's rows don't say what failed, so that a failure must be raised.
FULL = Settings(engine=EngineSettings(profile="full", fail_fast=True))


def example_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each nation, region, segment and status: enough of a graph, made from the tables alone."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("r") + 1)
    names = F.array(F.concat(F.lit("neighbor"), F.col("r"), F.lit("_rsrp")), F.concat(F.lit("col_"), (F.col("k") % 7)))
    kind = F.col("k") % 3
    said = {"k": F.col("k"), "duplicate_ratio": F.when(kind == 2, F.col("k") / 30.0), "health_score": F.when(kind == 2, 100.0 - F.col("k"))}
    made = found.finding(
        rows,
        "integrity",
        "x",
        title=F.format_string("Finding %d in area %d", "k", "r"),
        description=F.lit("d"),
        severity=severity,
        confidence=(F.col("k") + 50) / 100.0,
        columns=names,
        recommendation="look",
        evidence=said,
        correlation_coefficient=F.when(kind == 1, (F.col("k") - 12) / 13.0),
        missing_ratio=F.when(kind == 0, F.col("k") / 25.0),
        impact=F.when(F.col("k") % 4 == 0, F.col("k") / 40.0),
        anomaly_strength=F.when(F.col("k") % 2 == 0, F.col("k") / 50.0),
    )
    made = made.withColumn("k", F.element_at("evidence", F.lit("k")).cast("int"))
    kind = F.col("k") % 3
    return made.withColumn("category", F.when(kind == 0, "missing_values").when(kind == 1, "correlation").otherwise("duplicate_features"))


_F = """f AS (SELECT n_nationkey AS k, 'neighbor' || n_regionkey || '_rsrp' AS c1, 'col_' || (n_nationkey % 7) AS c2,
    CASE n_regionkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 WHEN 3 THEN 0.2 ELSE 0.0 END::DOUBLE AS w, (n_nationkey
    + 50) / 100.0 AS conf,
  'neighbor' || n_regionkey AS fam, CASE n_nationkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'c' ELSE 'd' END AS cat,
  CASE WHEN n_nationkey % 3 = 1 THEN (n_nationkey - 12) / 13.0 END AS cc, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 25.0 END AS mr,
  CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey / 30.0 END AS dr, CASE WHEN n_nationkey % 3 = 2 THEN 100.0 - n_nationkey END AS hs,
    CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey / 40.0 END AS im, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 50.0 END AS an,
  list_distinct(list_filter(string_split_regex(lower('Finding ' || n_nationkey || ' in area ' || n_regionkey || ' neighbor' || n_regionkey || '_rsrp col_' || (n_nationkey % 7)), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x <> 'finding')) AS tok FROM nation)"""


def rel(a: str, b: str) -> str:
    """How near two numbers are, null unless both are there."""
    near = f"greatest(0, 1 - abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0))"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {near} END"


_PAIR = f"""WITH {_F}, p AS (SELECT a.k AS left_k, b.k AS right_k, a.fam AS fa, b.fam AS fb, a.cat AS ca, b.cat AS cb,
  (CASE WHEN a.c1 = b.c1 THEN 1 ELSE 0 END + CASE WHEN a.c2 = b.c2 THEN 1 ELSE 0 END) AS sc, len(list_intersect(a.tok, b.tok)) AS st,
    len(list_distinct(list_concat(a.tok, b.tok))) AS ut,
  1 - abs(a.w - b.w) AS sev, 1 - abs(a.conf - b.conf) AS con, a.cc AS x, b.cc AS y, a.mr AS m, b.mr AS n, a.dr AS d1, b.dr AS d2,
    a.hs AS h1, b.hs AS h2, a.im AS i1, b.im AS i2, a.an AS a1, b.an AS a2 FROM f a JOIN f b ON a.k < b.k),
  s AS (SELECT *, sc / (4.0 - sc) AS col, 1.0 * st / ut AS tk, (CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END + coalesce({rel('i1', 'i2')},
    0) + coalesce({rel('a1', 'a2')}, 0)) / (1 + CASE WHEN i1 IS NULL OR i2 IS NULL THEN 0 ELSE 1 END + CASE
    WHEN a1 IS NULL OR a2 IS NULL THEN 0 ELSE 1 END) AS meta, CASE WHEN fa = fb THEN 1.0 ELSE 0.0 END AS fam,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (1 - least(abs(abs(x) - abs(y)), 1)) * CASE
    WHEN x = 0 OR y = 0 OR sign(x) = sign(y) THEN 1.0 ELSE 0.2 END WHEN m IS NOT NULL AND n IS NOT NULL THEN {rel('m', 'n')}
    WHEN d1 IS NOT NULL AND d2 IS NOT NULL THEN ({rel('d1', 'd2')} + {rel('h1', 'h2')}) / 2 ELSE 0.0 END AS num FROM p),
  t AS (SELECT *, 0.35 * col + 0.15 * meta + 0.10 + 0.30 * fam AS structural, 0.75 * num + 0.15 * sev + 0.10 * con AS statistical,
    0.40 * fam + 0.60 * tk AS semantic FROM s)"""


_WEIGHT = "round_even((0.40 * structural + 0.35 * statistical + 0.25 * semantic) * CASE WHEN fa <> fb AND sc = 0 THEN 0.15 ELSE 1.0 END, 4)"
_CANDIDATE = "(st > 0 OR ca = cb OR sc > 0)"


def _keyed(f: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of finding ids as pairs of keys, the lesser one first."""
    key = f.select("id", "k")
    both = pairs.join(key.select(F.col("id").alias("left"), F.col("k").alias("a")), "left").join(
        key.select(F.col("id").alias("right"), F.col("k").alias("b")),
        "right",
    )
    return both.withColumns({"left_k": F.least("a", "b"), "right_k": F.greatest("a", "b")})


@query("finding_similarity", _PAIR + f" SELECT left_k, right_k, round({_WEIGHT}, 3) AS weight FROM t WHERE {_CANDIDATE}")
def similar(spark, d):
    """Scores of candidate pairs; here all but a few pairs share a bucket."""
    f = example_findings(spark, d)
    return _keyed(f, similarity.scores(f.drop("k"))).select("left_k", "right_k", F.round("weight", 3).alias("weight"))


@query("candidate_pairs", _PAIR + f" SELECT left_k, right_k FROM t WHERE {_CANDIDATE}")
def candidates(spark, d):
    f = example_findings(spark, d)
    return _keyed(f, similarity.candidate_pairs(similarity.described(f.drop("k")), CompressionSettings())).select("left_k", "right_k")


@query(
    "finding_cap",
    f"WITH {_F} SELECT k FROM f ORDER BY w DESC, coalesce(im, 0) + abs(coalesce(cc, 0)) + coalesce(an, 0) DESC, conf DESC LIMIT 7",
)
def capped(spark, d):
    """The cap on a module's findings is the limit here."""
    return found.strongest(example_findings(spark, d), 7).select("k")


@query(
    "column_jaccard",
    f"WITH {_F} SELECT a.k AS left_k, b.k AS right_k, round((CASE WHEN a.c1 = b.c1 THEN 1 ELSE 0 END + CASE WHEN a.c2 = b.c2 "
    f"THEN 1 ELSE 0 END) / (4.0 - (CASE WHEN a.c1 = b.c1 THEN 1 ELSE 0 END + CASE WHEN a.c2 = b.c2 THEN 1 ELSE 0 END)), 6) AS "
    f"overlap FROM f a JOIN f b ON a.k < b.k",
)
def overlaps(spark, d):
    f = example_findings(spark, d)
    a, b = f.select(F.col("k").alias("left_k"), F.col("affected_columns").alias("x")), f.select(
        F.col("k").alias("right_k"),
        F.col("affected_columns").alias("y"),
    )
    return a.join(b, F.col("left_k") < F.col("right_k")).select(
        "left_k",
        "right_k",
        F.round(jaccard(F.col("x"), F.col("y")), 6).alias("overlap"),
    )


@query(
    "severity_histogram",
    "SELECT s.severity, count(n_nationkey) AS n FROM (SELECT unnest(['critical','high','medium','low','info']) AS severity, "
    "unnest([0,1,2,3,4]) AS r) s LEFT JOIN nation ON n_regionkey = r GROUP BY s.severity",
)
def severities(spark, d):
    return found.histogram(example_findings(spark, d))


@query(
    "ranked_findings",
    "SELECT n_nationkey AS k, CAST(n_regionkey AS INT) AS rank, round(CASE n_regionkey WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 "
    "THEN 0.5 WHEN 3 THEN 0.2 ELSE 0.0 END, 2) AS weight FROM nation ORDER BY n_regionkey, n_nationkey DESC LIMIT 10",
)
def ranks(spark, d):
    return found.ranked(example_findings(spark, d)).limit(10).select(
        "k",
        severity_rank(F.col("severity")).alias("rank"),
        F.round(severity_weight(F.col("severity")), 2).alias("weight"),
    )


@query("evidence_units")
def evidence(spark, d):
    r = reason(example_findings(spark, d).drop("k"))
    return spark.createDataFrame(
        [(e.id, e.title, e.category, e.strength, e.confidence, e.columns) for e in r.evidence],
        "id string, title string, category string, strength double, confidence double, columns array<string>",
    )


@query("reasoning_metrics")
def metrics(spark, d):
    m = reason(example_findings(spark, d).drop("k")).metrics()
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(m.items())], "name string, value double")


@query("reasoning_lineage")
def reasoning_lineage(spark, d):
    return spark.createDataFrame(reason(example_findings(spark, d).drop("k")).lineage(), "parent string, child string, layer string")


@query("investigate_labelled")
def investigate(spark, d):
    """Without row budgets but that of nearest neighbours."""
    return Engine(spark, FULL).investigate_dataframe(labelled(spark, d), name="labelled").reasoning.queue_table(spark)


@query("investigate_prices")
def investigate_prices(spark, d):
    return Engine(spark, FULL).investigate_dataframe(prices(spark, d), name="prices").reasoning.queue_table(spark)


@query(
    "batchwise_profile",
    detect._profile_sql(
        "events",
        ["event_id", "ts", "user_id", "event_type", "value", "props"],
    ).replace("'event_id' AS name", "0 AS ordinal").replace("'ts' AS name", "1 AS ordinal").replace("'user_id' AS name", "2 AS ordinal").replace("'event_type' AS name", "3 AS ordinal").replace("'value' AS name", "4 AS ordinal").replace("'props' AS name", "5 AS ordinal"),
)
def batchwise(spark, d):
    """Value counts of two halves, merged as the stream merges its batches."""
    e = read(spark, d, "events")
    return profiled(merge_counts(merge_counts(None, e.where("event_id % 2 = 0")), e.where("event_id % 2 <> 0")))


_EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(
    "sketch_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls FROM events" for c in _EVENTS),
)
def sketch_counts(spark, d):
    """What is exact in the merged sketches of two halves; their estimates are held against exact values by tests."""
    e = read(spark, d, "events").select(*_EVENTS)
    halves = sketch(e.where("event_id % 2 = 0")).union(sketch(e.where("event_id % 2 <> 0")))
    return estimates(merge(halves)).select("name", "rows", "nulls")


@query(
    "windowed_events",
    "SELECT date_trunc('day', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP "
    "BY ALL",
)
def windowed(spark, d):
    return windowed_counts(read(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


_SIGNALS = {
    "column_overlap": "col",
    "metadata": "meta",
    "same_family": "fam",
    "numeric_evidence": "num",
    "severity": "sev",
    "confidence": "con",
    "prefix": "fam",
    "token_overlap": "tk",
    "domain_terms": "tk",
}
_WHY = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {x} >= 0.2 THEN '{k}' END" for k, x in _SIGNALS.items()
) + ", 'same_module'], lambda z: z IS NOT NULL))"


@query(
    "finding_edges",
    _PAIR + f" SELECT left_k, right_k, round({_WEIGHT}, 3) AS weight, array_to_string({_WHY}, ',') AS reasons FROM t WHERE {_CANDIDATE} AND {_WEIGHT} >= 0.18",
)
def linked(spark, d):
    f = example_findings(spark, d)
    got = _keyed(f, similarity.edges(f.drop("k"), CompressionSettings()))
    return got.select("left_k", "right_k", F.round("weight", 3).alias("weight"), F.array_join("reasons", ",").alias("reasons"))


@query("ablations")
def ablated(spark, d):
    rows = compare.ablations(example_findings(spark, d).drop("k"), Settings())
    return spark.createDataFrame(
        [(r["variant"], r["evidence"], r["knowledge"], r["hypotheses"], r["work_items"]) for r in rows],
        "variant string, evidence int, knowledge int, hypotheses int, work_items int",
    )


@query("compression_methods")
def compared(spark, d):
    rows = compare.methods(example_findings(spark, d).drop("k"), Settings())
    return spark.createDataFrame(
        [(r["method"], r["findings"], r["evidence"], r["work_items"], r["deterministic"]) for r in rows],
        "method string, findings int, evidence int, work_items int, deterministic boolean",
    )


def queries():
    return dict(Q)


def oracle_sql():
    return dict(SQL)
