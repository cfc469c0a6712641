"""Command line: investigate, benchmark, ablate, evaluate, visualize, paper-assets, info, schema."""

from __future__ import annotations

import argparse
import json
import logging
import time
import tracemalloc
from dataclasses import replace

from sifter.config import Settings
from sifter.engine import REGISTRY, Engine
from sifter.operators import findings as found
from sifter.plans.compare import ablations, methods
from sifter.sources.loader import local_sets
from sifter.sources.sinks import layer_graph, markdown_table, table_bundle, write_json, write_report


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sifter")
    out.add_argument("--log-level", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"])
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("investigate", "benchmark", "ablate", "visualize", "paper-assets"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("--table")
        p.add_argument("--query")
        p.add_argument("--modules", help="comma-separated")
        p.add_argument("--profile", choices=["balanced", "full"], default="balanced")
        p.add_argument("--output")
        if name == "investigate":
            for flag in ("--verbose", "--explain", "--metrics", "--benchmark"):
                p.add_argument(flag, action="store_true")
        if name == "benchmark":
            p.add_argument("--repeats", type=int)
    p = sub.add_parser("evaluate")
    p.add_argument("sources", nargs="*")
    p.add_argument("--search", action="append", default=[], help="folder to look for known data sets in")
    p.add_argument("--output")
    sub.add_parser("info")
    sub.add_parser("schema")
    return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sifter").getOrCreate()


def _result(a, spark):
    settings = Settings.from_environment()
    settings = replace(settings, engine=replace(settings.engine, profile=a.profile))
    options = {k: v for k, v in (("table_name", a.table), ("query", a.query)) if v}
    return Engine(spark, settings).investigate(a.source, modules=a.modules.split(",") if a.modules else None, **options), settings


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    logging.getLogger("sifter").setLevel(a.log_level)
    if a.command == "info":
        for name in sorted(REGISTRY):
            print(f"{name}: {REGISTRY[name].description}")
        return 0
    if a.command == "schema":
        print(json.dumps(found.json_schema(), indent=2))
        return 0
    spark = spark or _session()
    if a.command == "evaluate":
        rows = []
        for source in [*a.sources, *local_sets(a.search)]:
            r = Engine(spark, Settings.from_environment()).investigate(source)
            rows.append(
                {
                    "dataset": r.profile.name,
                    "rows": r.profile.row_count,
                    "columns": len(r.profile.columns),
                    "seconds": round(r.seconds, 3),
                    **r.reasoning.metrics(),
                },
            )
        print(markdown_table(rows))
        if a.output:
            write_report(a.output, rows, "Evaluation")
        return 0
    result, settings = _result(a, spark)
    if a.command == "investigate":
        p = result.profile
        print(f"{p.name}: {p.row_count} rows, {len(p.columns)} columns, {p.duplicate_rows} duplicate rows")
        print(", ".join(f"{n} {s}" for s, n in result.histogram().items()))
        for k, i in enumerate(result.reasoning.queue):
            print(f"{k + 1}. [{i.priority}] {i.title} (confidence {i.confidence})")
            if a.explain:
                print("\n".join(f"   {x}" for x in result.reasoning.tree(i)) if i.hypotheses else "")
        if a.verbose:
            for f in result.ranked().collect():
                print(f"{f.severity}: {f.title}: {f.description}")
        if a.metrics:
            print(json.dumps(result.reasoning.report(result.timings, result.profile.size_estimate), indent=2))
        if a.benchmark:
            print(json.dumps(result.timings, indent=2))
        if a.output:
            write_json(a.output, result.document())
    elif a.command == "benchmark":
        from sifter.plans.reasoning import reason

        seconds, peaks, ids, whole = [], [], set(), True
        repeats = a.repeats or settings.compression.repeats
        for _ in range(repeats):
            tracemalloc.start()
            began = time.monotonic()
            made = reason(result.findings, settings)
            seconds.append(time.monotonic() - began)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            ids.add(tuple(i.id for i in made.queue))
            whole = whole and not made.unlinked()
        mean = lambda x: sum(x) / len(x)
        run = {"mean_seconds": round(mean(seconds), 4), "mean_peak_bytes": int(mean(peaks)), "repeats": repeats}
        rows = [{**run, "deterministic": len(ids) == 1, "provenance_whole": whole, **result.reasoning.metrics()}]
        print(markdown_table(rows))
        print(markdown_table(methods(result.findings, settings)))
        if a.output:
            write_report(a.output, rows, "Benchmark")
    elif a.command == "ablate":
        rows = ablations(result.findings, settings)
        print(markdown_table(rows))
        if a.output:
            write_report(a.output, rows, "Ablation")
    elif a.command == "visualize":
        r, stem = result.reasoning, a.output or "sifter-graph"
        both = lambda x, y, name: set(getattr(x, name)) & set(getattr(y, name))
        layers = {
            "evidence": (r.evidence, lambda x, y: both(x, y, "columns")),
            "knowledge": (r.knowledge, lambda x, y: both(x, y, "below") or ({y.title} & set(x.related))),
            "hypotheses": (r.hypotheses, lambda x, y: both(x, y, "below") or both(x, y, "concepts")),
            "queue": ([i for i in r.queue if i.hypotheses], lambda x, y: both(x, y, "below") or both(x, y, "hypotheses")),
        }
        for name, (items, shared) in layers.items():
            print("\n".join(layer_graph(items, shared).write(f"{stem}-{name}")))
    else:
        folder = a.output or "sifter-assets"
        parts = {
            "metrics": [result.reasoning.metrics()],
            "ablation": ablations(result.findings, settings),
            "methods": methods(result.findings, settings),
        }
        for name, rows in parts.items():
            print("\n".join(table_bundle(folder, name, rows, name.capitalize())))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
