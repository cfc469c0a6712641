"""The engine: source or DataFrame, modules, findings, reasoning, result."""

from __future__ import annotations

import importlib
import logging
import pkgutil
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.config import Settings
from sifter.operators import findings as found
from sifter.operators import integrity, relationship
from sifter.operators.profile import DatasetProfile, clean, profile, profile_frame
from sifter.operators.sampling import row_sample
from sifter.plans.reasoning import Reasoning, reason
from sifter.sources.loader import load, name_of, source_type

log = logging.getLogger("sifter")
REGISTRY: dict[str, type[Module]] = {}


class RegistrationError(Exception):
    """A module's name is taken."""


class Module:
    """A plugin: takes a DataFrame and its profile, gives findings."""

    name = ""
    description = ""

    def __init__(self, settings: Settings):
        self.settings = settings
        #: Parts of the last run that failed and have no findings in it.
        self.failed: list[str] = []

    def skip_reason(self, df: DataFrame, p: DatasetProfile) -> str | None:
        return None

    def can_run(self, df: DataFrame, p: DatasetProfile) -> bool:
        return self.skip_reason(df, p) is None

    def investigate(self, df: DataFrame, p: DatasetProfile) -> DataFrame:
        raise NotImplementedError

    def info(self) -> dict:
        return {"name": self.name, "description": self.description}


def register(kind: type[Module]) -> type[Module]:
    if kind.name in REGISTRY:
        raise RegistrationError(f"a module named {kind.name!r} is registered already")
    REGISTRY[kind.name] = kind
    return kind


def module_names() -> list[str]:
    return sorted(REGISTRY)


def module_of(name: str) -> type[Module] | None:
    return REGISTRY.get(name)


def clear_registry() -> None:
    """Forget every module, the built-in ones too."""
    REGISTRY.clear()


def discover_modules(package: str) -> int:
    """Import what lies in a package, whose modules register themselves; how many were imported.

    One that fails is logged and passed over.
    """
    top = importlib.import_module(package)
    found = 0
    for _, name, _ in pkgutil.walk_packages(getattr(top, "__path__", []), f"{package}."):
        try:
            importlib.import_module(name)
            found += 1
        except Exception as problem:
            log.warning("%s can't be imported: %s", name, problem)
    return found


def frozen(df: DataFrame) -> DataFrame:
    """Findings run now and kept as rows (at most a few hundred), so that a failure shows where it belongs."""
    return df.sparkSession.createDataFrame(df.collect(), found.SCHEMA)


@register
class Integrity(Module):
    name = "integrity"
    description = "Missing values, duplicates, identifiers, constants, types, cardinality, joint missingness, health"

    def skip_reason(self, df, p):
        return None if p.row_count >= 1 and df.columns else "needs at least one row and one column"

    def investigate(self, df, p):
        spark, s = df.sparkSession, self.settings.integrity
        table = profile_frame(spark, p)
        extra = {
            integrity.missingness_correlation: {"full": self.settings.full},
            integrity.duplicates: {"counted": (p.row_count, p.duplicate_rows)},
        }
        made, failed = {}, []
        self.failed = failed

        def guarded(domain, run):
            """A domain's failure costs that domain alone, or with fail_fast ends the run."""
            try:
                return run()
            except Exception as problem:
                if self.settings.engine.fail_fast:
                    raise
                log.warning("%s failed: %s", domain, problem)
                failed.append(domain)
                return None

        for domain, detectors in integrity.DETECTORS.items():
            parts = guarded(domain, lambda ds=detectors: [detect(df, table, s, **extra.get(detect, {})) for detect in ds])
            if parts:
                made[domain] = reduce(DataFrame.unionByName, parts)
        try:  # one action for all domains; if it fails, one for each, to tell which
            out = frozen(reduce(DataFrame.unionByName, made.values(), found.none(spark)))
        except Exception:
            if self.settings.engine.fail_fast:
                raise
            kept = [guarded(domain, lambda x=x: frozen(x)) for domain, x in made.items()]
            out = frozen(reduce(DataFrame.unionByName, (x for x in kept if x is not None), found.none(spark)))
        bad = p.metadata.get("malformed_rows", 0)
        lines = frozen(integrity.malformed_rows(spark, bad, p.metadata["original_rows"], s, p.metadata["malformed_example"])) if bad else found.none(spark)
        return out.unionByName(frozen(integrity.health_finding(out, tuple(failed)))).unionByName(lines)


@register
class Relationship(Module):
    name = "relationship"
    description = "Correlation, mutual information, variance inflation, feature groups"

    def skip_reason(self, df, p):
        return None if p.row_count >= 2 and len(p.names("is_numeric")) >= 2 else "needs at least two rows and two numeric columns"

    def investigate(self, df, p):
        s, full, spark = self.settings.relationship, self.settings.full, df.sparkSession
        columns = relationship.numeric_columns(df, p)
        target = relationship.target_column(df, s, p.metadata.get("target_column"))
        out = found.none(spark)
        if len(columns) >= 2:
            held, n = df, p.row_count
            if not full:  # one sample for all budgets; smaller ones are drawn from it
                held = row_sample(df.select(*(F.col(f"`{c}`") for c in columns)), max(s.pearson_rows, s.vif_rows), n=n).persist()
                n = min(n, max(s.pearson_rows, s.vif_rows))
            pairs = relationship.correlated_pairs(held, columns, s, full, n)
            if full or not target:
                scores = relationship.pairwise_information(held, p, columns, s, full, n)
                out = out.unionByName(relationship.information_findings(spark, scores, pairs, s))
                by = {(q["a"], q["b"]): q for q in pairs}
                for a, b, x in scores:
                    if (a, b) in by:
                        by[a, b]["mi"] = x
                    else:
                        pairs.append({"a": a, "b": b, "pearson": None, "spearman": None, "p_value": None, "mi": x, "n": p.row_count})
            out = out.unionByName(relationship.correlation_findings(spark, pairs, s))
            out = out.unionByName(relationship.vif_findings(held, columns, s, full, n))
            out = out.unionByName(relationship.group_findings(spark, pairs, len(columns), s))
        if target and columns:
            out = out.unionByName(relationship.target_findings(df, p, target, columns, s))
        return frozen(out)


@dataclass
class Execution:
    """status: success, partial (parts named in the message failed), failed or skipped."""

    module: str
    status: str
    seconds: float
    findings: int
    message: str = ""


@dataclass
class Result:
    run_id: str
    profile: DatasetProfile
    findings: DataFrame
    executions: list[Execution]
    reasoning: Reasoning
    seconds: float
    timings: dict[str, float] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def by_severity(self, *severities: str) -> DataFrame:
        return found.by_severity(self.findings, *severities)

    def by_module(self, module: str) -> DataFrame:
        return found.by_module(self.findings, module)

    def by_column(self, column: str) -> DataFrame:
        return found.by_column(self.findings, column)

    def histogram(self) -> dict[str, int]:
        return {r.severity: r.n for r in found.histogram(self.findings).collect()}

    def ranked(self) -> DataFrame:
        return found.ranked(self.findings)

    def document(self) -> dict:
        """Everything as one JSON-able document."""
        layers = {k: [asdict(x) for x in getattr(self.reasoning, k)] for k in ("evidence", "knowledge", "hypotheses", "queue")}
        return {
            "run_id": self.run_id,
            "dataset": asdict(self.profile),
            "findings": [r.asDict(recursive=True) for r in self.ranked().collect()],
            "executions": [asdict(e) for e in self.executions],
            "metrics": self.reasoning.metrics(),
            "report": self.reasoning.report(self.timings, self.profile.size_estimate),
            "seconds": self.seconds,
            "timings": self.timings,
            "settings": self.settings,
            **layers,
        }


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()

    def active(self, modules: list[str] | None = None) -> list[Module]:
        """Requested modules, else the enabled ones, else all; less the disabled ones. Unknown names are logged."""
        names = modules or list(self.settings.engine.enabled_modules) or sorted(REGISTRY)
        for n in names:
            if n not in REGISTRY:
                log.warning("no module named %s; known: %s", n, ", ".join(sorted(REGISTRY)))
        return [REGISTRY[n](self.settings) for n in names if n in REGISTRY and n not in self.settings.engine.disabled_modules]

    def _run(self, module: Module, df: DataFrame, p: DatasetProfile) -> tuple[DataFrame, Execution]:
        began, none = time.monotonic(), found.none(self.spark)
        why = module.skip_reason(df, p)
        if why:
            return none, Execution(module.name, "skipped", 0.0, 0, why)
        try:
            made = found.valid(module.investigate(df, p))
            # The cap keeps the most urgent; the health score is never among those it drops.
            health = made.where("category = 'structural_health_score'")
            kept = frozen(
                found.strongest(
                    made.where("category <> 'structural_health_score'"),
                    self.settings.engine.max_findings,
                ).unionByName(health),
            )
            status, said = ("partial", f"failed: {', '.join(module.failed)}") if module.failed else ("success", "")
            return kept, Execution(module.name, status, time.monotonic() - began, len(kept.collect()), said)
        except Exception as problem:
            if self.settings.engine.fail_fast:
                raise
            log.warning("%s failed: %s", module.name, problem)
            return none, Execution(module.name, "failed", time.monotonic() - began, 0, str(problem)[:500])

    def _investigate(self, df: DataFrame, p: DatasetProfile, modules: list[str] | None) -> Result:
        began, timings, runs = time.monotonic(), {}, []
        out = found.none(self.spark)
        for module in self.active(modules):
            made, run = self._run(module, df, p)
            out, timings[module.name] = out.unionByName(made), run.seconds
            runs.append(run)
        out = frozen(out)
        at = time.monotonic()
        layers = reason(out, self.settings)
        timings["reasoning"] = time.monotonic() - at
        return Result(uuid.uuid4().hex, p, out, runs, layers, time.monotonic() - began, timings, asdict(self.settings))

    def investigate(self, source: str, *, modules: list[str] | None = None, **options) -> Result:
        df, meta = load(self.spark, source, self.settings.engine.max_rows, **options)
        p = profile(df, name_of(source), meta.pop("source"), source_type(source), **meta)
        return self._investigate(df, p, modules)

    def investigate_dataframe(self, df: DataFrame, *, name: str = "dataframe", modules: list[str] | None = None, **metadata) -> Result:
        """A DataFrame of Spark: no row cap. With fail_fast a failure is raised; else what failed is told by the result's executions alone."""
        df = clean(df)
        return self._investigate(df, profile(df, name, **metadata), modules)
