"""Rule tables as plans: what the rules of sifter.plans.tables say of each row of a table of facts, without a shuffle.

Facts are arrays: words, kinds (categories), columns (names) and concepts. The rules are few and fixed, so each becomes a condition over
a row's own arrays, and a table of rules the first of its conditions that holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.plans import tables
from sifter.plans.detect import query, read
from sifter.plans.rules import Rule

FACTS = ("words", "kinds", "columns", "concepts")


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits of three characters or more, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))


def _some(have: Column, wanted: Sequence[str], least: int = 1) -> Column:
    """Whether at least so many of the wanted members are there; null arrays have none."""
    met = F.array_intersect(have, F.array(*map(F.lit, sorted(set(wanted)))))
    return F.coalesce(F.size(met) >= least, F.lit(False))


def holds(rule: Rule) -> Column:
    """Whether a rule holds for a row's facts."""
    words, kinds, names, concepts = (F.col(c) for c in FACTS)
    named = lambda test: F.coalesce(F.exists(names, lambda c: test(F.lower(c))), F.lit(False))
    wanted = [_some(words, rule.words)] if rule.words else []
    wanted += [_some(words, rule.also)] if rule.also else []
    wanted += [_some(words, rule.two, 2)] if rule.two else []
    wanted += [_some(kinds, rule.kinds)] if rule.kinds else []
    wanted += [_some(kinds, rule.either) | _some(words, rule.either)] if rule.either else []
    wanted += [_some(concepts, rule.concepts)] if rule.concepts else []
    wanted += [_some(concepts, rule.all_concepts, len(set(rule.all_concepts)))] if rule.all_concepts else []
    wanted += [named(lambda c: F.startswith(c, F.lit(rule.starts)))] if rule.starts else []
    for parts in [rule.inside] if rule.inside else []:
        wanted.append(named(lambda c: _either([F.contains(c, F.lit(p)) for p in parts])))
    wanted += [_either([holds(r) for r in rule.any_of])] if rule.any_of else []
    out = F.lit(True)
    for condition in wanted:
        out = out & condition
    return out


def _either(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def first(rules: Sequence[Rule], part: int | None = None) -> Column:
    """What the first rule that holds says (a part of it, if it says several things), or null."""
    said = lambda r: F.lit(r.says if part is None else r.says[part])
    return F.coalesce(*(F.when(holds(r), said(r)) for r in rules))


def fitting(rules: Sequence[Rule], part: int | None = None) -> Column:
    """What all rules that hold say, in their order."""
    said = lambda r: F.lit(r.says if part is None else r.says[part])
    return F.filter(F.array(*(F.when(holds(r), said(r)) for r in rules)), lambda x: x.isNotNull())


def verdicts(facts: DataFrame) -> DataFrame:
    """facts with category, concept, title, workstream, causes: what the tables say of each row's words, kinds, columns and concepts.

    Words of column names count as words for the concept. Without a concept's rule, a name is made of the first column or its
    family, and an ending. Null arrays are empty ones.
    """
    empty = F.array().cast("array<string>")
    facts = facts.withColumns({c: F.coalesce(F.col(c), empty) for c in FACTS})
    inside = lambda parts: F.coalesce(F.exists("kinds", lambda k: _either([F.contains(k, F.lit(p)) if p in ("outlier", "cluster") else k == p for p in parts])), F.lit(False))
    category = F.coalesce(*(F.when(inside(any_of), F.lit(name)) for name, any_of in tables.EVIDENCE_RULES), F.lit(tables.DEFAULT_CATEGORY))
    stems = F.slice(F.split(F.element_at("columns", 1), "_"), 1, 2)
    capital = F.transform(stems, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 20))))
    plain = F.when(F.size("columns") > 0, F.array_join(capital, " ")).otherwise(F.lit(tables.DEFAULT_FAMILY))
    made = F.concat_ws(" ", F.coalesce(first(tables.FAMILIES), plain), first(tables.ENDINGS))
    said = facts.withColumns({"category": category, "made": made, "title": first(tables.STATEMENTS, 0), "workstream": first(tables.WORKSTREAMS), "causes": fitting(tables.CAUSES, 0)})
    by_name = facts.columns
    wide = said.withColumn("words", F.array_union("words", F.flatten(F.transform("columns", words_of))))
    wide = wide.withColumn("concept", F.coalesce(first(tables.CONCEPTS), "made"))
    return wide.select(*(F.col(c) for c in by_name if c not in FACTS), "category", "concept", "title", "workstream", "causes")


def _vocabulary() -> dict[str, list[str]]:
    """All members that any rule asks for, by kind of fact."""
    found: dict[str, set[str]] = {c: {"plain"} for c in FACTS}

    def gather(rule: Rule) -> None:
        found["words"].update(rule.words, rule.also, rule.two, rule.either)
        found["kinds"].update(rule.kinds, rule.either)
        found["columns"].update(rule.inside, [rule.starts] if rule.starts else [])
        found["concepts"].update(rule.concepts, rule.all_concepts)
        for r in rule.any_of:
            gather(r)

    for table in (tables.CONCEPTS, tables.FAMILIES, tables.ENDINGS, tables.STATEMENTS, tables.WORKSTREAMS, tables.CAUSES):
        for rule in table:
            gather(rule)
    for _, any_of in tables.EVIDENCE_RULES:
        found["kinds"].update(any_of)
    return {c: sorted(x) for c, x in found.items()}


VOCABULARY = _vocabulary()
_PLACES = {
    "words": ["k % {n}", "k // {n} % {n}", "k * 7 % {n}"],
    "kinds": ["k % {n}", "k // {n} % {n}"],
    "columns": ["k // 4 % {n}"],
    "concepts": ["k % {n}", "k // {n} % {n}"],
}


def facts_of(keys: DataFrame) -> DataFrame:
    """(k, words, kinds, columns, concepts): some members of the vocabulary for each k."""
    made = []
    for c, places in _PLACES.items():
        held = F.array(*map(F.lit, VOCABULARY[c]))
        at = [F.element_at(held, F.expr(p.format(n=len(VOCABULARY[c])).replace("//", "div")).cast("int") + 1) for p in places]
        made.append(F.array(*([F.concat(x, F.lit("_"), F.col("k") % 4) for x in at] if c == "columns" else at)).alias(c))
    return keys.select("k", *made)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _listed(xs: Sequence[str]) -> str:
    return f"[{', '.join(map(_quoted, xs))}]"


def _holds_sql(rule: Rule) -> str:
    some = lambda c, xs: f"len(list_filter({_listed(sorted(set(xs)))}, lambda x: list_contains({c}, x)))"
    wanted = [f"{some('words', xs)} >= {n}" for xs, n in ((rule.words, 1), (rule.also, 1), (rule.two, 2)) if xs]
    wanted += [f"{some('kinds', rule.kinds)} > 0"] if rule.kinds else []
    wanted += [f"({some('kinds', rule.either)} > 0 OR {some('words', rule.either)} > 0)"] if rule.either else []
    wanted += [f"{some('concepts', rule.concepts)} > 0"] if rule.concepts else []
    wanted += [f"{some('concepts', rule.all_concepts)} = {len(set(rule.all_concepts))}"] if rule.all_concepts else []
    wanted += [f"len(list_filter(columns, lambda c: starts_with(lower(c), {_quoted(rule.starts)}))) > 0"] if rule.starts else []
    for xs in [rule.inside] if rule.inside else []:
        wanted.append("(" + " OR ".join(f"len(list_filter(columns, lambda c: contains(lower(c), {_quoted(p)}))) > 0" for p in xs) + ")")
    wanted += ["(" + " OR ".join(_holds_sql(r) for r in rule.any_of) + ")"] if rule.any_of else []
    return "(" + (" AND ".join(wanted) or "true") + ")"


def _first_sql(rules: Sequence[Rule], part: int | None = None) -> str:
    said = lambda r: _quoted(r.says if part is None else r.says[part])
    return "CASE " + " ".join(f"WHEN {_holds_sql(r)} THEN {said(r)}" for r in rules) + " END"


def _sql(table: str, key: str) -> str:
    at = lambda c, p: f"{_listed(VOCABULARY[c])}[{p.format(n=len(VOCABULARY[c]))} + 1]" + (" || '_' || (k % 4)" if c == "columns" else "")
    made = ", ".join(f"[{', '.join(at(c, p) for p in places)}] AS {c}" for c, places in _PLACES.items())
    kind = lambda p: f"contains(x, '{p}')" if p in ("outlier", "cluster") else f"x = '{p}'"
    category = " ".join(f"WHEN len(list_filter(kinds, lambda x: {' OR '.join(map(kind, ps))})) > 0 THEN '{name}'" for name, ps in tables.EVIDENCE_RULES)
    causes = ", ".join(f"CASE WHEN {_holds_sql(r)} THEN {_quoted(r.says[0])} END" for r in tables.CAUSES)
    stems = "list_transform(string_split(columns[1], '_')[1:2], lambda s: upper(s[1:1]) || lower(s[2:]))"
    return f"""
WITH f AS (SELECT {key} AS k FROM {table}), g AS (SELECT k, {made} FROM f),
a AS (SELECT *, CASE {category} ELSE '{tables.DEFAULT_CATEGORY}' END AS category,
  coalesce({_first_sql(tables.FAMILIES)}, array_to_string({stems}, ' ')) || ' ' || {_first_sql(tables.ENDINGS)} AS made,
  {_first_sql(tables.STATEMENTS, 0)} AS title, {_first_sql(tables.WORKSTREAMS)} AS workstream,
  list_filter([{causes}], lambda x: x IS NOT NULL) AS causes FROM g),
b AS (SELECT * REPLACE (list_concat(words, list_filter(flatten(list_transform(columns, lambda c: string_split_regex(lower(c), '[^a-z0-9]+'))),
  lambda w: length(w) >= 3)) AS words) FROM a)
SELECT k, category, coalesce({_first_sql(tables.CONCEPTS)}, made) AS concept, title, workstream, array_to_string(causes, '; ') AS causes FROM b"""


@query("rule_verdicts", _sql("customer", "c_custkey"))
def rule_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Category, concept, title, workstream and causes of facts made from customer's keys."""
    keys = read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    return verdicts(facts_of(keys)).withColumn("causes", F.array_join("causes", "; "))
