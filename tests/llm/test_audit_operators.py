"""Source divergence, language identification and importance resampling against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sifter.llm import divergence, language, resample

SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, k int, rank int, term string"
REST = (1, 2, 3, 4, "x")


@pytest.fixture(scope="module")
def rows():
    """A hot source and language, null and empty fields, repeated rows, a very long text, terms at the edge of being kept."""
    rng = random.Random(3)
    words = {"en": "the of and with that for", "de": "der die und nicht ein für", "": "la le et où été É"}
    made = []
    for k in range(240):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", "s4", "", None, "É"])
        own = words[lang or ""].split() + [f"w{c}x" for c in "abcdefghij"] + [f"Rare{rng.randrange(60)}", "AbÉc"]
        text = rng.choice([" ", "-", "1", "\n"]).join(rng.choices(own, k=rng.randrange(0, 60)))
        made.append((k, rng.choice([text, text, text, text.upper()]), lang, source, *REST))
    made += [(900, None, "en", "s0", *REST), (901, "", "de", None, *REST), (902, "12 34 !?", "it", "only", *REST), (None, "the und", "en", "s1", *REST)]
    made += [made[5], made[5], (903, "the of " * 40000 + "wax" * 5000, "en", "s1", *REST), (904, "x", "it", "other", *REST)]
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def audit(rows: list[tuple], least: int, top: int) -> set[tuple]:
    terms = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(r[1]))) for r in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in terms:
        df[lang].update(set(found))
        count[lang, source].update(found)
    out = set()
    for lang in {x[0] for x in terms}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in kept} for (x, s), c in count.items() if x == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in groups if o != s}
            best = {t: f(p[s][t], q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]}
            for part, got, most in (("pair", pairs, None), ("term", best, top)):
                order = sorted(got.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(order)}
    return out


@pytest.mark.parametrize(("least", "tile", "part_terms", "held"), [(10, 128, 200_000, 300_000), (3, 2, 7, 20), (500, 128, 200_000, 300_000)])
def test_divergence(docs, rows, least, tile, part_terms, held, monkeypatch):
    """Whole, and with tiles of two sources, parts of seven terms and counts handed on at once; and where no term is kept."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "OCCURRENCES", 10 * held)
    monkeypatch.setattr(divergence, "STEP", 50 if tile == 2 else divergence.STEP)
    got = divergence.source_divergence(docs, least_docs=least, tile=tile, part_terms=part_terms)
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got.collect()} == audit(rows, least, 10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_without_rows(empty):
    assert divergence.source_divergence(empty).count() == 0


def test_divergence_counts_beyond_32_bits(spark):
    """Shares of counts whose product with the scale passes 64 bits are exact."""
    from pyspark.sql import functions as F

    n, total, v = 10**12 + 7, 3 * 10**13 + 1, 12345
    got = spark.range(1).select(divergence._p(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def features(text: str | None) -> tuple[int, list[str]]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def test_resample(spark, docs, rows, empty):
    target = spark.createDataFrame([("the of and Der",), (None,), ("wax 12 the of",)], "text string")
    at = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(at(f) for r in rows for f in features(r[1])[1])
    t = Counter(at(f) for x in ("the of and Der", "wax 12 the of") for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (S + 10000) / ((s[k] + 1) * (T + 10000)))) for k in range(10000)]
    want, able = [], []
    for r in rows:
        n, fs = features(r[1])
        weight = sum(gain[at(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        row = [r[0], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        want.append(row)
        able += [row] if n >= 20 else []
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0], x[1], x[2]))
    for k, row in enumerate(able[: 25 * len(able) // 100]):
        row[4] = k + 1
    got = resample.importance_resample(docs, target)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want))
    assert {x.dataType.typeName() for x in got.schema} == {"long"}
    assert resample.importance_resample(empty, target).count() == 0
    assert resample.importance_resample(docs, target.limit(0)).where("rank is not null").count() == 25 * len(able) // 100


def test_resample_shuffles_totals_alone(docs):
    """The scoring pass has neither a shuffle nor rows for features."""
    from sifter.llm.resample import scores

    plan = scores(docs, [0] * 10000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_language_filters_against_sets():
    """No false negatives; false positives near the rate that corrects for them; masks of more than 64 languages."""
    rng = np.random.default_rng(1)
    held = [np.unique(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(70)]
    made = language.Filters([str(k) for k in range(70)], np.zeros((4000, 2), np.uint64))
    for k, names in enumerate(held):
        made.add(k, names)
    for k in (0, 63, 64, 69):
        assert language.popcounts(made.masks(held[k]), 70)[k] == len(held[k])
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert np.abs(language.popcounts(made.masks(other), 70) / len(other) - made.false_rate()).max() < 0.01


def test_letters_and_grams():
    assert "".join(map(chr, language.letters("Ab1 É--ß"))) == " ab é ß "
    assert len(language.letters("12 !")) == len(language.letters("")) == 0
    x = language.letters("abcde " * 40000)
    assert sum(map(len, language.grams(x))) == 2 * len(x) - 5
    assert [len(g) for g in language.grams(language.letters("a"))] == [1]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = [(5001, None, "en"), (5002, "12 !?", "de"), (None, "und der die nicht", None), (5003, "", None), (5004, "日本語", None), (5005, "a", "en")]
    both = docs.union(spark.createDataFrame(more, docs.schema))
    got = {r.doc_id: r for r in language.identify(both, language.train(both)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in truth)
    assert sum(got[k].lang_pred == truth[k] for k in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[k].lang_pred, got[k].score) for k in (5001, 5002, 5003)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "de" and got[None].held_out is False
    assert (got[5004].lang_pred, got[5004].score) == ("en", 0.0)


def test_language_learns_from_its_share_alone(spark):
    """Held-out rows, null languages and null ids teach nothing; the sample is the same for any partitioning."""
    told = [(k, "alpha beta gamma", "aa") for k in range(200)] + [(k, "delta epsilon", "bb") for k in range(200, 300)]
    told += [(k, "alpha beta gamma", "cc") for k in range(3000) if zlib.crc32(str(k).encode()) % 5 == 0] + [(None, "zeta", "dd"), (7001, "zeta", None)]
    one = spark.createDataFrame(told, "doc_id long, text string, lang string")
    a, b = (language.train(one.repartition(n), train_docs=20) for n in (1, 7))
    assert a.langs == b.langs == ["aa", "bb"] and np.array_equal(a.slices, b.slices)
    none = language.identify(one, language.train(one.limit(0))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in none] == [("und", 0.0)]
