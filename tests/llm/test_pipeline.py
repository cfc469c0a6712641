"""The pipeline's stages on a small corpus with planted cases, and the registered names."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import corpus_pipeline as pipe
from sifter.llm import quality

SF = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubdgklmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1).collect())
    good = [f"{prose(rng, 60).capitalize()}.\n{prose(rng, 50).capitalize()}." for _ in range(12)]
    near = good[0].replace(good[0].split()[40], "changed", 1)
    junk = "\n".join(" ".join(f"{w}$$$" for w in prose(rng, 30).split()) for _ in range(4))
    texts = dict(enumerate(good)) | {20: good[1], 21: near, 22: junk, 23: f"{prose(rng, 40)}\n{item}\n{prose(rng, 30)}", 24: None, 25: ""}
    shared = "\n".join(prose(rng, 9) for _ in range(4))
    texts |= {26: f"{prose(rng, 60)}\n{shared}\n{prose(rng, 60)}", 27: f"{prose(rng, 70)}\n{shared}\n{prose(rng, 50)}"}
    rows = [(k, t, "en", "src1", len(t) if t is not None else None) for k, t in texts.items()] + [(None, good[5], "en", "s", 1)]
    return spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema), texts, item


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_stages(spark, corpus):
    docs, texts, item = corpus
    # The labels belong to the table's own documents, so the planted ones get other ids.
    far = docs.select((docs.doc_id + 10_000_000).alias("doc_id"), *docs.columns[1:]).union(spark.read.parquet(f"{SF}/documents.parquet"))
    kept = pipe.quality(spark, far, SF)
    left = {k - 10_000_000 for k in ids(kept) if k is not None and k >= 10_000_000}
    assert kept.columns == docs.columns and 22 not in left and set(range(12)) <= left
    lined = pipe.lines(spark, docs, SF)
    by = {r.doc_id: r for r in lined.collect()}
    assert lined.columns == docs.columns and len(
        by[26].text.split("\n"),
    ) == 6 and len(by[27].text.split("\n")) == 2 and by[27].n_chars == len(by[27].text)
    assert all(by[k].text == texts[k] for k in by if k is not None and k != 27)
    once = pipe.near_dedup(spark, docs, SF)
    assert once.columns == docs.columns
    gone = set(ids(docs)) - set(ids(once))
    assert {20, 21} <= gone and 25 in gone and None in gone and not gone & set(range(12))
    clean = pipe.decontaminate(spark, docs, SF)
    assert set(ids(docs)) - set(ids(clean)) == {23} and clean.columns == docs.columns
    packed = pipe.packing(spark, docs, SF).collect()
    total = defaultdict(int)
    for r in packed:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048 and {r.doc_id for r in packed} == set(ids(docs))


def test_run_and_empty(spark):
    got = pipe.run(spark, SF)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and [n for n, _ in pipe.STAGES] == [
        "quality",
        "line_dedup",
        "near_dedup",
        "decontamination",
        "packing",
    ]


def test_score_ignores_labels():
    assert quality.Chain(quality.np.zeros(quality.N_WEIGHTS), quality.np.zeros((2, 2))).score(b"any text") == 0.5


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + pipe.SHINGLE]) for k in range(max(1, len(w) - pipe.SHINGLE + 1))} if w else set()


def test_near_dedup_is_exact(spark):
    """Pairs around the similarity, of all lengths: what stays is what exact Jaccard indices of all pairs leave."""
    rng = random.Random(5)
    texts = []
    for n in (8, 9, 14, 30, 60, 120, 400):
        for _ in range(6):
            words = prose(rng, n).split()
            for cut in (0, 0.06, 0.1, 0.14, 0.2, 0.3):
                texts.append(" ".join(words[: n - round(cut * n)] + prose(rng, round(cut * n) // 2).split()))
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= pipe.SIMILARITY:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert ids(pipe.near_dedup(spark, docs, SF)) == [k for k in range(len(texts)) if root(k) == k]


def test_confirmed_by_blocks(spark):
    """Groups cut into blocks give the classes of groups held whole."""
    from sifter.llm import neardup
    from sifter.llm.components import components

    rng = random.Random(9)
    base = prose(rng, 80).split()
    sets = [neardup.shingle_set(" ".join(w if rng.random() > k / 900 else "x" + w for w in base).encode(), 5) for k in range(60)]
    made = spark.createDataFrame([(k, x.astype("<u8").tobytes()) for k, x in enumerate(sets)], "node long, grams binary")
    of = spark.createDataFrame([(k, 0, len(x)) for k, x in enumerate(sets)], "node long, component long, size long")
    got = [
        {(r.node, r.component) for r in components(neardup.confirmed(made, of, 0.8, block=b, share=s)).collect()}
        for b, s in ((1 << 22, 1 << 16), (300, 300), (10_000, 1000))
    ]
    assert got[0] and got[0] == got[1] == got[2]


def test_null_ids_go_by_their_own_text(spark):
    """Of several rows with null ids only the copies, near copies and contaminated ones go."""
    rng = random.Random(21)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1).collect())
    alone, twin, named = ([prose(rng, 90) for _ in range(n)] for n in (4, 1, 1))
    near = alone[3].replace(alone[3].split()[30], "changed", 1)
    bad = f"{prose(rng, 40)} {item} {prose(rng, 30)}"
    rows = [(7, named[0])] + [(None, t) for t in [*alone[:3], named[0], twin[0], twin[0], alone[3], near, bad]]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    once = [(r.doc_id, r.text) for r in pipe.near_dedup(spark, docs, SF).collect()]
    assert len(once) == 7 and set(once) - {(None, alone[3]), (None, near)} == {
        (7, named[0]),
        (None, twin[0]),
        (None, bad),
        *((None, t) for t in alone[:3]),
    }
    clean = sorted((r.text for r in pipe.decontaminate(spark, docs, SF).collect()))
    assert clean == sorted(t for _, t in rows if t != bad)


def test_blank_remainders_and_clashing_columns(spark):
    """A text that line dedup leaves blank goes; extra columns named like the operators' own, and repeated rows, do no harm."""
    rng = random.Random(31)
    block = "\n".join(prose(rng, 9) for _ in range(4))
    rows = [(1, f"{block}\n\t"), (2, f"{block}\n \t\n"), (3, prose(rng, 80)), (3, prose(rng, 70)), (4, None), (5, "")]
    base = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows] * 2, spark.read.parquet(f"{SF}/documents.parquet").schema)
    lined = pipe.lines(spark, base.where("doc_id in (1, 2)").distinct(), SF)
    assert ids(lined) == [1]
    names = ["key", "row", "node", "kept", "gone", "line", "fingerprint", "component", "size", "at", "first", "copies", "n_removed"]
    wide = base.selectExpr("*", *(f"'x' as `{c}`" for c in names))
    for _, stage in pipe.STAGES[:4]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns and got.count() <= wide.count()
    once = pipe.near_dedup(spark, wide, SF)
    assert ids(once) == [1, 3, 3, 4]
