"""Source divergence audit: how far the words of each source are from those of the other sources of its language."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.llm.common import durable, rows, small_batches, table

#: Documents of a language that a kept term is in, at least; terms of a group that are reported.
LEAST_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: Terms, and their bytes, of one automaton (about 100 MB); a larger vocabulary is counted part by part.
PART_TERMS, PART_BYTES = 200_000, 4 << 20
#: Counts of documents, and occurrences, that a task holds before it hands on their sums.
HELD, OCCURRENCES = 300_000, 2_000_000
#: Sources of a language that meet in one tile; postings of a piece of a language's terms; pairs of postings that are worked on at once.
TILE, PIECE, STEP = 128, 50_000, 1 << 18
_BYTES = bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: By byte: A-Z lower-cased, what stands between terms a blank, all else as it is (bytes from 0x80 on are parts of letters).
PLAIN = bytes(32 if b in _BYTES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def plain(text: bytes | None) -> bytes:
    """The text with blanks between its terms."""
    return (text or b"").translate(PLAIN)


def _told(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """lang, source and the text's bytes, null as empty."""
    small_batches(docs.sparkSession)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"), name(text_col).cast("binary").alias("text"))


def _text(words: list[bytes]) -> pa.Array:
    """Terms as strings; bytes that are no UTF-8 as replacement characters."""
    try:
        return pa.array(words, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([w.decode(errors="replace") for w in words], pa.string())


def _batch(held: dict[str, Counter]) -> pa.RecordBatch:
    """Counts of each language's terms as rows."""
    langs = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(own) for own in held.values()])))
    terms = _text([term for own in held.values() for term in own])
    return pa.RecordBatch.from_arrays([langs, terms, pa.array([n for own in held.values() for n in own.values()], pa.int64())], ["lang", "term", "n"])


def document_frequencies(told: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language that have the term, exact. Tasks sum their own documents before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in rows([batch]):
                held.setdefault(lang, Counter()).update(set(plain(text).split()))
                if sum(map(len, held.values())) > HELD:
                    yield _batch(held)
                    held = {}
        yield _batch(held)

    counted = told.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n"))


#: The last automaton this worker built, by the name of its part.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, terms: list[str]) -> ahocorasick.Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(terms):
            made.add_word(f" {term} ", k)
        made.make_automaton()
        _BUILT[name] = made
    return _BUILT[name]


def recount(told: DataFrame, part: list[tuple[str, list[str]]]) -> DataFrame:
    """(lang, source, term, n): occurrences of the part's terms, which are kept in the languages named with each.

    Terms stand between blanks in the automaton, so that it finds whole terms only; neighbours share a blank.
    """
    spark = told.sparkSession
    sent = spark.sparkContext.broadcast(([term for term, _ in part], [frozenset(langs) for _, langs in part]))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, kept = sent.value
        if not terms:
            return
        find, named = _automaton(name, terms).iter, pa.array(terms, pa.string())
        inside: dict[str, np.ndarray] = {}  # by language, which of the terms it keeps
        groups: dict[tuple[str, str], int] = {}
        found: list[np.ndarray] = []  # of each document its group and the terms' numbers, 32 bits each

        def summed() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(code >> 32)) for k in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, named.take(pa.array(code & 0xFFFFFFFF)), pa.array(n, pa.int64())], ["lang", "source", "term", "n"])

        size = 0
        for batch in batches:
            for lang, source, text in rows([batch]):
                if lang not in inside:
                    inside[lang] = np.fromiter((lang in langs for langs in kept), bool, len(kept))
                spaced = (b" " + plain(text) + b" ").decode(errors="replace")
                at = np.fromiter(map(itemgetter(1), find(spaced)), np.int64)
                at = at[inside[lang][at]]
                found.append(at | groups.setdefault((lang, source), len(groups)) << 32)
                size += len(at)
                if size > OCCURRENCES or len(found) > OCCURRENCES:
                    yield summed()
                    groups, found, size = {}, [], 0
        yield summed()

    return told.mapInArrow(run, "lang string, source string, term string, n long")


def occurrences(told: DataFrame, kept: DataFrame, part_terms: int = PART_TERMS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, term, n), n > 0, of the kept terms: one scan for each part of the vocabulary, so that automata stay small.

    A part comes to the driver and goes to each executor: part_terms terms and part_bytes bytes on average, by the terms' hash.
    """
    terms = kept.groupBy("term").agg(F.collect_set("lang").alias("langs"))  # a term's languages
    terms = durable(terms.withColumn("h", F.xxhash64("term")), "terms")
    size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    parts = max(1, math.ceil(size.n / part_terms), math.ceil((size.bytes or 0) / part_bytes))
    got = None
    for k in range(parts):
        part = [(r.term, r.langs) for r in terms.where(F.pmod("h", F.lit(parts)) == k).select("term", "langs").toLocalIterator()]
        found = recount(told, part).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        found = durable(found, "occurrences")
        got = found if got is None else got.unionByName(found)
    return got


def _p(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 v)), whole numbers throughout."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * v)) + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): p and q are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _fn(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(postings: DataFrame, piece: int = PIECE, tile: int = TILE) -> DataFrame:
    """(lang, a, b, value) for sources a < b of a language that share kept terms: the sum, over those terms, of
    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0); p0 and q0 are what a term has that the source is without.

    postings: lang, k (the source's number in its language), term, p, p0. Sources meet tile by tile, on a piece of the language's terms
    each, and a piece has as many terms as make up about `piece` postings. Pairs are summed where they arise, STEP at a time.
    """
    total = postings.groupBy("lang").agg(F.count("*").alias("n"), F.max("k").alias("last"))
    all_n = postings.count()
    aim = min(piece, max(2000, all_n // 1000))
    pieces = total.select("lang", F.ceil(F.col("n") / aim).cast("long").alias("pieces"), (F.floor(F.col("last") / tile) + 1).cast("int").alias("tiles"))
    # A row for each language that has terms.
    sent = postings.join(F.broadcast(pieces), "lang").withColumn("own", F.floor(F.col("k") / tile).cast("int"))
    sent = sent.withColumn("piece", F.pmod(F.xxhash64("term"), F.col("pieces")).cast("long"))
    # To each tile of its own block of sources with another block, or with itself.
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select(
        "lang",
        "piece",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "k",
        "term",
        "p",
        "p0",
    )

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lang, _, i, j = key
        term = group["term"].factorize()[0]
        k, p, p0 = (group[c].to_numpy(np.int64) for c in ("k", "p", "p0"))
        order = np.lexsort((k, term))
        term, k, p, p0 = term[order], k[order], p[order], p0[order]
        # Each posting meets those of its term that come after it; in a tile of two blocks, those of the other block.
        end = np.searchsorted(term, term, side="right")
        first = np.arange(1, len(term) + 1)
        if i != j:
            cut = np.searchsorted(term * (1 << 32) + k, term * (1 << 32) + j * tile)
            first = np.where(k < j * tile, cut, end)
        many = end - first
        sums: dict[int, int] = {}
        begin = np.concatenate([[0], np.cumsum(many)])
        at = 0
        while at < len(many):
            stop = max(at + 1, int(np.searchsorted(begin, begin[at] + STEP, side="right")) - 1)
            a = np.repeat(np.arange(at, stop), many[at:stop])
            b = np.arange(begin[at], begin[stop]) - np.repeat(begin[at:stop], many[at:stop]) + np.repeat(first[at:stop], many[at:stop])
            value = _fn(p[a], p[b]) - _fn(p[a], p0[b]) - _fn(p0[a], p[b]) + _fn(p0[a], p0[b])
            pair = k[a] << 32 | k[b]
            order = np.argsort(pair, kind="stable")
            pair, starts = np.unique(pair[order], return_index=True)
            for x, v in zip(pair.tolist(), np.add.reduceat(value[order], starts).tolist() if len(pair) else [], strict=True):
                sums[x] = sums.get(x, 0) + v
            at = stop
        return pd.DataFrame(
            {
                "lang": lang,
                "a": np.array([x >> 32 for x in sums], np.int64),
                "b": np.array([x & 0xFFFFFFFF for x in sums], np.int64),
                "value": np.array(list(sums.values()), np.int64),
            },
        )

    got = sent.groupBy("lang", "piece", "i", "j").applyInPandas(meet, "lang string, a long, b long, value long")
    return got.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def groups_of(told: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, k, total, v, lang_total, p0): every group with its number in its language, its occurrences, the language's terms."""
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = told.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["total", "v"])
    own = Window.partitionBy("lang")  # the sources of a language, all pairs of which are the result
    every = every.withColumn("k", F.row_number().over(own.orderBy("source")) - 1).withColumn("lang_total", F.sum("total").over(own))
    p0 = F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    return every.select("lang", "source", F.col("k").cast("long").alias("k"), "total", "v", "lang_total", p0.alias("p0"))


def pair_values(groups: DataFrame, postings: DataFrame, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for each source and each other source of its language.

    A term that both lack gives f(p0, q0), the same for all; so the sum is v f(p0, q0), what the terms of either source alone
    add to that, which goes by its counts, and shared_terms().
    """
    by_p = postings.groupBy("lang", "k", "p").agg(F.count("*").alias("n"))  # a group has few counts: their sum is at most its occurrences
    by_p = by_p.groupBy("lang", "k").agg(F.collect_list(F.struct("p", "n")).alias("by_p"))
    own = groups.join(by_p, ["lang", "k"], "left").withColumn("block", F.floor(F.col("k") / tile).cast("int"))
    tiles = groups.groupBy("lang").agg((F.floor(F.max("k") / tile) + 1).cast("int").alias("tiles"))
    own = own.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    a = own.select("lang", F.col("block").alias("i"), F.col("other").alias("j"), "v", *(F.col(c).alias(f"{c}_a") for c in ("source", "k", "p0", "by_p")))
    b = own.select("lang", F.col("other").alias("i"), F.col("block").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("source", "k", "p0", "by_p")))
    pairs = a.join(b, ["lang", "i", "j"]).where("k_a != k_b")

    def alone(by_p: str, p0: str, other: str) -> Column:
        base, q0 = _f(F.col(p0), F.col(other)), F.col(other)
        added = F.aggregate(by_p, F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * (_f(x["p"], q0) - base))
        return F.coalesce(added, F.lit(0))

    shared = shared_terms(postings, tile=tile)
    pairs = pairs.withColumn("a", F.least("k_a", "k_b")).withColumn("b", F.greatest("k_a", "k_b"))
    pairs = pairs.join(shared.withColumnRenamed("value", "shared"), ["lang", "a", "b"], "left")
    value = F.col("v") * _f(F.col("p0_a"), F.col("p0_b")) + alone("by_p_a", "p0_a", "p0_b") + alone("by_p_b", "p0_b", "p0_a")
    value = F.when(F.col("v") > 0, value + F.coalesce("shared", F.lit(0))).otherwise(0)
    return pairs.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.cast("long").alias("value"))


def term_values(groups: DataFrame, counts: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has beyond its language's share, the highest values alone."""
    here = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    p, q = _p(F.col("n"), F.col("total"), F.col("v")), _p(F.col("all"), F.col("lang_total"), F.col("v"))
    here = here.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    here = here.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return here.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    part_terms: int = PART_TERMS,
    part_bytes: int = PART_BYTES,
    tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source, all other sources of its language (part `pair`) and its most unusual terms
    (part `term`).

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in least_docs of its
    documents or more. A first scan counts documents exactly, a second one occurrences, by an automaton of the kept terms. Null
    text, lang and source are empty ones; a group without terms has pairs, whose value is 0 if its language keeps no term. Repeated rows
    are documents of their own. An empty table gives no rows.
    """
    told = _told(docs, text_col, lang_col, source_col)
    kept = durable(document_frequencies(told).where(F.col("n") >= least_docs).select("lang", "term"), "kept")
    counts = occurrences(told, kept, part_terms, part_bytes)
    groups = durable(groups_of(told, kept, counts), "groups")
    both = counts.join(groups.select("lang", "source", "k", "total", "v", "p0"), ["lang", "source"])
    postings = durable(both.select("lang", "k", "term", _p(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0"), "postings")
    pairs = pair_values(groups, postings, tile)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    said = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int"))
    return said(pairs, "pair").unionByName(said(term_values(groups, counts, top), "term"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


_P = f"(1 + {SCALE}::HUGEINT * ({{}} + 2) // ({{}} + 2 * v))"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total, coalesce(any_value(v), 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN vs USING (lang) GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "total")} AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lp AS (SELECT lang, term, {_P.format("n", "total")} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)
  JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS one, y.source AS two, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s
  ON s.lang = a.lang AND s.one = a.source AND s.two = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item) AS rank FROM (
    SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term))
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
