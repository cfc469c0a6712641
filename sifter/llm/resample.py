"""Target-distribution importance resampling: explode-free scores of hashed n-grams, Gumbel draws, ranks over the whole table."""

from __future__ import annotations

import json
import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifter.llm.common import durable, table

BUCKETS = 10_000
#: A document with fewer words is never drawn; the share drawn of the others, in percent; the seed of the draw.
MIN_WORDS, PERCENT, SEED = 20, 25, 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII but for digits and letters (of which A-Z are lower-cased word by word).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased and nothing else; none of a null text."""

    def lowered(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != ""), lowered)


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all single words, then of all pairs of neighbours joined by a space, repeats included."""

    def at(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: at(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, at), pairs)


def totals(texts: DataFrame, text_col: str, buckets: int) -> dict[int, int]:
    """Features of all texts by bucket. Each task sums its own first, so it sends one row for a bucket at most, as does the result."""
    words = texts.select(words_of(F.col(text_col).cast("string")).alias("words"))
    got = words.select(F.explode(buckets_of(F.col("words"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r.bucket: r.n for r in got.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Of each bucket, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), in doubles."""
    all_s, all_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(k, 0) + 1.0) * all_s / ((source.get(k, 0) + 1.0) * all_t))) for k in range(buckets)
    ]


def scores(documents: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row, in one narrow pass: the gains are a literal of len(gain) numbers."""
    values = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col).cast("string")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), len(gain)).alias("at"))
    added = F.aggregate("at", F.lit(0).cast("long"), lambda sum_, k: sum_ + F.element_at(values, k + 1))
    rows = rows.select("doc_id", "n_words", F.size("at").cast("long").alias("n_features"), added.alias("added"))
    n = F.col("n_features")
    weight = F.when(n == 0, F.lit(0)).otherwise(F.expr("(added - pmod(added, n_features)) div n_features")).cast("long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored, a written table, with rank: 1, 2, 3 ... over the drawn, by score descending, then doc_id (null last), n_features, weight.

    Documents are counted by score first. Scores are whole numbers between the least and the largest gain plus 26,000
    values of noise, so those counts are small whatever the input; they give each score the rank it starts at. Only
    drawn candidates are then ordered, score by score: of documents of one weight, at most one in 2,700 has a given score.
    """
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= min_words)
    count = sorted(((r.score, r["count"]) for r in able.groupBy("score").count().collect()), reverse=True)
    most = percent * sum(n for _, n in count) // 100
    before = [0, *accumulate(n for _, n in count)]
    starts = [(score, start) for (score, _), start in zip(count, before, strict=False) if start < most]
    columns = ["doc_id", "n_features", "weight", "score"]
    if not starts:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = starts[-1][0]
    offset = F.broadcast(spark.createDataFrame(starts, "score long, start long"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    top = able.where(F.col("score") >= last).withColumn("k", F.row_number().over(order)).join(offset, "score")
    place = F.col("start") + F.col("k")
    rest = scored.where((F.col("n_words") < min_words) | (F.col("score") < last))
    return top.select(*columns, F.when(place <= most, place).cast("long").alias("rank")).unionByName(
        rest.select(*columns, F.lit(None).cast("long").alias("rank")),
    )


def importance_resample(
    documents: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of documents: how much its words and pairs of words look like target's.

    weight: the floored mean gain of its features; score: weight plus Gumbel noise from the seed and doc_id, so the highest
    scores are a draw without replacement; rank: its place among the drawn, else null. Null and wordless texts have no
    features and weight 0; a null doc_id draws by the empty text. Repeated rows are rows of their own. An empty target or
    empty documents are smoothed like any other. Only sums by bucket are shuffled, and at the end the drawn rows' numbers.
    """
    gain = gains(totals(documents, text_col, buckets), totals(target, target_col, buckets), buckets)
    return ranked(durable(scores(documents, gain, id_col, text_col, seed), "scores"), min_words, percent)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
OP13_SQL = rf"""
WITH crc_table AS (  -- remainders of the CRC-32 polynomial for each byte
  SELECT list(list_reduce(range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
    ORDER BY b) AS t FROM range(256) AS x(b)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOWERED)} AS w FROM documents),
b AS (SELECT {_WORDS.format(_LOWERED)} AS w FROM benchmark),
df AS (SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
bf AS (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b),
df_n AS (SELECT r, f, count(*) AS n FROM df GROUP BY r, f),
names AS (SELECT DISTINCT f FROM df UNION SELECT DISTINCT f FROM bf),
bytes AS (SELECT f, hex(encode(f)) AS h FROM names),
buckets AS (SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2),
    lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295),
    4294967295) % {BUCKETS} AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM df_n JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN buckets USING (f) GROUP BY bucket),
g AS (SELECT k AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) AS x(k) LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS added FROM df_n JOIN buckets USING (f) JOIN g USING (bucket) GROUP BY r),
weighed AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (added - ((added % n_features) + n_features) % n_features) // n_features END AS weight
  FROM d LEFT JOIN w USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
    / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, CASE WHEN n_words >= {MIN_WORDS} THEN row_number() OVER (PARTITION BY n_words >= {MIN_WORDS}
    ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_words >= {MIN_WORDS}) // 100 THEN place END::BIGINT AS rank
FROM placed"""
