"""Quality classifier: a linear-chain conditional random field over the lines of a text."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import byte_words, id_text, rows, small_batches, table

#: Upper bounds of the bins of each line feature; the last bin is open.
BINS = {
    "words": (0, 2, 7, 20, 60),
    "symbols_per_word": (0, 0.02, 0.1, 0.3, 0.7),
    "bars_per_word": (0, 0.05, 0.2, 0.5),
    "marks_per_word": (0, 0.1, 0.4, 0.8),
    "upper_share": (0.02, 0.1, 0.3, 0.6),
    "digit_share": (0, 0.05, 0.2, 0.5),
    "distinct_share": (0.2, 0.4, 0.6, 0.75, 0.9),
    "echo_share": (0, 0.05, 0.2, 0.5),
    "word_bytes": (2, 4, 7, 11, 20),
    "seen_before": (0,),
}
_EDGES = [np.array(x, float) for x in BINS.values()]
#: Bins of a feature, one more for "no such line" (before the first and after the last).
WIDTH = max(map(len, BINS.values())) + 2
N_WEIGHTS = 3 * len(BINS) * WIDTH + 1
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL = b"#*$%&<>"
#: Bound of the labelled sample; lines of a chain in training (longer texts are several chains, all of which count).
TRAIN_DOCS, SEGMENT, THRESHOLD = 4000, 256, 0.3


def line_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Bin numbers (lines, features) and byte lengths of the lines with a word; an empty text has one empty line."""
    values, size, seen = [], [], set()
    for line in (text or b"").split(b"\n"):
        words = byte_words(line)
        if not words:
            continue
        n, chars = len(words), len(line)
        gone = lambda cut: chars - len(line.translate(None, cut))  # noqa: B023, E731
        values.append(
            (
                n,
                gone(_SYMBOL) / n,
                line.count(b"|") / n,
                line.count(b"!") / n,
                gone(_UPPER) / chars,
                gone(_DIGIT) / chars,
                len(set(words)) / n if n > 3 else 1.0,
                sum(map(operator.eq, words, words[1:])) / n,
                sum(map(len, words)) / n,
                line in seen,
            ),
        )
        size.append(chars)
        seen.add(line)
    if not values:
        values, size = [(0.0,) * len(BINS)], [1]
    values = np.array(values, float)
    return np.stack([np.searchsorted(e, values[:, k], "left") for k, e in enumerate(_EDGES)], 1).astype(np.uint8), np.array(size, np.int64)


def weight_places(bins: np.ndarray) -> np.ndarray:
    """(lines, 3 * features) places of the weights that each line of one text turns on: its own, the one before's and the one after's."""
    none = np.full((1, bins.shape[1]), WIDTH - 1, np.int64)
    b = bins.astype(np.int64)
    wide = np.concatenate([b, np.r_[none, b[:-1]], np.r_[b[1:], none]], 1)
    return wide + np.arange(wide.shape[1]) * WIDTH


@dataclass
class Chain:
    """Weights: one for each place (for "good", against none for "bad"), a bias, and a 2 x 2 table of transitions."""

    weight: np.ndarray
    step: np.ndarray

    def marginals(self, places: np.ndarray) -> list[float]:
        """Probability of "good" for each line, by forward-backward over log odds."""
        own = (self.weight[places].sum(1) + self.weight[-1]).tolist()
        (bb, bg), (gb, gg) = np.exp(self.step - self.step.max()).tolist()

        def passed(odds: float, a: float, b: float, c: float, d: float) -> float:
            x = math.exp(min(max(odds, -30.0), 30.0))
            return math.log((x * a + b) / (x * c + d))

        n = len(own)
        ahead, back = [0.0] * n, [0.0] * n
        ahead[0] = own[0]
        for k in range(1, n):
            ahead[k] = own[k] + passed(ahead[k - 1], gg, bg, gb, bb)
        for k in range(n - 2, -1, -1):
            back[k] = passed(own[k + 1] + back[k + 1], gg, gb, bg, bb)
        return [1 / (1 + math.exp(-min(max(a + b, -30.0), 30.0))) for a, b in zip(ahead, back, strict=True)]

    def score(self, text: bytes | None) -> float:
        bins, size = line_features(text)
        p = np.array(self.marginals(weight_places(bins)))
        return float((p * size).sum() / size.sum())


def fit_chain(
    texts: list[np.ndarray],
    labels: np.ndarray,
    rounds: int = 150,
    rate: float = 0.15,
    decay: float = 1e-3,
    linked: bool = True,
    segment: int = SEGMENT,
) -> Chain:
    """Chain of greatest regularised likelihood, by Adam; texts: bins of each text; a text's label holds for all its lines.

    Whole texts are learnt from; one of more than `segment` lines is cut into chains of that length, whose lines keep their neighbours'
    features and together weigh as much as any text. Chains go side by side, longest first, so each step of the recursions is one
    array operation. Without `linked` transitions stay at zero: a logistic regression over the same features.
    """
    weight, step = np.zeros(N_WEIGHTS), np.zeros((2, 2))
    if not texts or len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        weight[-1] = math.log(share / (1 - share))
        return Chain(weight, step)
    whole = np.array([len(x) for x in texts])
    cut = [(k, at) for k, n in enumerate(whole) for at in range(0, n, segment)]
    size = np.array([min(segment, whole[k] - at) for k, at in cut])
    order = np.argsort(-size, kind="stable")
    cut, size = [cut[k] for k in order], size[order]
    own_places = [weight_places(x) for x in texts]
    places = np.concatenate([own_places[k][at : at + segment] for k, at in cut])
    labels, weigh = labels[[k for k, _ in cut]].astype(float), 1 / whole[[k for k, _ in cut]]
    line_label = np.repeat(labels, size)
    start, top = np.cumsum(size) - size, int(size[0])
    live = [int((size > t).sum()) for t in range(top)]
    total, share = len(places), 1 / len(texts)
    # Each text weighs the same, whatever its number of lines.
    line_weight = np.repeat(weigh, size)
    seen_pairs = np.zeros((2, 2))
    pair_weight = (size - 1) * weigh
    seen_pairs[0, 0], seen_pairs[1, 1] = (pair_weight * (1 - labels)).sum(), (pair_weight * labels).sum()
    m_w, v_w, m_s, v_s = np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS), np.zeros((2, 2)), np.zeros((2, 2))
    for t in range(1, rounds + 1):
        own = np.zeros((total, 2))
        own[:, 1] = weight[places].sum(1) + weight[-1]
        a, b = np.empty((total, 2)), np.zeros((total, 2))
        a[start] = own[start]
        a[start] -= np.logaddexp(a[start, 0], a[start, 1])[:, None]
        for k in range(1, top):
            at = start[: live[k]] + k
            prev = a[at - 1]
            now = own[at] + np.logaddexp(prev[:, :1] + step[0], prev[:, 1:] + step[1])
            a[at] = now - np.logaddexp(now[:, 0], now[:, 1])[:, None]
        pairs = np.zeros((2, 2))
        for k in range(top - 2, -1, -1):
            at = start[: live[k + 1]] + k
            nxt = own[at + 1] + b[at + 1]
            joint = a[at][:, :, None] + step[None] + nxt[:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            e = np.exp(joint)
            pairs += (e / e.sum((1, 2), keepdims=True) * weigh[: live[k + 1], None, None]).sum(0)
            back = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
            b[at] = back - np.logaddexp(back[:, 0], back[:, 1])[:, None]
        good = 1 / (1 + np.exp(np.clip((a + b)[:, 0] - (a + b)[:, 1], -30, 30)))
        left = (line_label - good) * line_weight
        g_w = np.bincount(places.ravel(), np.repeat(left, places.shape[1]), N_WEIGHTS)
        g_w[-1] = left.sum()
        g_w, g_s = g_w * share - decay * weight, (seen_pairs - pairs) * share - decay * step
        m_w, m_s = 0.9 * m_w + 0.1 * g_w, 0.9 * m_s + 0.1 * g_s
        v_w, v_s = 0.99 * v_w + 0.01 * g_w**2, 0.99 * v_s + 0.01 * g_s**2
        c, d = 1 - 0.9**t, 1 - 0.99**t
        weight = weight + rate * (m_w / c) / (np.sqrt(v_w / d) + 1e-8)
        step = step + linked * rate * (m_s / c) / (np.sqrt(v_s / d) + 1e-8)
    return Chain(weight, step)


def train(
    docs: DataFrame,
    labels: DataFrame,
    train_docs: int = TRAIN_DOCS,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Chain:
    """Chain fitted to at most train_docs labelled documents whose crc32(id as text) mod 5 is not 0.

    The sample is the labelled ids of least hash, whole texts. An id labelled more than once takes its mean label, 0.5 or more
    counting as 1. Null ids and null labels are left out. Without both classes the score is the labels' share, smoothed.
    """
    known = labels.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(label_col).cast("double").alias("label"),
    ).where("doc_id is not null and label is not null")
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    picked = known.groupBy("doc_id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label"),
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(doc_id, label, line_features(text)[0].tobytes()) for doc_id, text, label in rows([batch])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in got], pa.int64()),
                    pa.array([x[1] for x in got], pa.int32()),
                    pa.array([x[2] for x in got], pa.binary()),
                ],
                ["doc_id", "label", "bins"],
            )

    joined = id_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    got = sorted(
        (
            (r.doc_id, r.label, bytes(r.bins))
            for r in joined.select("doc_id", "text", "label").mapInArrow(
                bins,
                "doc_id long, label int, bins binary",
            ).toLocalIterator()
        ),
    )
    return fit_chain([np.frombuffer(x[2], np.uint8).reshape(-1, len(BINS)) for x in got], np.array([x[1] for x in got], np.int64))


def quality_scores(
    docs: DataFrame,
    chain: Chain,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; with keep, docs' own columns of the rows predicted 1.

    score: each line's probability of being good, weighted by its bytes. Lines without a word have no weight; null and
    empty texts are one empty line. held_out: crc32(id as text) mod 5 is 0 (false for a null id).
    """
    weight, step = chain.weight, chain.step
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(weight, step)
        for batch in batches:
            text = pc.cast(batch["text" if not keep else text_col], pa.binary())
            score = [model.score(x) for at in range(0, len(text), 256) for x in text.slice(at, 256).to_pylist()]
            if keep:
                yield batch.filter(pa.array([x >= threshold for x in score], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64())], ["doc_id", "score"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    got = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
