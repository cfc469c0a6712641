"""License scans: a trained paragraph classifier, confirmed by templates. DataFrame and Spark ML functions only."""

from __future__ import annotations

import re
from itertools import pairwise

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sifter.llm.common import durable, table

#: Short notices by family; {v} stands for a version. They train the classifier and confirm what it finds.
TEMPLATES = {
    "apache": [
        "apache license version {v}",
        "licensed under the apache license version {v}",
        "you may not use this file except in compliance with the apache license",
        "released under the apache software license {v}",
        "distributed under the terms of the apache license version {v}",
        "spdx license identifier apache {v}",
    ],
    "mit": [
        "mit license",
        "released under the mit license",
        "licensed under the mit license",
        "this project is available under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files",
        "spdx license identifier mit",
    ],
    "gpl": [
        "gnu general public license version {v}",
        "this work is licensed under the gnu general public license version {v}",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "released under the gnu gpl version {v}",
        "licensed under the gpl v {v}",
        "spdx license identifier gpl {v} or later",
    ],
    "lgpl": [
        "gnu lesser general public license version {v}",
        "licensed under the gnu lesser general public license version {v}",
        "this library is free software under the terms of the gnu lesser general public license",
        "released under the lgpl version {v}",
        "spdx license identifier lgpl {v}",
    ],
    "agpl": [
        "gnu affero general public license version {v}",
        "licensed under the gnu affero general public license version {v}",
        "released under the agpl version {v}",
        "spdx license identifier agpl {v}",
    ],
    "bsd": [
        "bsd {v} clause license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "released under the bsd license",
        "licensed under the bsd {v} clause license",
        "spdx license identifier bsd {v} clause",
    ],
    "mpl": [
        "mozilla public license version {v}",
        "this source code form is subject to the terms of the mozilla public license version {v}",
        "licensed under the mozilla public license {v}",
        "released under the mpl {v}",
        "spdx license identifier mpl {v}",
    ],
    "cc-by-nc": [
        "licensed under cc by nc {v}",
        "this work is licensed under a creative commons attribution noncommercial {v} license",
        "released under cc by nc {v}",
        "available under the creative commons by nc {v} licence",
    ],
    "cc-by-sa": [
        "licensed under cc by sa {v}",
        "this work is licensed under a creative commons attribution sharealike {v} license",
        "released under cc by sa {v}",
        "text is available under the creative commons attribution sharealike license",
    ],
    "cc-by": [
        "licensed under cc by {v}",
        "this work is licensed under a creative commons attribution {v} license",
        "released under cc by {v}",
        "available under the creative commons attribution {v} international licence",
    ],
    "cc0": [
        "released under cc0 {v}",
        "dedicated to the public domain under cc0 {v} universal",
        "no rights reserved this work is in the public domain",
    ],
    "reserved": [
        "all rights reserved",
        "copyright {v} the authors all rights reserved",
        "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
    ],
}
#: Paragraphs that use such words without being a notice.
OTHER = [
    "the driver renewed a license at the office",
    "a fishing licence is required on this lake",
    "she asked for permission to leave the room",
    "the apache helicopter landed near the river",
    "the gnu grazes on the open plain",
    "mit is a university in cambridge massachusetts",
    "the general public may visit the museum on sunday",
    "copyright law differs from country to country",
    "the free version has fewer features than the paid one",
    "this version of the song was released in june",
    "the terms of the contract were not met",
    "the source of the river lies in the hills",
    "creative work takes time and attention",
    "the warranty on the car ended last year",
    "rights and duties of the citizens are listed below",
    "the public domain name was registered in may",
    "the distribution of income is uneven",
    "software runs on the computer",
    "redistribution of land followed the reform",
    "he licensed the patent to a company",
    "the commons debated the bill until night",
    "a license plate fell from the truck",
    "permission slips are due on friday",
    "version two of the plan was rejected",
]
#: Beginnings of words of the templates, and words too short to be sought by their beginning. Of every template, more than 1 - CONFIRM
#: of the two-word runs have such a word (touched() says how many), so a paragraph without any can't be confirmed and needs no score.
MARKS = (
    "licen", "apache", "compliance", "except", "distribut", "redistribut", "spdx", "released", "available", "terms", "hereby",
    "obtaining", "software", "associated", "gnu", "gpl", "lgpl", "agpl", "bsd", "binary", "modification", "permitted", "mozilla", "creative",
    "domain", "rights", "reserved", "copyright", "unauthorized", "prohibited", "proprietary", "confidential", "strictly", "subject",
)
WHOLE_MARKS = ("cc", "mpl")
#: Lines that a wrapped notice may take.
MOST_LINES = 4
FEATURES, CONFIRM, SURE = 1 << 12, 0.6, 0.5
UNKNOWN = "unknown"


def template_words(text: str) -> list[str]:
    """A template's words as tokens() gives them."""
    plain = re.sub(r"[0-9]+(\.[0-9]+)*", " 0 ", text.format(v="0").lower())
    return re.sub(r"[^a-z0]+", " ", plain).split()


def touched(text: str) -> float:
    """Share of a template's two-word runs that have a marked word."""
    marked = lambda w: w in WHOLE_MARKS or w.startswith(MARKS)
    runs = set(pairwise(template_words(text)))
    return sum(marked(a) or marked(b) for a, b in runs) / len(runs)


def _mark_pattern() -> str:
    """Marks at the beginning of a word, by first letter, so that few of them are tried at a place and none inside a word."""
    tails: dict[str, list[str]] = {}
    for mark in [*MARKS, *(f"{m}(?![a-z])" for m in WHOLE_MARKS)]:
        tails.setdefault(mark[0], []).append(mark[1:])
    return f"[^a-z](?:{'|'.join(f'{c}(?:{"|".join(t)})' for c, t in sorted(tails.items()))})"


MARK_PATTERN = _mark_pattern()


def has_mark(lower: Column) -> Column:
    """Whether text in lower case has a marked word: none of the paragraphs that can be confirmed lacks one."""
    return F.concat(F.lit(" "), lower).rlike(MARK_PATTERN)


def tokens(text: Column) -> Column:
    """Lower-case words of a paragraph; a number, with its points, is the one word 0."""
    plain = F.regexp_replace(F.lower(text), r"[0-9]+(\.[0-9]+)*", " 0 ")
    return F.filter(F.split(F.regexp_replace(plain, r"[^a-z0]+", " "), " "), lambda x: x != "")


def grams(words: Column, n: int) -> Column:
    """Runs of n words; of all of them if there are fewer."""
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))),
            lambda k: F.array_join(F.slice(words, k, n), " "),
        ),
    ).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def _features(df: DataFrame) -> DataFrame:
    df = df.withColumn("words", tokens(F.col("paragraph")))
    named = lambda n: F.transform(grams(F.col("words"), n), lambda g: F.concat(F.lit(f"{n}:"), g))
    df = df.withColumn("grams", F.concat(named(1), named(2), named(3)))
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(df)


def _examples() -> list[tuple[str, str, bool]]:
    """(paragraph, family, used for calibration): templates at several versions, whole and with words before or after."""
    out = []
    frames = ["{}", "{} .", "note {}", "{} see the file for details", "unless stated otherwise {}", "the text below is {}"]
    for family, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            for j, frame in enumerate(frames):
                out.append((frame.format(text.format(v="0")), family, (i + j) % 4 == 3))
    for i, text in enumerate(OTHER):
        words = text.split()
        for j, made in enumerate(
            [text, " ".join(reversed(words)), " ".join(words[len(words) // 2 :]), f"{text} and {OTHER[(i + 7) % len(OTHER)]}"],
        ):
            out.append((made, UNKNOWN, (i + j) % 4 == 3))
    return out


class Scanner:
    """A multinomial logistic regression over sparse word n-grams (1 to 3), with a calibrated temperature."""

    def __init__(self, spark: SparkSession, rounds: int = 40, penalty: float = 1e-3):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        made = [(p, float(self.families.index(f)), c) for p, f, c in _examples()]
        data = durable(
            _features(
                spark.createDataFrame(made, "paragraph string, label double, held boolean").coalesce(1),
            ).select("features", "label", "held"),
            "examples",
        )
        self.model: LogisticRegressionModel = LogisticRegression(
            maxIter=rounds,
            regParam=penalty,
            family="multinomial",
        ).fit(data.where("not held"))
        self.temperature = self._calibrate(data.where("held"))

    def _calibrate(self, held: DataFrame) -> float:
        """The temperature of least log loss on examples the model was not fitted to."""
        tried = [0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
        raw = self.model.transform(held).select(vector_to_array("rawPrediction").alias("raw"), (F.col("label") + 1).cast("int").alias("at"))
        each = raw.select(
            "at",
            F.explode(F.array(*(F.struct(F.lit(x).alias("t"), self._exp(F.col("raw"), x).alias("e")) for x in tried))).alias("x"),
        )
        share = F.element_at("x.e", F.col("at")) / F.aggregate("x.e", F.lit(0.0), lambda a, b: a + b)
        loss = each.groupBy("x.t").agg(F.avg(-F.log(F.greatest(share, F.lit(1e-12)))).alias("loss")).collect()
        return min((r.loss, r.t) for r in loss)[1]

    @staticmethod
    def _exp(raw: Column, temperature: float) -> Column:
        return F.zip_with(raw, F.array_repeat(F.array_max(raw), F.size(raw)), lambda x, top: F.exp((x - top) / temperature))

    @staticmethod
    def _share(e: Column) -> Column:
        return F.zip_with(e, F.array_repeat(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), F.size(e)), lambda x, total: x / total)

    def predict(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs with words, family and probability; family is unknown unless one is likelier than not."""
        got = self.model.transform(_features(paragraphs)).withColumn("raw", vector_to_array("rawPrediction"))
        got = got.withColumn("e", self._exp(F.col("raw"), self.temperature)).withColumn("p", self._share(F.col("e")))
        best = F.array_max("p")
        family = F.element_at(F.array(*map(F.lit, self.families)), F.array_position("p", best).cast("int"))
        return got.withColumn("probability", best).withColumn("family", F.when(best >= SURE, family).otherwise(F.lit(UNKNOWN))).drop(
            "features",
            "grams",
            "rawPrediction",
            "prediction",
            "raw",
            "e",
            "p",
        )


def template_share(pairs: Column, family: Column) -> Column:
    """The largest share of two-word runs of one of the family's templates that the paragraph's runs, pairs, have."""
    sets = []
    for name, texts in TEMPLATES.items():
        words = [template_words(text) for text in texts]
        sets += [
            F.lit(name),
            F.array(*(F.array(*(F.lit(x) for x in sorted({" ".join(w[k : k + 2]) for k in range(len(w) - 1)}))) for w in words)),
        ]
    of = F.transform(F.element_at(F.create_map(*sets), family), lambda t: F.size(F.array_intersect(pairs, t)) / F.size(t))
    return F.coalesce(F.array_max(of), F.lit(0.0))


def paragraphs(docs: DataFrame, most_lines: int = MOST_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, line, lines, paragraph): runs of up to most_lines lines without a blank one, of which some line has a mark.

    Lines of a run are joined by line feeds; comment signs are no words. row names the row of docs.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    slim = slim.where(has_mark(F.lower("text")))
    flags = F.transform(F.split(F.lower("text"), "\n", -1), lambda x, k: F.when(has_mark(x), k))
    split = slim.select("row", "doc_id", F.split("text", "\n", -1).alias("own"), F.array_compact(flags).alias("marks"))
    held = split.select("row", "doc_id", "own", F.explode("marks").alias("at"))
    # Every run that has this line, and no marked line before it in the run: each run comes from the first marked line in it.
    near = held.select(
        "row",
        "doc_id",
        "at",
        F.slice("own", F.greatest(F.col("at") - (most_lines - 1), F.lit(0)) + 1, 2 * most_lines - 1).alias("own"),
        F.least("at", F.lit(most_lines - 1)).alias("mid"),
    )
    starts = F.sequence(F.lit(0), F.col("mid"))
    runs = F.flatten(
        F.transform(
            starts,
            lambda a: F.transform(
                F.sequence(F.col("mid"), F.least(a + (most_lines - 1), F.size("own") - 1)),
                lambda z: F.struct(a.alias("a"), F.slice("own", a + 1, z - a + 1).alias("x")),
            ),
        ),
    )
    whole = F.filter(runs, lambda r: ~F.exists(r["x"], lambda x: ~x.rlike("[A-Za-z0-9]")))
    out = near.select("row", "doc_id", "at", "mid", F.explode(whole).alias("r"))
    made = out.select(
        "row",
        "doc_id",
        (F.col("at") - F.col("mid") + F.col("r.a")).alias("line"),
        F.size("r.x").alias("lines"),
        F.array_join("r.x", "\n").alias("paragraph"),
        F.slice("r.x", 1, F.col("mid") - F.col("r.a")).alias("before"),
    )
    return made.where(~F.exists("before", lambda x: has_mark(F.lower(x)))).drop("before")


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", most_lines: int = MOST_LINES) -> DataFrame:
    """(doc_id, line, lines, family, probability, template_share, paragraph): a row for each notice.

    A paragraph is a line, or up to most_lines consecutive lines that a notice is wrapped over. It is predicted if a family has a
    calibrated probability of SURE or more (of equal ones the first by name), and confirmed if it holds CONFIRM of a template of
    that family. Of confirmed paragraphs one inside another, the one that holds more of its template is reported, the smaller one if
    both hold as much. Whole texts are scanned.
    Null, empty and unlicensed texts give no row; repeated documents give theirs each.
    """
    # Written, as a filter pushed below the model would have the planner repeat words and n-grams inside each other.
    lines = durable(paragraphs(docs, most_lines, id_col, text_col), "paragraphs")
    predicted = durable(scanner.predict(lines).withColumn("pairs", grams(F.col("words"), 2)), "predicted")
    got = predicted.where(F.col("family") != UNKNOWN)
    got = got.withColumn("template_share", template_share(F.col("pairs"), F.col("family"))).where(F.col("template_share") >= CONFIRM)
    found = F.struct("line", "lines", "family", "probability", "template_share", "paragraph")
    # Notices of one row of docs: a few for each of its lines.
    rows = got.groupBy("row", "doc_id").agg(F.collect_list(found).alias("all"))
    end = lambda x: x["line"] + x["lines"]
    inside = lambda x, y: (y["line"] >= x["line"]) & (end(y) <= end(x)) & (y["lines"] < x["lines"])
    as_good = lambda x, y: inside(x, y) & (y["template_share"] >= x["template_share"])
    better = lambda x, y: inside(y, x) & (y["template_share"] > x["template_share"]) & (y["family"] == x["family"])
    least = F.filter("all", lambda x: ~F.exists("all", lambda y: as_good(x, y) | better(x, y)))
    return rows.select("doc_id", F.explode(least).alias("x")).select("doc_id", "x.*")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"), Scanner(spark))
    return got.select(
        "doc_id",
        "line",
        "lines",
        "family",
        F.round("probability", 6).alias("probability"),
        F.round("template_share", 6).alias("template_share"),
    )
