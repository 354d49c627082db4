"""Hierarchical language identification.

A text's bytes (ASCII lower case, runs of white space as one blank) give counts of
hashed 1- to 3-grams, taken as square roots of unit length. Linear support vector
machines first tell the language families apart, one against one with votes; then
those of the family's own languages decide among these, again one against one. They
learn by stochastic subgradients from a bounded sample of labelled rows: at most
PER_LANGUAGE a language and SAMPLE in all, those of the least hashes of doc_id. Of more
than LANGUAGES labels the commonest are learned; these bounds hold for the driver too.

Edge cases: a null text or one without a letter is `und` with score 0, as is
everything if no labelled row can be learned from; a null doc_id is never learned
from and not held out; one language alone is predicted for every text with a letter;
repeated rows count as often as they occur; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, table

DIMS = 4096
PER_LANGUAGE, SAMPLE, LANGUAGES = 400, 4000, 250
EPOCHS, REGULARISATION = 12, 1e-4
UNKNOWN = "und"
# Families of ISO 639-1 codes; a code not listed is its own family.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "indic": "hi bn mr gu pa ur ne si",
    "iranian": "fa ps ku tg",
    "turkic": "tr az kk ky uz tt tk",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], lang)


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts, from the whole text."""
    data = b" " + b" ".join(text.encode("utf-8", "replace").lower().split()) + b" "
    counts = np.zeros(DIMS, np.int64)
    # Pieces overlap by two bytes, so each n-gram is counted once; memory stays bounded.
    for at in range(0, len(data), 1 << 20):
        b = np.frombuffer(data, np.uint8, min(len(data) - at, (1 << 20) + 2), at).astype(np.uint32)
        n = min(len(b), 1 << 20)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for code, seed in ((b[:n], 1), (two[:n], 2), (three[:n], 3)):
            mixed = (code + np.uint32(seed << 24)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            counts += np.bincount((mixed * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(counts)
    return (out / max(np.sqrt((out * out).sum()), 1e-9)).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear SVM for y in -1, 1: averaged subgradient
    steps on the hinge loss, classes weighted evenly."""
    rng = np.random.default_rng(11)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w, total, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            step += 1
            rate = 1 / (REGULARISATION * (step + 1 / REGULARISATION))
            w *= 1 - rate * REGULARISATION
            if y[i] * (w @ x[i]) < 1:
                w += rate * weight[i] * y[i] * x[i]
            total += w
    return (total / max(step, 1)).astype(np.float32)


class Hierarchy:
    """One-against-one machines of the families and of each family's languages."""

    def __init__(self, langs: list[str], vectors: np.ndarray):
        names = np.array(langs, dtype=object)
        groups = np.array([family(x) for x in langs], dtype=object)
        self.levels = {None: self._pairs(groups, vectors)}
        for g in sorted(set(groups)):
            own = groups == g
            self.levels[g] = self._pairs(names[own], vectors[own])

    @staticmethod
    def _pairs(labels: np.ndarray, vectors: np.ndarray):
        classes = sorted(set(labels))
        machines = []
        for a, b in combinations(range(len(classes)), 2):
            rows = (labels == classes[a]) | (labels == classes[b])
            machines.append((a, b, svm(vectors[rows], np.where(labels[rows] == classes[a], 1, -1))))
        return classes, machines

    @staticmethod
    def _vote(level, vector: np.ndarray) -> tuple[str, float]:
        classes, machines = level
        votes, margin = np.zeros(len(classes)), np.full(len(classes), np.inf)
        for a, b, w in machines:
            m = float(w[:-1] @ vector + w[-1])
            votes[a if m > 0 else b] += 1
            margin[a], margin[b] = min(margin[a], m), min(margin[b], -m)
        best = max(range(len(classes)), key=lambda k: (votes[k], margin[k]))
        return classes[best], 1 / (1 + np.exp(-3 * margin[best]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not has_letter(text):
            return UNKNOWN, 0.0
        vector = features(text)
        group, first = self._vote(self.levels[None], vector)
        lang, second = self._vote(self.levels[group], vector)
        return lang, float(first * second)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Labels and vectors of the rows to learn from."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    usable = docs.filter("train and lang is not null and text rlike '\\\\p{L}'").withColumn("h", h)
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return [], np.zeros((0, DIMS), np.float32)
    each = max(1, min(per_language, most // len(counts)))
    usable = usable.filter(F.col("lang").isin(list(counts)))
    # A hash threshold twice as high as needed leaves few rows to rank.
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2 * each + 50) / n))])
    near = usable.filter(F.col("h") <= F.element_at(share, F.col("lang")))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("r") <= each)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "v": [features(t).tobytes() for t in batch["text"]]})

    rows = ranked.select("lang", "h", "text").mapInPandas(vectors, "lang string, h double, v binary").toPandas().sort_values(["lang", "h"])
    return rows["lang"].tolist(), np.frombuffer(b"".join(rows["v"]), np.float32).reshape(-1, DIMS)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score."""
    fold = F.pmod(F.crc32(column(docs, "doc_id", "bigint").cast("string").cast("binary")), F.lit(3))
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text"), column(docs, "lang", "string").alias("lang"), F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.coalesce(fold != 1, F.lit(False)).alias("train"))
    langs, vectors = sample(rows.filter("text is not null"), per_language)
    model = Hierarchy(langs, vectors) if langs else None

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            found = [model.predict(t) if model else (UNKNOWN, 0.0) for t in part]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    predicted = rows.withColumn("p", F.pandas_udf(run, "lang_pred string, score double")("text"))
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
