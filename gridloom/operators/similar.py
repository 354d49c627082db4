"""The most similar standard of each label, by joins in place of all pairs.

similarity() is the largest of a character ratio, shared words and containment, plus a bonus
of FIRST_WORD for equal first words, PREFIX more where one text begins with the other, and
one for known synonyms. A pair that scores t or more therefore contains one text in the other,
is a pair of synonyms, or reaches t, or u = t - FIRST_WORD with equal first words, by words
or by characters:

- words: a Jaccard index of (u - BASE) / (1 - BASE) at least, found by a prefix filter;
- characters: the ratio is 2M / S for M matched of S characters in both texts, so at most
  D = (1 - t) S are not matched. Between two blocks that are matched in a row is one of
  these at least, so there are no more than D + 1 blocks, and the texts share at least
  M - (q - 1) (D + 1) grams of q characters. With the lengths that a partner may have this
  is again a prefix filter, over rare grams first. Where the bound is below one (short
  texts) shorter grams are asked for, in the end one common character. Pairs that need
  the first word's bonus meet by their grams and that word.
- containment: the text's rarest gram of three characters (all of a shorter text) occurs in
  the other.

Labels go through LEVELS of t. One that has found a score of t is done: every pair that could
be better was among its candidates. Only those that resemble nothing are compared with all
standards, in tiles, by character counts first. The result is that of all pairs.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialise
from .names import CONTAINED, FIRST_WORD_BONUS, SYNONYMS, TOKEN_BASE, norm, similarity

LEVELS = (0.95, 0.85)
#: Labels of one side of a tile, for those that resemble nothing.
TILE = 2000
#: Characters of a text that the length of grams is chosen for.
TYPICAL = 12
#: Room for rounding in the bounds.
EPS = 1e-9


def needed(n: int, u: float, q: int) -> int:
    """How many grams of q characters a text of n shares at least with one that reaches the
    ratio u; 0 or less if none is certain."""
    if u / 2 <= (q - 1) * (1 - u):
        return 0
    size = n + math.ceil(n * u / (2 - u) - EPS)
    return math.ceil(u * size / 2 - (q - 1) * ((1 - u) * size + 1) - EPS)


def longest_partner(u: float, q: int) -> int:
    """The longest text that may reach u with one that shares no gram of q for certain."""
    n = 0
    while needed(n + 1, u, q) < 1:
        n += 1
        if n > 10_000:
            return n
    return math.floor(n * (2 - u) / u + EPS)


@functools.cache
def plan(u: float) -> tuple[tuple[int, int], ...]:
    """(q, longest text that needs it): the longest grams that texts of TYPICAL characters
    are certain to share, then shorter ones for the texts that are too short for these."""
    first = next((q for q in (4, 3, 2) if needed(TYPICAL, u, q) >= 1), 1)
    out = [(first, 1 << 30)]
    for q in (2, 1):
        if q < first and (longest := longest_partner(u, out[-1][0])) > 0:
            out.append((q, longest))
    return tuple(out)


def grams(x: str, size: int) -> list[str]:
    """Grams with the number of their occurrence, so that equal ones count as often as they are."""
    seen: Counter = Counter()
    out = []
    for i in range(len(x) - size + 1):
        g = x[i : i + size]
        out.append(f"{g}{seen[g]}")
        seen[g] += 1
    return out


def character_keys(x: str, u: float, often: dict[str, int]) -> set[str]:
    """The rarest grams of a text, as many as meet those of every partner that reaches u."""
    out: set[str] = set()
    for q, longest in plan(u):
        if len(x) <= longest and (least := needed(len(x), u, q) if q > 1 else 1) >= 1:
            own = sorted(grams(x, q), key=lambda g: (often.get(g[: min(q, 3)], 0), g))
            out |= {f"{q}{g}" for g in (own[: len(own) - least + 1] if q > 1 else own)}
    return out


def _keys(t: float, often: dict[str, int], standard: bool):
    """Keys under which a label meets its candidates; by kind of filter."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            first = x.split()[0]
            keys = {f"c{g}" for g in character_keys(x, t, often)} | {f"f{g}|{first}" for g in character_keys(x, t - FIRST_WORD_BONUS, often)}
            # Either side may be the one that is contained: one asks by its rarest gram, the
            # other answers with all of its grams.
            whole = {x[i : i + k] for k in (1, 2, 3) for i in range(len(x) - k + 1)}
            ask = min((x[i : i + 3] for i in range(len(x) - 2)), key=lambda g: (often.get(g, 0), g), default=x)
            out.append(sorted(keys | {f"{'b' if standard else 'a'}{g}" for g in whole} | {f"{'a' if standard else 'b'}{ask}"}))
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")


def gram_counts(standards: DataFrame) -> dict[str, int]:
    """In how many standards each gram of two and three characters occurs; the alphabet of
    37 bounds them to 52,022. A longer gram goes by its first three."""

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: sorted({x[i : i + k] for k in (2, 3) for i in range(len(x) - k + 1)}))

    return dict(standards.select(F.explode(held("x")).alias("g")).groupBy("g").count().collect())


def _word_keys(df: DataFrame, common: DataFrame, u: float) -> DataFrame:
    """(id, key): the rarest words of each label, as many as the Jaccard index asks for."""
    least = (u - TOKEN_BASE) / (1 - TOKEN_BASE)
    words = df.select("id", F.explode(F.array_distinct(F.split("x", " "))).alias("w")).join(common, "w", "left")
    by = Window.partitionBy("id")
    ranked = words.withColumn("r", F.row_number().over(by.orderBy(F.coalesce("n", F.lit(0)), "w"))).withColumn("size", F.count("*").over(by))
    return ranked.filter(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least - EPS) + 1).select("id", F.concat(F.lit("w"), "w").alias("key"))


def _shape(x: str) -> np.ndarray:
    return np.bincount([26 + int(c) if c.isdigit() else 36 if c == " " else ord(c) - 97 for c in x], minlength=37)


def bound(x: str, y: str) -> float:
    """No less than the similarity of two texts that are no synonyms."""
    p, q = set(x.split()), set(y.split())
    ratio = 2 * (Counter(x) & Counter(y)).total() / max(len(x) + len(y), 1)
    shared = TOKEN_BASE + (1 - TOKEN_BASE) * len(p & q) / len(p | q) if p & q else 0.0
    inside = x in y or y in x
    first = FIRST_WORD_BONUS if x.split()[:1] == y.split()[:1] else 0.0
    return 1.0 if inside and first else max(ratio, shared, CONTAINED if inside else 0.0) + first


def _scores(u: float):
    def run(x: pd.Series, y: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([similarity(a, b) if k or bound(a, b) >= u - EPS else -1.0 for a, b, k in zip(x, y, known)], dtype="float64")

    return F.pandas_udf(run, "double")


def _synonyms(spark: SparkSession) -> DataFrame:
    pairs = {(a, b) for left, right in SYNONYMS for p in left for q in right for a, b in ((norm(p), norm(q)), (norm(q), norm(p)))}
    return spark.createDataFrame(sorted(pairs), "x string, y string")


def candidates(values: DataFrame, standards: DataFrame, t: float) -> DataFrame:
    """(x, y, known): every pair of the texts (id, x) that may score t; known synonyms among
    them marked."""
    spark, u = values.sparkSession, t - FIRST_WORD_BONUS
    often = gram_counts(standards)
    common = standards.select(F.explode(F.array_distinct(F.split("x", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    side = lambda df, standard: df.select("id", F.explode(_keys(t, often, standard)("x")).alias("key")).unionByName(_word_keys(df, common, u))
    meet = side(values, False).join(side(standards, True).withColumnRenamed("id", "to"), "key").select("id", "to").distinct()
    texts = meet.join(values, "id").join(standards.select(F.col("id").alias("to"), F.col("x").alias("y")), "to").select("x", "y")
    listed = _synonyms(spark)
    known = listed.join(values.select("x"), "x", "left_semi").join(standards.select(F.col("x").alias("y")), "y", "left_semi").select("x", "y", F.lit(True).alias("known"))
    return texts.join(known.drop("known"), ["x", "y"], "left_anti").withColumn("known", F.lit(False)).unionByName(known)


def _best_of_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """The best standard of a tile for each label: in the order of their bounds, until the
    best is above all that are left."""
    xs, side = rows["x"][rows["side"] == 0].tolist(), rows[rows["side"] == 1].sort_values("first")
    ys, firsts = side["x"].tolist(), side["first"].to_numpy()
    shapes, sizes = np.stack([_shape(y) for y in ys]) if ys else np.zeros((0, 37)), np.array([len(y) for y in ys])
    words: dict[str, list[int]] = {}
    for i, y in enumerate(ys):
        for w in set(y.split()):
            words.setdefault(w, []).append(i)
    out = []
    for x in xs:
        best, at = -1.0, -1
        top = 2 * np.minimum(shapes, _shape(x)).sum(axis=1) / np.maximum(sizes + len(x), 1)
        # Words in common, containment and synonyms may add to the ratio.
        top[[i for w in set(x.split()) for i in words.get(w, ())]] = 2.0
        top[[i for i, y in enumerate(ys) if x in y or y in x]] = 2.0
        top[[i for i, y in enumerate(ys) if any(x in l | r and y in l | r for l, r in SYNONYMS)]] = 2.0
        for i in np.argsort(-top, kind="stable").tolist():
            if top[i] < best - EPS:
                break
            score = similarity(x, ys[i])
            if score > best or (score == best and firsts[i] < firsts[at]):
                best, at = score, i
        if at >= 0:
            out.append((x, ys[at], int(firsts[at]), best))
    return pd.DataFrame(out, columns=["x", "y", "first", "score"])


def _tiles(values: DataFrame, standards: DataFrame) -> DataFrame:
    n, m = max(1, -(-values.count() // TILE)), max(1, -(-standards.count() // TILE))
    across = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    part = lambda k: F.pmod(F.xxhash64("x"), F.lit(k)).cast("int")
    left = values.select("x", F.lit(None).cast("bigint").alias("first"), F.lit(0).alias("side")).withColumn("i", part(n)).withColumn("j", across(m))
    right = standards.select("x", "first", F.lit(1).alias("side")).withColumn("j", part(m)).withColumn("i", across(n))
    return left.unionByName(right).groupBy("i", "j").applyInPandas(_best_of_tile, "x string, y string, first bigint, score double")


def best(values: DataFrame, standards: DataFrame) -> DataFrame:
    """(x, y, score) for the distinct texts x of values: the most similar y of standards
    (x, first), of equal ones the smallest first. Texts are as norm() makes them; those
    without characters have no partner."""
    rest = materialise(values.filter("x <> ''").select("x").distinct().withColumn("id", F.xxhash64("x")), "similar-values")
    held = materialise(standards.filter("x <> ''").groupBy("x").agg(F.min("first").alias("first")).withColumn("id", F.xxhash64("x")), "similar-standards")
    done = []
    for t in LEVELS:
        if rest.isEmpty():
            break
        scored = candidates(rest.select("id", "x"), held.select("id", "x"), t).withColumn("score", _scores(t)("x", "y", "known")).filter(F.col("score") >= t)
        placed = scored.join(held.select(F.col("x").alias("y"), "first"), "y")
        top = placed.groupBy("x").agg(F.max_by(F.struct("y", "score"), F.struct("score", -F.col("first"))).alias("b"))
        found = materialise(top.select("x", "b.*"), "similar-found")
        left = materialise(rest.join(found.select("x"), "x", "left_anti"), "similar-values")
        discard(rest)
        rest = left
        done.append(found)
    if not rest.isEmpty():
        tiles = _tiles(rest.select("x"), held)
        top = tiles.groupBy("x").agg(F.max_by(F.struct("y", "score"), F.struct("score", -F.col("first"))).alias("b"))
        done.append(top.select("x", "b.*"))
    if not done:
        return values.sparkSession.createDataFrame([], "x string, y string, score double")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
