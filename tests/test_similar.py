"""The similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from gridloom.operators import names, similar


def texts(rng, n):
    words = ["cola", "orange", "lemon", "water", "500ml", "1l", "and", "zero", "light", "family", "pack", "mango", "tea", "x", "tp", "usp"]
    out = set()
    while len(out) < n:
        s = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            i = rng.randrange(len(s) or 1)
            s = s[:i] + rng.choice(["", "q", "e", " "]) + s[i + 1 :]
        s = " ".join(s.split())
        if s:
            out.add(s)
    return sorted(out) + ["a", "ab", "zq", "trade price", "consumer price", "concatenate", "cat"]


def test_bound_is_never_below_the_similarity():
    rng = random.Random(1)
    xs, ys = texts(rng, 150), texts(rng, 150)
    for x in xs:
        for y in ys:
            known = any(x in l | r and y in l | r for l, r in names.SYNONYMS)
            assert known or similar.bound(x, y) >= names.similarity(x, y) - 1e-9, (x, y)


@pytest.mark.parametrize("u", [0.95, 0.87, 0.85, 0.77])
def test_character_filter_keeps_every_close_pair(u):
    rng = random.Random(2)
    xs = [*texts(rng, 250), *("".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(80))]
    often = {x[i : i + k]: rng.randint(0, 9) for x in xs for k in (2, 3) for i in range(len(x) - k + 1)}
    keys = [similar.character_keys(x, u, often) for x in xs]
    for x, p in zip(xs, keys):
        for y, q in zip(xs, keys):
            if SequenceMatcher(None, x, y).ratio() >= u:
                assert p & q, (x, y)


@pytest.mark.parametrize("seed", [3, 4])
def test_best_is_that_of_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(similar, "TILE", 60)
    rng = random.Random(seed)
    xs, ys = texts(rng, 160), texts(rng, 200)
    rng.shuffle(ys)
    values = spark.createDataFrame([(x,) for x in [*xs, xs[0], ""]], "x string")
    standards = spark.createDataFrame([(y, i) for i, y in enumerate([*ys, ys[3], ""])], "x string, first long")
    got = {r["x"]: (r["y"], r["score"]) for r in similar.best(values, standards).collect()}
    want = {x: max(((y, names.similarity(x, y)) for y in ys), key=lambda p: p[1]) for x in xs}
    assert got == want


def test_few_pairs_meet(spark):
    """10,000 labels of four words, each with one letter changed, against the 10,000."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randint(4, 9)))
    vocabulary = [word() for _ in range(4000)]
    ys = [" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(10_000)]
    xs = [y[: (i := rng.randrange(len(y)))] + "q" + y[i + 1 :] for y in ys]
    side = lambda ts: spark.createDataFrame([(t, i) for i, t in enumerate(ts)], "x string, first long").withColumn("id", F.xxhash64("x"))
    n = similar.candidates(side(xs).select("id", "x"), side(ys).select("id", "x"), similar.LEVELS[0]).count()
    assert n < 0.01 * len(xs) * len(ys)
    got = {r["x"]: r["y"] for r in similar.best(side(xs).select("x"), side(ys).select("x", "first")).collect()}
    assert sum(got[x] == y for x, y in zip(xs, ys)) >= 9_990
