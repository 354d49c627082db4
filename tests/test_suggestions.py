"""Medians of hot groups, profiles, value maps and dimensions."""

import random
import statistics

import pytest

from gridloom.operators import dedupe, labels, quality, selection


def test_medians_by_selection(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = random.Random(1)
    groups = {0: [rng.gauss(0, 1) for _ in range(700)], 1: [1e300 * rng.random() ** 40 for _ in range(301)], 2: [3.0] * 50 + [4.0] * 50, 3: [float(rng.randint(0, 6)) for _ in range(400)], 4: [-1.7e308, 1.7e308], 5: [2.0]}
    cells = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g int, x double").repartition(5)
    got = {r["g"]: r["median"] for r in selection.medians(cells, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs)
        assert got[g] == pytest.approx(xs[(len(xs) - 1) // 2] / 2 + xs[len(xs) // 2] / 2, rel=1e-15), g


def test_dedupe_takes_medians_of_hot_groups_by_selection(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", None, f"k{i}"]), rng.choice([None, rng.random()]), rng.randint(0, 9), f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "__row_id long, k string, v double, w int, t string").repartition(4)
    plain = {tuple(r) for r in dedupe.dedupe(df, ["k"], "median").collect()}
    monkeypatch.setattr(dedupe, "HOT", 50)
    monkeypatch.setattr(selection, "FEW", 20)
    out = dedupe.dedupe(df, ["k"], "median")
    got = {tuple(r) for r in out.collect()}
    key = lambda rows: {r[1]: (r[0], r[4], pytest.approx(r[2]) if r[2] is not None else None, r[3]) for r in rows}
    assert out.columns == df.columns and key(got) == key(plain)
    hot = [r[2] for r in rows if r[1] == "hot" and r[2] is not None]
    assert key(got)["hot"][2] == statistics.median(hot)


def test_unique_rule_deals_a_frequent_value_over_salts(spark):
    df = spark.createDataFrame([(i, "same" if i % 2 else None if i % 4 else f"v{i}") for i in range(40)], "__row_id long, c string")
    out = quality.prepare(df, [{"column": "c", "type": "unique"}])
    assert {(r["c"], r["__twice_c"]) for r in out.collect()} == {("same", True), (None, False)} | {(f"v{i}", False) for i in range(0, 40, 4)} and out.count() == 40


def test_profile_in_one_pass(spark):
    df = spark.createDataFrame([(3, "a", None, 1.5), (1, "b", None, None), (2, "a", None, 2.5), (0, None, None, 1.5)], "__row_id long, t string, e string, n double")
    out = labels.profile(df)
    assert "Expand" not in out._jdf.queryExecution().toString() and "Expand" not in labels.key_pairs(df)._jdf.queryExecution().toString()
    assert {r["column"]: tuple(r)[1:] for r in out.collect()} == {"t": ("text", 3, 1, 2, ["b", "a", "a"]), "e": ("text", 0, 4, 0, []), "n": ("number", 3, 1, 2, ["1.5", "2.5", "1.5"])}
    assert [tuple(r) for r in labels.head(df, 2).collect()] == [(None, None, 1.5), ("b", None, None)]


def test_dimensions_that_say_the_same_are_left_out(spark):
    cities, skus = [f"city{i}" for i in range(6)], [f"sku{i}" for i in range(5)]
    rows = [(i, c, c.upper(), s, f"p{i}", f"r{i % 2}") for i, (c, s) in enumerate((c, s) for c in cities for s in skus)]
    master = spark.createDataFrame(rows, "__row_id long, CITY string, REGION string, `SKU STANDARD NAME` string, PRODUCT string, colour string")
    new = spark.createDataFrame([(i, r[1], r[3], r[5]) for i, r in enumerate(rows)], "__row_id long, town string, item string, colour string")
    hist = spark.createDataFrame([(i, r[3], r[1]) for i, r in enumerate(rows)], "__row_id long, s string, c string")
    # REGION repeats CITY, PRODUCT has no labels in new, colour is no preferred name.
    assert labels.suggest_dims(master, new, hist) == [{"master": "CITY", "new": "town", "hist": "c"}, {"master": "SKU STANDARD NAME", "new": "item", "hist": "s"}]
    assert labels.equal_shares(master, ["CITY", "REGION", "PRODUCT"]) == {("CITY", "REGION"): 1.0, ("CITY", "PRODUCT"): 0.0, ("REGION", "PRODUCT"): 0.0}


def test_value_maps_need_a_gain(spark):
    new = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate([("b1", "x"), ("B2 ", "y"), ("b3", "x"), ("known", "y")])], "__row_id long, brand string, other string")
    master = spark.createDataFrame([(i, v) for i, v in enumerate(["Alpha", "Beta", "Known", "Gamma"])], "__row_id long, brand string")
    sheet = lambda pairs: spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "__row_id long, code string, name string")
    full = sheet([("B1", "alpha"), ("b2", "Beta"), ("b3", "gamma"), ("b9", "Zeta")])
    part = sheet([("b1", "Alpha"), ("b2", "Nothing"), ("b3", "None"), ("b4", "No")])
    got = labels.suggest_value_maps(new, master, {"part": part, "full": full}).collect()
    assert [tuple(r) for r in got] == [("brand", "brand", "full", "code", "name", 3, 0.25, 1.0, 0.75)]
    assert labels.suggest_value_maps(new, master, {"part": part}).count() == 0 and labels.suggest_value_maps(new, master, {}).count() == 0
