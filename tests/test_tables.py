"""Tables with a commit log, and text that is read in splits."""

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from gridloom.sources import commits, delimited, sinks, tables
from gridloom.streaming import changes, watcher

ROWS = "k long, area string, v int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_partitions_keep_their_type(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "007", 1), (2, None, 2), (3, "0", 3), (None, "007", 4)], ROWS)
    for _ in range(3):
        sinks.upsert_partitions(df, path, ["area", "k"], "area")
        assert rows(sinks.read_table(spark, path)) == rows(df)
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (None, 2)], "day date, v int")
    for _ in range(2):
        sinks.upsert_partitions(days, str(tmp_path / "d"), ["day"], "day")
    assert rows(sinks.read_table(spark, str(tmp_path / "d"))) == rows(days)


def test_two_writers_keep_both_sets(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *ks: spark.createDataFrame([(k, "a", v) for k, v in ks], ROWS)
    sinks.upsert(row((1, 1)), path, ["k"])
    one = commits.plan_upsert(row((2, 2)), path, ["k"])
    two = commits.plan_upsert(row((1, 9), (3, 3)), path, ["k"])
    commits.commit(spark, path, one)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, two)
    # On the newer version the same rows are replaced, so the files that are there serve.
    again = commits.plan_upsert(row((1, 9), (3, 3)), path, ["k"], before=two)
    assert again.add == two.add and again.base == 2
    commits.commit(spark, path, again)
    assert rows(sinks.read_table(spark, path).select("k", "v")) == [(1, 9), (2, 2), (3, 3)]
    assert rows(sinks.read_table(spark, path, 1).select("k", "v")) == [(1, 1)]


def test_a_conflict_is_planned_again(spark, tmp_path, monkeypatch):
    path, real, calls = str(tmp_path / "t"), commits.commit, []
    row = lambda k, v: spark.createDataFrame([(k, "a", v)], ROWS)

    def commit(s, p, change):
        calls.append(change.base)
        if len(calls) == 1:  # another writer comes first, with one of our keys
            real(s, p, commits.plan_upsert(row(1, 5), p, ["k"]))
        return real(s, p, change)

    monkeypatch.setattr(commits, "commit", commit)
    got = sinks.upsert(row(1, 7), path, ["k"])
    assert calls == [0, 1] and got["version"] == 2 and rows(sinks.read_table(spark, path).select("k", "v")) == [(1, 7)]


def test_a_writer_that_stops_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 1)], ROWS)
    sinks.upsert(first, path, ["k"])
    commits.plan_upsert(spark.createDataFrame([(1, "a", 2), (5, "a", 2)], ROWS), path, ["k"])  # files, no commit
    (tmp_path / "t" / "_log" / ".half").write_text("{")
    assert rows(sinks.read_table(spark, path)) == rows(first) and sinks.current_version(spark, path) == 1
    assert commits.vacuum(spark, path) == 0  # it may still be at work
    assert commits.vacuum(spark, path, older_than=-60) == 1 and rows(sinks.read_table(spark, path)) == rows(first)


def test_only_files_with_an_incoming_key_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.upsert(spark.range(4000).select(F.col("id").alias("k"), F.lit("a").alias("area"), F.lit(1).alias("v")), path, ["k", "area"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    before = commits.snapshot(spark, path)
    assert len(before.files) == 4
    got = sinks.upsert(spark.createDataFrame([(10, "a", 2), (9_999_999, "a", 2)], ROWS), path, ["k", "area"])
    after = commits.snapshot(spark, path)
    assert got["files_removed"] == 1 and 0 < got["rows_rewritten"] < 2000 and len(set(before.files) & set(after.files)) == 3
    table = sinks.read_table(spark, path)
    assert table.count() == 4001 and table.filter("v = 2").count() == 2


def test_log_and_types(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FULL_EVERY", 3)
    path = str(tmp_path / "t")
    for i in range(7):
        sinks.upsert(spark.createDataFrame([(i, i)], "k int, v int"), path, ["k"])
    sinks.upsert(spark.createDataFrame([(2, 2.5, "new")], "k long, v double, w string"), path, ["k"])
    table = sinks.read_table(spark, path)
    assert dict(table.dtypes) == {"k": "bigint", "v": "double", "w": "string"}
    assert rows(table) == rows(spark.createDataFrame([(i, float(i) if i != 2 else 2.5, "new" if i == 2 else None) for i in range(7)], "k long, v double, w string"))
    assert [c for c in range(1, 9) if commits._read(spark, f"{path}/_log/{c:010d}.json")["files"] is not None] == [1, 3, 6]
    with pytest.raises(ValueError, match="column k"):
        sinks.upsert(spark.createDataFrame([("x",)], "k string"), path, ["k"])
    sinks.write_version(spark.createDataFrame([(1,)], "z int"), path)
    assert rows(sinks.read_table(spark, path)) == [(1,)] and sinks.read_table(spark, str(tmp_path / "none")) is None
    sinks.upsert(spark.createDataFrame([], "z int"), path, ["z"])
    assert rows(sinks.read_table(spark, path)) == [(1,)]


def expected(text, sep):
    return [[c.replace("\r\n", "\n") for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]


def parsed(spark, path, sep, encoding="utf-8"):
    got = delimited.parse(spark, str(path), sep, encoding)
    return [r["cells"] for r in got.filter("problem is null").orderBy("file", "start", "n").collect()], got


@pytest.mark.parametrize("seed", range(4))
def test_records_in_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    piece = lambda: rng.choice(['a', '5" pipe', '"x"', "line\nbreak", "b;c", "é水", "", '"', "\n\n", ';"', 'say ""hi""', "long " * rng.randint(0, 30)])
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator=rng.choice(["\n", "\r\n"]))
    for i in range(300):
        w.writerow([i, *("".join(piece() for _ in range(rng.randint(0, 3))) for _ in range(3))])
        if rng.random() < 0.1:
            out.write(f'{i};5" pipe;un"quoted;"closed" tail\n')  # quotes that open nothing
    (tmp_path / "a.csv").write_bytes(out.getvalue().encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got, df = parsed(spark, tmp_path / "a.csv", ";")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(out.getvalue(), ";")
    # One file, read by many tasks.
    assert df.select("start").distinct().count() > 10


def test_whole_splits_within_a_cell(spark, tmp_path):
    text = 'a,b\n1,"' + "x\n" * 3000 + '"\n2,y\n3,"open\nto the end\n'
    (tmp_path / "a.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got, df = parsed(spark, tmp_path / "a.csv", ",")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [["a", "b"], ["1", "x\n" * 3000], ["2", "y"]]
    bad = df.filter("problem is not null").collect()
    assert [(r["problem"], r["raw"]) for r in bad] == [("a quote that is not closed", '3,"open\nto the end')]


def test_problems_stay_beside_the_table(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,x,\n2,y,z\n3\n4,\xff\n")
    good, bad = tables.parse_text(spark, str(tmp_path / "a.csv"))
    assert rows(good) == rows(spark.createDataFrame([(1, "x"), (3, None)], "a long, b string"))
    assert {(r["problem"], r["raw"]) for r in bad.collect()} == {("more cells than the header", "2,y,z"), ("bytes that are not utf-8", "4,\\xff")}
    with pytest.raises(ValueError, match="more cells"):
        tables.read_text(spark, str(tmp_path / "a.csv"))


@pytest.mark.parametrize("encoding, mark", [("utf-8", "﻿"), ("utf-16-le", "﻿"), ("utf-16-be", "﻿"), ("latin-1", "")])
def test_encodings(spark, tmp_path, encoding, mark):
    (tmp_path / "a.csv").write_bytes((mark + 'Größe,n\nübergroß,1\n"zwei\nZeilen",2\n').encode(encoding))
    df = tables.read_text(spark, str(tmp_path / "a.csv"), encoding=None if mark else encoding)
    assert df.columns == ["Größe", "n"] and rows(df) == [("zwei\nZeilen", 2), ("übergroß", 1)]


def test_header_repeats_count_each_without_case():
    # Two repeats cost 1.6: the row below, later by one, has none and wins.
    assert tables.header_row([["Name", "name", "NAME"], ["a", "b", "c"], ["x", "y", "z"]]) == 1


def test_changes_come_once_each(spark, tmp_path):
    folder, seen = tmp_path / "in", []

    def look():
        q = watcher.follow(spark, str(folder), lambda e: seen.append((e["name"], e["size"])) or {}, str(tmp_path / "cp"), "*.csv", ("master.csv",), stable_seconds=0)
        assert q.awaitTermination(120) is True
        done = list(seen)
        seen.clear()
        return done

    assert look() == []
    folder.mkdir()
    for name in ("a.csv", "b.csv", "master.csv", "c.txt", "_d.csv"):
        (folder / name).write_text("x")
    assert sorted(look()) == [("a.csv", 1), ("b.csv", 1)]  # all that landed together
    assert look() == []  # each look is a restart from the checkpoint
    (folder / "a.csv").write_text("xyz")
    (folder / "e.csv").write_text("")
    assert sorted(look()) == [("a.csv", 3), ("e.csv", 0)] and look() == []

    def fails(event):
        raise ZeroDivisionError

    (folder / "a.csv").write_text("four")
    q = watcher.follow(spark, str(folder), fails, str(tmp_path / "cp"), "*.csv", ("master.csv",), stable_seconds=0)
    with pytest.raises(Exception):
        q.awaitTermination(120)
    assert look() == [("a.csv", 4)] and look() == []


def test_change_log_is_compacted(tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "FULL_EVERY", 4)
    reader = changes.ChangeReader({"folder": str(tmp_path / "in"), "log": str(tmp_path / "log"), "stable_seconds": "0"})
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}").write_text("x" * i)
        assert reader.latestOffset() == {"entry": i + 1} == reader.latestOffset()
    assert [reader.log.read(n)["known"] is not None for n in range(1, 7)] == [False, False, False, True, False, False]
    rows = [r for p in reader.partitions({"entry": 2}, {"entry": 6}) for r in reader.read(p)]
    assert [r[1] for r in rows] == ["2", "3", "4", "5"]
    assert changes.listing(str(tmp_path / "in"), "*", set(), 1e6, 1e9) == []
