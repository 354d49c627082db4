import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridloom import scratch
from gridloom.operators import dedupe, donors, grid, labels, quality, similar
from gridloom.plans import batch
from gridloom.plans.pipeline import Inputs, build_output, dump_config, fill_presets, final_types, load_config, order_like, rename_output
from gridloom.sources import commits, sinks, tables
from gridloom.streaming import watcher

CITIES, SKUS = ["SPR", "RVT", "LKS", "HLC"], [f"SKU {i}" for i in range(6)]
DAYS = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
CONFIG = {
    "grid": {"master_dims": [{"master": "CITY", "new": "CITY", "hist": "CITY"}, {"master": "SKU", "new": "SKU", "hist": "SKU"}], "new_date_column": "Date"},
    "output_columns": [{"name": "ID", "source": {"type": "new", "column": "ID"}}, {"name": "CITY", "source": {"type": "new", "column": "CITY"}}, {"name": "SKU", "source": {"type": "new", "column": "SKU"}}, {"name": "Date", "source": {"type": "new", "column": "Date"}}, {"name": "PRICE", "source": {"type": "new", "column": "PRICE"}}],
    "gapfill": {"hist_date_column": "Date", "id_policy": {"column": "ID", "mode": "sequence"}},
    "validations": [{"column": "PRICE", "type": "positive", "blocking": True}, {"column": "PRICE", "type": "max", "value": 1000}, {"column": "GONE", "type": "min", "value": 1}],
}


@pytest.fixture(scope="module")
def frames(spark):
    master = spark.createDataFrame([(c, s, "ACME") for c in CITIES for s in SKUS], "CITY string, SKU string, COMPANY string")
    missing = {(c, "SKU 5") for c in CITIES} | {("HLC", "SKU 4")}
    rows = [(c.lower() + " ", s, d, 100.0) for d in DAYS for c in CITIES for s in SKUS if (c, s) not in missing]
    new = spark.createDataFrame([(1001 + i, *r) for i, r in enumerate(rows)], "ID long, CITY string, SKU string, Date date, PRICE double")
    hist = spark.createDataFrame([(i, c, s, dt.date(2023, 12, 31), 90.0) for i, (c, s) in enumerate((c, s) for c in CITIES for s in SKUS)], "ID long, CITY string, SKU string, Date date, PRICE double")
    return Inputs(*[f.coalesce(1) for f in (new, master, hist)])


def test_golden_counts(frames):
    result = build_output(frames, CONFIG)
    rows = result.output.collect()
    assert len(rows) == 48 and sum(r["SOURCE"] == "ACTUAL" for r in rows) == 38 and sum(r["SOURCE"] == "FILLED" for r in rows) == 10
    assert result.excluded.count() == 0 and {r["FILL BASIS"] for r in rows} == {None, "CITY + SKU"}
    assert sorted(r["ID"] for r in rows if r["SOURCE"] == "FILLED") == list(range(1039, 1049))
    assert all(r["PRICE"] == 90 and r["CITY"].isupper() for r in rows if r["SOURCE"] == "FILLED")
    assert [why for _, why in result.unevaluable] == ["missing_column"]
    clean, bad = result.gate()
    assert clean.count() == 48 and bad.count() == 0 and result.issues().count() == 0


def test_cycle_is_named(frames):
    cfg = CONFIG | {"output_columns": [{"name": "A", "source": {"type": "formula", "expr": "[out.B]"}}, {"name": "B", "source": {"type": "formula", "expr": "[out.A]"}}]}
    with pytest.raises(ValueError, match="A -> B -> A"):
        build_output(frames, cfg)


def test_config_transforms():
    assert load_config(dump_config(CONFIG)) == CONFIG
    renamed = rename_output({"output_columns": [{"name": "A", "source": {"type": "formula", "expr": "[out.B] + 1"}}, {"name": "B"}], "validations": [{"column": "B", "type": "min"}]}, "B", "C")
    assert renamed["output_columns"][0]["source"]["expr"] == "[out.C] + 1" and renamed["validations"][0]["column"] == "C"


def test_dedupe_skips_nulls(spark):
    df = spark.createDataFrame([(0, "a", None, 1.0), (1, "a", "x", None), (2, None, "y", None), (3, None, "z", None)], "__row_id long, k string, s string, v double")
    got = {r["k"]: (r["s"], r["v"]) for r in dedupe.dedupe(df, ["k"], "sum", {"s": "first"}).collect()}
    assert got == {"a": ("x", 1.0), None: ("y", 0.0)}


def test_nearest_tie_is_the_earlier_donor(spark):
    pool = spark.createDataFrame([(0, "a", dt.date(2024, 1, 1), 1), (1, "a", dt.date(2024, 1, 1), 2), (2, "a", dt.date(2024, 1, 5), 3)], "__row_id long, k string, __date date, v int")
    gaps = spark.createDataFrame([(0, "A", dt.date(2024, 1, 3)), (1, "A", dt.date(2024, 1, 4)), (2, "A", dt.date(2023, 1, 1))], "__grid_id long, __k0 string, __date date")
    chain = [[{"grid": "k", "hist": "k"}]]
    near = {r["__grid_id"]: r["donor"]["v"] for r in donors.pick(gaps, pool, chain, "hist", ["v"], "nearest", ["k"]).collect()}
    back = {r["__grid_id"]: r["donor"]["v"] for r in donors.pick(gaps, pool, chain, "hist", ["v"], "previous", ["k"]).collect()}
    assert near == {0: 2, 1: 3, 2: 2} and back == {0: 2, 1: 2, 2: 3}


def test_three_levels_and_a_linear_plan(spark):
    day = lambda n: dt.date(2024, 1, n)
    pool = spark.createDataFrame([(0, "a", "x", "1", day(1), 1), (1, "b", "x", "1", day(2), 2), (2, "b", "y", "1", day(4), 3), (3, "c", "y", "2", None, 4)], "__row_id long, p string, q string, r string, __date date, v int")
    gaps = spark.createDataFrame([(0, "A", "X", "1", day(3)), (1, "Z", "X", "1", day(3)), (2, "Z", "Z", "1", day(3)), (3, "Z", "Z", "9", day(3)), (4, "C", "Y", "2", day(3)), (5, "A", "X", "1", None)], "__grid_id long, __k0 string, __k1 string, __k2 string, __date date")
    chain = donors.default_chain([{"master": c} for c in "pqr"])
    want = {"previous": [1, 2, 2, None, 4, 1], "nearest": [1, 2, 3, None, 4, 1], "last": [1, 2, 3, None, 4, 1], "first": [1, 1, 1, None, 4, 1]}
    # Level p + q + r, then q + r, then r; at one day's distance on both sides the earlier row wins.
    want["nearest"][2] = 2
    for strategy, values in want.items():
        out = donors.pick(gaps, pool, chain, "hist", ["v"], strategy, list("pqr"))
        got = {r["__grid_id"]: (r["donor"] and r["donor"]["v"], r["donor_level"]) for r in out.collect()}
        assert [got[i][0] for i in range(6)] == values, strategy
        assert [got[i][1] for i in range(5)] == ["p + q + r", "q + r", "r", None, "p + q + r"]
        # Scans grow by level, not with their product.
        plan = [donors.pick(gaps, pool, chain[:n], "hist", ["v"], strategy, list("pqr"))._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for n in (1, 2, 3)]
        assert plan[2] - plan[1] <= plan[1] - plan[0]


def test_random_donors_are_of_the_key_and_stay(spark):
    pool = spark.createDataFrame([(i, f"a{i % 3}", None, i) for i in range(60)], "__row_id long, k string, __date date, v int")
    gaps = spark.createDataFrame([(i, f"A{i % 4}", dt.date(2024, 1, 1)) for i in range(8)], "__grid_id long, __k0 string, __date date")
    draw = lambda df: {r["__grid_id"]: r["donor"] and r["donor"]["v"] for r in donors.pick(gaps, df, [[{"grid": "k", "hist": "k"}]], "hist", ["v"], "random", ["k"]).collect()}
    got = draw(pool)
    assert got == draw(pool.repartition(7)) and all(got[i] is None if i % 4 == 3 else got[i] % 3 == i % 4 for i in range(8))
    # Another row than the first or last of its key for some key.
    assert any(got[i] not in (i, 57 + i) for i in range(3))


def test_later_levels_see_open_gaps_only(spark):
    day = lambda n: dt.date(2024, 1, n)
    pool = spark.createDataFrame([(i, f"a{i}", "x", day(2), i) for i in range(6)] + [(9, "a9", "y", None, 9)], "__row_id long, p string, q string, __date date, v int")
    gaps = spark.createDataFrame([(i, f"A{i}", "X" if i < 9 else "Y", day(1 + i % 3)) for i in range(10)], "__grid_id long, __k0 string, __k1 string, __date date")
    search = donors.Search(pool, donors.default_chain([{"master": c} for c in "pq"]), "hist", ["v"], "nearest", list("pq"), "donor")
    out = {r["__grid_id"]: (r["donor"]["v"], r["donor_level"]) for r in search.settle(search.dated(search.static(gaps), gaps)).collect()}
    # Six gaps have a donor of their keys by date, one has it without a date.
    assert [df.count() for df in search.opened] == [10, 6, 3, 3]
    assert out == {i: (i, "p + q") for i in range(6)} | {i: (5, "q") for i in (6, 7, 8)} | {9: (9, "p + q")}


def test_rows_are_numbered_without_one_task(spark):
    df = spark.createDataFrame([(v,) for v in (7, 5 << 33, 3, 1 << 20, -4, (5 << 33) + 9)], "n long")
    assert {r["n"]: r["ix"] for r in grid.ordinals(df, "n", "ix", 8).collect()} == {v: i for i, v in enumerate(sorted((7, 5 << 33, 3, 1 << 20, -4, (5 << 33) + 9)))}


def test_suggest_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 3)
    typos = ["BRANGE", "KOLA", "0RANGE", "LMON", "WTAER", "Pehsawar", "GreaterLahore", "Cola & Lime", "zzz", "!!", "Consumer price"]
    names = ["ORANGE", "COLA", "LEMON", "WATER", "Peshawar", "Lahore", "COLA", "cola and lime 500ML", "usp"]
    new = spark.createDataFrame(list(enumerate(typos)), "__row_id long, b string")
    master = spark.createDataFrame(list(enumerate(names)), "__row_id long, b string")
    got = {r["value"]: (r["action"], r["to"], r["confidence"]) for r in labels.suggest(labels.unmatched(new, master, "b", "b"), master, "b", {"ZZZ": "LEMON", "!!": "gone"}).collect()}
    for value in typos:
        best = max(names, key=lambda n: labels.similarity(value, n))
        score = labels.similarity(value, best)
        want = ("map", "LEMON", 1.0) if value == "zzz" else ("map", best, round(score, 3)) if score >= labels.LEAST_SIMILARITY else ("add", None, round(score, 3))
        assert got[value] == want, value
    assert all(got[v][0] == "map" for v in typos[:7])


def test_report_and_attributes(spark):
    new = spark.createDataFrame([(0, "colaa", "Lahore", "1"), (1, "ORANGE", "lahore", "2"), (2, "new one", "Multan", "3")], "__row_id long, brand string, city string, qty string")
    master = spark.createDataFrame([(0, "COLA", "LAHORE", "1"), (1, "ORANGE", "MULTAN", "9")], "__row_id long, BRAND string, CITY string, qty string")
    pairs = labels.suggest_attributes(new, master)
    assert pairs == [{"new": "brand", "master": "BRAND"}, {"new": "city", "master": "CITY"}]
    summary, rows = labels.report(new, master, [*pairs, {"new": "qty", "master": "qty"}], decisions={"brand": {"new one": {"action": "exclude"}}})
    assert {tuple(r) for r in summary.collect()} == {("brand", "BRAND", 3, 2, 1, False), ("city", "CITY", 3, 2, 3, False), ("qty", "qty", 0, 0, 0, True)}
    assert {(r["value"], r["action"], r["to"]) for r in rows.collect()} == {("colaa", "map", "COLA"), ("new one", "exclude", None)}
    assert labels.guess_id(spark.createDataFrame([], "a string, `Visit ID` long, paid double")) == "Visit ID" and labels.guess_id(new.drop("__row_id")) is None
    assert [r["value"] for r in labels.review_list(new, "city", {"multan": "x"}).collect()] == ["Lahore", "lahore"]


def test_rule_assembly():
    profile = {"validations": [{"column": "a", "type": "min"}, {"column": "b", "type": "max", "enabled": False}, {"column": "c", "type": "Max"}]}
    blocks = lambda **qc: [r["blocking"] for r in quality.assemble_rules(profile, {"qc": qc})]
    assert blocks() == [True, True] and blocks(blocking="none") == [False, False]
    assert blocks(blocking=[{"column": "c", "type": "max"}]) == [False, True] and blocks(warn_only=[{"column": "c", "type": "max"}]) == [True, False]
    assert blocks(blocking="own", extra_validations=[{"column": "d", "type": "min", "blocking": True}]) == [False, False, True]


def test_config_order_and_presets():
    cfg = {"output_columns": [{"name": c} for c in "xbya"]}
    assert [c["name"] for c in order_like(cfg, ["a", "b"])["output_columns"]] == ["a", "b", "x", "y"]
    assert fill_presets("P", "new")["jitter1"]["expr"] == "COALESCE([new_donor.P], [donor.P]) * RANDBETWEEN(99,101) / 100"


def test_final_types(spark):
    df = spark.createDataFrame([("1", "007", "2.5", "2024-01-01", "x", "9007199254740993"), (None, "8", " 3 ", None, "1", "2")], "a string, b string, c string, d string, e string, f string")
    assert [f.dataType.simpleString() for f in final_types(df).schema] == ["bigint", "string", "double", "date", "string", "bigint"]
    assert final_types(df, compat=True).first()["b"] == 7 and final_types(df).first()["f"] == 9007199254740993


def test_suggest_standard(spark):
    new = spark.createDataFrame([(0, "orange fizz"), (1, "ORANGE FIZZ "), (2, "zzz")], "__row_id long, b string")
    master = spark.createDataFrame([(0, "ORANGE"), (1, "COLA")], "__row_id long, b string")
    got = {r["value"]: (r["action"], r["to"]) for r in labels.suggest(labels.unmatched(new, master, "b", "b"), master, "b").collect()}
    assert got["orange fizz"] == ("map", "ORANGE") and got["zzz"] == ("add", None)


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Sales report,,\nName,Start  date,Qty\nx,45292,1\ny,45293,2.5\n,,\n")
    df = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("Name").collect()] == [("x", dt.date(2024, 1, 1), 1.0), ("y", dt.date(2024, 1, 2), 2.5)] and df.columns == ["Name", "Start date", "Qty"]
    assert tables.clean_names(["a", "a", None, " b\n c "]) == ["a", "a.1", "Column 3", "b c"]


def test_text_headers_and_positions(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Total,,\n"a, b",a,a\n"x\ny",007,Total\nTotal,,\n\n"q, r",8,_c3\n')
    df = tables.read_table(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["a, b", "a", "a.1"] and {tuple(r) for r in df.collect()} == {("x\ny", "007", "Total"), ("Total", None, None), ("q, r", "8", "_c3")}
    (tmp_path / "c.csv").write_text("_c3;n\n_c3;1\nz;2\n")
    df = tables.read_table(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["_c3", "n"] and df.count() == 2


def _workbook(path, sheets, styles=""):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>")


def test_workbooks_files_and_sheets(spark, tmp_path):
    text = lambda ref, s: f'<c r="{ref}" t="inlineStr"><is><t>{s}</t></is></c>'
    rows = [text("A1", "Name") + text("B1", "Start") + text("C1", "Flag"), text("A2", "x") + '<c r="B2" s="1"><v>45292</v></c><c r="C2" t="b"><v>1</v></c>', text("A3", "y") + '<c r="B3" s="1"><v>45293</v></c><c r="C3" t="e"><v>#N/A</v></c>']
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs>'
    _workbook(tmp_path / "Sales DB.xlsx", {"Run Summary": [rows[0] + text("D1", "more"), rows[1], rows[2]], "Data": rows}, styles)
    (tmp_path / "MD list.csv").write_text("a,b\nx,1\n")
    (tmp_path / "raw May.csv").write_text("a,b\nx,1\n")
    files = tables.resolve_files(spark, str(tmp_path))
    assert {r: p.rsplit("/", 1)[1] for r, p in files.items()} == {"historical": "Sales DB.xlsx", "master": "MD list.csv", "new": "raw May.csv"}
    with pytest.raises(FileNotFoundError):
        tables.resolve_files(spark, str(tmp_path), {"master": "none.csv"})
    sheet = tables.choose_sheet(spark, files["historical"], "historical")
    df = tables.read_table(spark, files["historical"], sheet)
    assert sheet == "Data" and {tuple(r) for r in df.collect()} == {("x", dt.date(2024, 1, 1), "True"), ("y", dt.date(2024, 1, 2), None)}


def test_batch_writes_its_quarantine(spark, frames, tmp_path):
    folder = tmp_path / "in"
    for name, df in {"new_data": frames.new.withColumn("PRICE", F.when(F.col("ID") == 1001, -1.0).otherwise(F.col("PRICE"))), "master": frames.master, "history": frames.historical}.items():
        df.write.parquet(str(folder / f"{name}.parquet"))
    told = []
    profile = CONFIG | {"validations": CONFIG["validations"][:2]}
    go = lambda **options: batch.run(spark, profile, {"qc": {"warn_only": [{"column": "PRICE", "type": "max"}]}, "database": {"key_columns": ["CITY", "SKU", "Date"], "partition": "Date"}, "output_dir": str(tmp_path / "out")}, str(folder), str(tmp_path / "db"), notify=lambda s, x: told.append(s), **options)
    got = go(dry_run=True)
    assert got["loaded"] is False and (got["clean"], got["quarantined"]) == (47, 1) and not (tmp_path / "db").exists()
    bad = spark.read.parquet(got["sheets"]["Quarantined Rows"]).collect()
    assert [(r["ID"], r["QC_REASON"]) for r in bad] == [(1001, "PRICE: not positive")]
    for _ in range(2):
        assert go()["loaded"] and sinks.read_table(spark, str(tmp_path / "db")).count() == 47
    assert told == ["rows need attention"] * 3 and batch.read_status(spark, str(tmp_path / "out" / "last_run.json"))["status"] == "completed_with_attention"


def test_poll_sees_a_file_written_again(spark, tmp_path):
    seen, folder, state = [], tmp_path / "in", str(tmp_path / "state.json")
    folder.mkdir()
    (folder / "db.csv").write_text("x")
    look = lambda: watcher.poll(spark, str(folder), state, lambda p: seen.append(p) or {"ok": 1}, "*.csv", ("db.csv",), 0)
    assert look() is None
    (folder / "new.csv").write_text("a")
    assert look() == {"ok": 1} and look() is None
    (folder / "new.csv").write_text("ab")
    assert look() == {"ok": 1} and len(seen) == 2
    (folder / "new.csv").write_text("abc")
    with pytest.raises(ZeroDivisionError):
        watcher.poll(spark, str(folder), state, lambda p: {"x": 1 / 0}, "*.csv", ("db.csv",), 0)
    assert look() is None


def test_partitions_that_nothing_comes_for_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_partitions(spark.createDataFrame([(1, "a", 1), (2, "a", 1), (1, "b", 1)], "k int, p string, v int"), path, ["k", "p"], "p")
    holding = lambda p: {n for n, f in commits.snapshot(spark, path).files.items() if f["keys"]["p"][0] <= p <= f["keys"]["p"][1]}
    before = holding("B")
    sinks.upsert_partitions(spark.createDataFrame([(2, "a", 5), (1, "c", 5)], "k int, p string, v int"), path, ["k", "p"], "p")
    assert {(r["k"], r["p"], r["v"]) for r in sinks.read_table(spark, path).collect()} == {(1, "a", 1), (2, "a", 5), (1, "b", 1), (1, "c", 5)}
    assert before and before == holding("B")


def test_scratch_folder_needs_to_be_shared(spark, monkeypatch):
    class Context:
        master, getCheckpointDir = "yarn", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = {"spark.checkpoint.dir": None}, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.folder(Session)


def test_upsert_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "ID long, v string")
    two = spark.createDataFrame([(2, "c", 9)], "ID long, v string, extra int")
    sinks.upsert(one, path)
    sinks.upsert(two, path)
    first = sorted(map(tuple, sinks.read_table(spark, path).collect()))
    sinks.upsert(two, path)
    assert first == sorted(map(tuple, sinks.read_table(spark, path).collect())) == [(1, "a", None), (2, "c", 9)]


def test_watch(spark, frames, tmp_path):
    frames.new.write.parquet(str(tmp_path / "in"))
    seen = []
    q = watcher.watch(spark, str(tmp_path / "in"), frames.new.schema, frames.master, frames.historical, CONFIG | {"validations": []}, str(tmp_path / "out"), str(tmp_path / "cp"), ["CITY", "SKU", "Date"], report=lambda n, r: seen.append(r))
    assert q.awaitTermination(120) and seen[0]["clean"] == 48 and sinks.read_table(spark, str(tmp_path / "out")).count() == 48


def test_explicit_dates_need_a_list(spark):
    with pytest.raises(ValueError):
        grid.dates(spark, spark.range(0), "explicit")
