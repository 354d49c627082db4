"""Workbooks of both formats, read in ranges, and written by tasks."""

import datetime as dt
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.sources import sinks, tables, workbooks


def packed(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def record(number, content=b""):
    return packed(number) + packed(len(content)) + content


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def write_xlsb(path, named, shared, styles=(0,)):
    """named: sheets as lists of rows of (column, record number, content, style)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.bin", record(131) + record(143) + b"".join(record(156, struct.pack("<II", 0, i) + wide(f"r{i}") + wide(n)) for i, n in enumerate(named)) + record(144) + record(132))
        z.writestr("xl/_rels/workbook.bin.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.bin"/>' for i in range(len(named))) + "</Relationships>")
        z.writestr("xl/sharedStrings.bin", record(159) + b"".join(record(19, b"\0" + wide(t)) for t in shared) + record(160))
        z.writestr("xl/styles.bin", record(44, struct.pack("<H", 170) + wide('dd/mm/yyyy "day"')) + record(626) + record(47, struct.pack("<HH", 0, 14)) + record(627) + record(617) + b"".join(record(47, struct.pack("<HH", 0, n) + bytes(12)) for n in styles) + record(618))
        for i, rows in enumerate(named.values()):
            body = b"".join(record(0, struct.pack("<I", n) + bytes(13)) + b"".join(record(kind, struct.pack("<II", column, style) + content) for column, kind, content, style in row) for n, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.bin", record(129) + record(145) + body + record(146) + record(130))


def rk(value, hundredth=False):
    return struct.pack("<i", value << 2 | 2 | hundredth)


def test_binary_workbook(spark, tmp_path):
    text = lambda c, i: (c, 7, struct.pack("<I", i), 0)
    rows = [
        [text(0, 0), text(1, 1), text(2, 2), text(3, 3)],
        [(0, 6, wide("x"), 0), (1, 2, rk(45292), 1), (2, 4, b"\1", 0), (3, 5, struct.pack("<d", 2.5), 0)],
        [(0, 8, wide("yé水"), 0), (1, 9, struct.pack("<d", 45293.5), 1), (2, 3, b"\x2a", 0), (3, 2, rk(150, True), 0)],
        [(0, 1, b"", 0), (3, 2, struct.pack("<I", struct.unpack("<Q", struct.pack("<d", 7.0))[0] >> 32 & ~3), 0)],
    ]
    path = str(tmp_path / "b.xlsb")
    write_xlsb(path, {"first": rows[:1], "data & more": rows}, ["Name", "When", "Flag", "Qty"], (0, 170))
    assert tables.list_sheets(spark, path) == ["first", "data & more"]
    got = [tuple(r) for r in workbooks.read_rows(spark, path, "data & more", 20).orderBy("n").collect()]
    assert got == [(0, ["Name", "When", "Flag", "Qty"]), (1, ["x", "2024-01-01", "True", "2.5"]), (2, ["yé水", "2024-01-02 12:00:00", None, "1.5"]), (3, [None, None, None, "7"])]
    df = tables.read_table(spark, path, "data & more")
    assert df.columns == ["Name", "When", "Flag", "Qty"] and df.count() == 3 and dict(df.dtypes)["Qty"] == "double"


@pytest.mark.parametrize("size", [1, 77, 1000, 1 << 20])
def test_ranges_hold_every_row_once(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(workbooks, "CHUNK", 100)
    path = str(tmp_path / "a.xlsx")
    ns = 'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = "".join(f'<x:row r="{i + 1}"/>' if i % 7 == 3 else f'<x:row r="{i + 1}"><x:c r="B{i + 1}" t="inlineStr"><x:is><x:t>v&lt;{i}</x:t></x:is></x:c></x:row>' for i in range(60))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r0"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r0" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<x:worksheet {ns}><x:cols/><x:sheetData>{rows}</x:sheetData><x:pageMargins/></x:worksheet>")
    reader = workbooks.SheetReader({"path": path, "range": str(size)})
    parts = reader.partitions()
    assert len(parts) == -(-zipfile.ZipFile(path).getinfo("xl/worksheets/s.xml").file_size // size)
    got = [r for p in parts for r in reader.read(p)]
    assert got == [(i, [] if i % 7 == 3 else [None, f"v<{i}"]) for i in range(60)]


@pytest.mark.parametrize("rows, want", [("<sheetData/>", []), ("<sheetData></sheetData>", []), ('<sheetData>\n<row><c><v>1</v></c></row>\n<row/></sheetData>', [(0, ["1"]), (1, [])]), ('<sheetData><row><c t="inlineStr"><is><t>a &lt;/sheetData> sheetData</t></is></c></row><row><c r="C2"><v>2</v></c></row></sheetData>', [(0, ["a </sheetData> sheetData"]), (1, [None, None, "2"])])])
@pytest.mark.parametrize("chunk", [7, 50, 1 << 20])
def test_rows_end_with_the_sheets_data(tmp_path, monkeypatch, rows, want, chunk):
    monkeypatch.setattr(workbooks, "CHUNK", chunk)
    stream = io.BytesIO(f'<worksheet xmlns="{workbooks._NS["m"]}">{rows}<controls><x:from xmlns:x="x"><x:row>5</x:row></x:from></controls></worksheet>'.encode())
    assert list(workbooks._xml_rows(stream, 0, 1 << 62, [], set())) == want


def test_workbook_round_trip(spark, tmp_path):
    day = dt.date(2024, 5, 6)
    rows = [(i, f"a<&\"' {i}\nb" if i % 3 else None, i / 4 if i % 5 else None, day if i % 2 else None, dt.datetime(2024, 5, 6, 7, 8, 9), i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string, x double, Date date, at timestamp, b boolean").repartition(4)
    path = sinks.write_sheets({"Output: Data": df, "None": df.limit(0)}, str(tmp_path / "out"), "xlsx")["Output: Data"]
    assert tables.list_sheets(spark, path) == ["Output_ Data", "None"] and [p.name for p in (tmp_path / "out").iterdir()] == ["workbook.xlsx"]
    back = tables.read_table(spark, path, "Output_ Data", 0)
    want = df.select("id", "t", "x", "Date", "at", F.initcap(F.col("b").cast("string")).alias("b"))
    text = lambda d: sorted((tuple(None if x is None else str(x) for x in r) for r in d.collect()), key=str)
    assert back.columns == want.columns and text(back) == text(want)
    assert workbooks.read_rows(spark, path, "None").collect()[0]["v"] == df.columns


def test_rows_beyond_a_sheet_go_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 100)
    long = "it's <a> name of 31 characters."
    frames = {long: spark.range(950).repartition(3).select("id", F.concat(F.lit("t"), "id").alias("t")), "b": spark.range(99), "B (2)": spark.range(3), "c": spark.range(100, numPartitions=1), "b (3)": spark.range(250, numPartitions=1)}
    path = workbooks.write_workbook(frames, str(tmp_path / "w.xlsx"))
    assert tables.list_sheets(spark, path) == list(frames)
    with zipfile.ZipFile(path) as z:
        named = workbooks.sheets(z)
        listed = [s.get("name") for s in workbooks.ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
        texts = [z.read(part) for parts in named.values() for part in parts]
    assert [len(parts) for parts in named.values()][1:] == [1, 1, 2, 3] and len(texts) == len(listed) == len({n.casefold() for n in listed})
    assert max(map(len, listed)) == 31 and all(t.count(b"<row>") <= 100 and b'preserve">id<' in t for t in texts)
    for name, df in frames.items():
        back = tables.read_table(spark, path, name, 0)
        assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
        numbers = [r["n"] for r in workbooks.read_rows(spark, path, name, 500).collect()]
        assert len(numbers) == len(set(numbers)) == df.count() + 1
    assert [cells[0] for _, cells in workbooks.sheet_rows(path, "b (3)")] == ["id", *map(str, range(250))]


@pytest.mark.parametrize("mark, listed", [("one!$A$1", {"one": 2, "two!": 1}), ("'two!'!$A$1", {"one": 1, "two!": 2}), ("#REF!$A$1", {"one": 1, "two!": 1, "three": 1})])
def test_sheets_are_taken_as_one_by_their_mark(tmp_path, mark, listed):
    main, rel = workbooks._NS["m"], workbooks._NS["r"]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        named = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(["one", "two!", "three"]))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{named}</sheets><definedNames><definedName name="other" localSheetId="1">one!$A$1</definedName><definedName name="{workbooks.GOES_ON}" localSheetId="2" hidden="1">{mark}</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/{i}.xml"/>' for i in range(3)) + "</Relationships>")
        assert {name: len(parts) for name, parts in workbooks.sheets(z).items()} == listed


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        workbooks.write_workbook({"a": spark.range(3), "b": bad}, str(tmp_path / "w.xlsx"))
    assert list(tmp_path.iterdir()) == []
