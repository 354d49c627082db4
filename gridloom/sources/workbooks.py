"""Workbooks as data sources: rows of a sheet in, sheets out.

A workbook is a zip of parts, XML in .xlsx, .xlsm and .xltx, records in .xlsb. A sheet is
read in ranges of its uncompressed bytes: each task unpacks the part, which is cheap, passes
over what is not its own without parsing it, and parses the rows that start in its range.
Tasks that write turn rows into packed XML aside; the commit puts these into one .xlsx, piece by
piece, and an abort removes them. Rows beyond what a sheet can hold go on in further sheets
with the same header; a hidden name of each tells the sheet that it goes on with, and the
reader takes them as one (in .xlsb, which this does not write, each stands by itself).

Edge cases: cells that a row leaves out are nulls, as are errors; a sheet without rows gives
none; cells whose style shows a date are ISO dates; .xls has no reader.
"""

from __future__ import annotations

import datetime
import io
import json
import math
import re
import struct
import uuid
import zipfile
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .paths import arrow_fs

READABLE = (".xlsx", ".xlsm", ".xltx", ".xlsb")
#: Uncompressed bytes of a sheet behind a task.
RANGE = 32 << 20
CHUNK = 1 << 20
#: Rows that a sheet of a workbook can hold, and that a task writes to a part at most.
MOST_ROWS = 1_048_576
PART_ROWS = 65_535
#: Name, within a sheet, of the first cell of the sheet whose rows it goes on with.
GOES_ON = "gridloom.goes_on"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
EPOCH = datetime.datetime(1899, 12, 30)

# Record numbers of binary workbooks.
ROW, BLANK, RK, ERROR, BOOL, REAL, TEXT, SHARED = range(8)
FORMULA_TEXT, FORMULA_REAL, FORMULA_BOOL, FORMULA_ERROR = range(8, 12)
SHARED_ITEM, FORMAT, STYLE, SHEET, STYLES_BEGIN, STYLES_END = 19, 44, 47, 156, 617, 618


def open_workbook(path: str) -> zipfile.ZipFile:
    if not path.lower().endswith(READABLE):
        raise ValueError(f"{path}: only {', '.join(READABLE)} workbooks can be read")
    fs, p = arrow_fs(path)
    return zipfile.ZipFile(fs.open_input_file(p))


def records(data: bytes | io.BufferedIOBase) -> Iterator[tuple[int, int, bytes]]:
    """(place, number, content) of a binary part's records; number and size are written in
    groups of seven bits."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    place = 0

    def packed(most: int) -> tuple[int, int] | None:
        value, used = 0, 0
        while used < most:
            b = stream.read(1)
            if not b:
                return None
            value |= (b[0] & 0x7F) << 7 * used
            used += 1
            if b[0] < 0x80:
                break
        return value, used

    while (number := packed(2)) is not None and (size := packed(4)) is not None:
        yield place, number[0], stream.read(size[0])
        place += number[1] + size[1] + size[0]


def _wide(content: bytes, at: int) -> tuple[str, int]:
    """A counted UTF-16 text and the place after it."""
    n = struct.unpack_from("<I", content, at)[0]
    n = 0 if n == 0xFFFFFFFF else n
    return content[at + 4 : at + 4 + 2 * n].decode("utf-16-le"), at + 4 + 2 * n


def _first_cell(name: str) -> str:
    return "'" + name.replace("'", "''") + "'!$A$1"


def _sheet_of(cell: str) -> str:
    name = cell.rpartition("!")[0]
    return name[1:-1].replace("''", "'") if name.startswith("'") else name


def sheets(z: zipfile.ZipFile) -> dict[str, list[str]]:
    """The parts of each sheet, by name, in order: its own, then those that go on with its rows."""
    binary = "xl/workbook.bin" in z.namelist()
    part = "xl/workbook.bin" if binary else "xl/workbook.xml"
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(f"xl/_rels/{part[3:]}.rels"))}
    found, goes_on = {}, {}
    if binary:
        for _, number, content in records(z.read(part)):
            if number == SHEET:
                rel, at = _wide(content, 8)
                found[_wide(content, at)[0]] = rel
    else:
        root = ElementTree.fromstring(z.read(part))
        for s in root.findall("m:sheets/m:sheet", _NS):
            found[s.get("name")] = s.get(f"{{{_NS['r']}}}id")
        for d in root.findall("m:definedNames/m:definedName", _NS):
            if d.get("name") == GOES_ON and d.get("localSheetId"):
                goes_on[list(found)[int(d.get("localSheetId"))]] = _sheet_of(d.text or "")
    # A sheet whose first one is gone stands by itself.
    goes_on = {name: first for name, first in goes_on.items() if first in found.keys() - goes_on.keys()}
    out: dict[str, list[str]] = {name: [] for name in found if name not in goes_on}
    for name in sorted(found, key=lambda name: name in goes_on):
        out[goes_on.get(name, name)].append("xl/" + rels[found[name]].removeprefix("/xl/").removeprefix("xl/"))
    return out


def _dated(number: int, code: str | None) -> bool:
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "")
    return number in (*range(14, 23), *range(45, 48)) or bool(re.search("[ymdhs]", plain, re.I))


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.bin" in z.namelist():
        codes, styles, inside = {}, [], False
        for _, number, content in records(z.read("xl/styles.bin")):
            if number == FORMAT:
                codes[struct.unpack_from("<H", content)[0]] = _wide(content, 2)[0]
            elif number in (STYLES_BEGIN, STYLES_END):
                inside = number == STYLES_BEGIN
            elif number == STYLE and inside:
                styles.append(struct.unpack_from("<H", content, 2)[0])
    elif "xl/styles.xml" in z.namelist():
        root = ElementTree.fromstring(z.read("xl/styles.xml"))
        codes = {int(f.get("numFmtId")): f.get("formatCode") for f in root.findall("m:numFmts/m:numFmt", _NS)}
        styles = [int(xf.get("numFmtId") or 0) for xf in root.findall("m:cellXfs/m:xf", _NS)]
    else:
        return set()
    return {i for i, n in enumerate(styles) if _dated(n, codes.get(n))}


def shared_texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.bin" in z.namelist():
        return [_wide(c, 1)[0] for _, n, c in records(z.read("xl/sharedStrings.bin")) if n == SHARED_ITEM]
    if "xl/sharedStrings.xml" in z.namelist():
        return ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    return []


def _day(days: float) -> str:
    at = EPOCH + datetime.timedelta(days=days)
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(" ", "seconds")


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


_CELL, _VALUE, _TEXT = (f"{{{_NS['m']}}}{name}" for name in "cvt")
_COLUMN = re.compile("[A-Z]*")


def _put(cells: list[str | None], at: int, value: str | None) -> None:
    cells.extend([None] * (at - len(cells)))
    cells.append(value)


def _xml_cells(row: ElementTree.Element, shared: list[str], dates: set[int]) -> list[str | None]:
    cells: list[str | None] = []
    for c in row.iter(_CELL):
        at, kind, v = 0, c.get("t"), c.find(_VALUE)
        if place := c.get("r"):
            for ch in _COLUMN.match(place)[0]:
                at = at * 26 + ord(ch) - 64
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in c.iter(_TEXT))
        elif v is None or kind == "e":
            value = None
        elif kind == "s":
            value = shared[int(v.text)]
        elif kind == "b":
            value = "True" if v.text == "1" else "False"
        elif kind in (None, "n") and v.text and int(c.get("s") or 0) in dates:
            value = _day(float(v.text))
        else:
            value = v.text
        _put(cells, (at or len(cells) + 1) - 1, value)
    return cells


_ROW = re.compile(rb"<(?:\w+:)?row(?=[\s/>])")
_ROWS_END = re.compile(rb"</(?:\w+:)?sheetData\s*>|<(?:\w+:)?sheetData\s*/>")


def _xml_rows(stream, low: int, high: int, shared: list[str], dates: set[int]) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of the rows that start in bytes low to high. Rows before are
    counted only; the parser sees none but its own, those of a chunk at once."""
    buffer, base, n, ended, head = b"", 0, 0, False, None
    while True:
        more = b"" if ended else stream.read(CHUNK)
        buffer += more
        ended = ended or not more
        if b"sheetData" in buffer and (end := _ROWS_END.search(buffer)):
            buffer, ended = buffer[: end.start()], True
        if head is None:
            start = _ROW.search(buffer)
            if not start and not ended:
                continue
            # The sheet's own opening, so that its name spaces hold for each row.
            opening = re.search(rb"<(?:\w+:)?worksheet\b[^>]*>", buffer)
            head = opening[0] if opening else b"<worksheet>"
            tail = b"</" + re.match(rb"<([\w:]+)", head)[1] + b">"
        starts = [m.start() for m in _ROW.finditer(buffer)]
        # The last row may go on in the next chunk.
        whole = starts if ended else starts[:-1]
        first, last = bisect_left(whole, low - base), bisect_left(whole, high - base)
        if first < last:
            text = buffer[whole[first] : starts[last] if last < len(starts) else None]
            for row in ElementTree.fromstring(head + text + tail):
                yield n + first, _xml_cells(row, shared, dates)
                first += 1
        if ended or last < len(whole):
            return
        n += len(whole)
        keep = starts[-1] if starts else max(len(buffer) - 64, 0)
        base, buffer = base + keep, buffer[keep:]


def _binary_rows(stream, low: int, high: int, shared: list[str], dates: set[int]) -> Iterator[tuple[int, list[str | None]]]:
    n, cells, wanted = -1, [], False
    for place, number, c in records(stream):
        if number == ROW:
            if wanted:
                yield n, cells
            if place >= high:
                return
            n, cells, wanted = n + 1, [], place >= low
        elif wanted and BLANK <= number <= FORMULA_ERROR:
            column, style = struct.unpack_from("<II", c)
            value = None
            if number in (REAL, FORMULA_REAL, RK):
                if number == RK:
                    raw = struct.unpack_from("<i", c, 8)[0]
                    x = float(raw >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
                    x = x / 100 if raw & 1 else x
                else:
                    x = struct.unpack_from("<d", c, 8)[0]
                value = _day(x) if style & 0xFFFFFF in dates else _number(x)
            elif number in (BOOL, FORMULA_BOOL):
                value = "True" if c[8] else "False"
            elif number in (TEXT, FORMULA_TEXT):
                value = _wide(c, 8)[0]
            elif number == SHARED:
                value = shared[struct.unpack_from("<I", c, 8)[0]]
            _put(cells, column, value)
    if wanted:
        yield n, cells


def sheet_rows(path: str, sheet: str | None, low: int = 0, high: int = 1 << 62, which: int | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of a sheet's rows, and of those that go on in further sheets, without
    the headers there; which: one of these alone. Numbers rise from sheet to sheet, with gaps."""
    with open_workbook(path) as z:
        named = sheets(z)
        shared, dates = shared_texts(z), date_styles(z)
        for i, part in enumerate(named[sheet] if sheet else next(iter(named.values()))):
            if which not in (None, i):
                continue
            run = _binary_rows if part.endswith(".bin") else _xml_rows
            with z.open(part) as stream:
                for n, cells in run(stream, low, high, shared, dates):
                    if n or not i:
                        yield i * MOST_ROWS + n, cells


class Range(InputPartition):
    def __init__(self, which: int, low: int, high: int):
        self.which, self.low, self.high = which, low, high


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.sheet = options["path"], options.get("sheet") or None
        self.size = int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        with open_workbook(self.path) as z:
            named = sheets(z)
            sizes = [z.getinfo(part).file_size for part in (named[self.sheet] if self.sheet else next(iter(named.values())))]
        return [Range(i, at, at + self.size) for i, size in enumerate(sizes) for at in range(0, max(size, 1), self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from sheet_rows(self.path, self.sheet, partition.low, partition.high, partition.which)


class Message(WriterCommitMessage):
    def __init__(self, number: int, parts: list[tuple[str, int]]):
        self.number, self.parts = number, parts


def _xml_cell(x) -> str:
    if x is None or isinstance(x, float) and not math.isfinite(x):
        return "<c/>"
    if isinstance(x, bool):
        return f'<c t="b"><v>{int(x)}</v></c>'
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"<c><v>{x!r}</v></c>" if isinstance(x, (int, float)) else f"<c><v>{x}</v></c>"
    if isinstance(x, datetime.datetime):
        since = x.replace(tzinfo=None) - EPOCH
        return f'<c s="2"><v>{since.days + since.seconds / 86400 + since.microseconds / 86400e6!r}</v></c>'
    if isinstance(x, datetime.date):
        return f'<c s="1"><v>{(x - EPOCH.date()).days}</v></c>'
    plain = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(x))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>'


class SheetWriter(DataSourceWriter):
    """Parts of a sheet in a folder of their own, listed by the commit with their rows, of
    which none has more than a sheet can hold."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.most = options["path"], int(options.get("rows", PART_ROWS))

    def write(self, iterator) -> Message:
        fs, folder = arrow_fs(self.folder)
        fs.create_dir(folder, recursive=True)
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        parts, rows = [], self.most
        while rows == self.most:
            part, rows = f"{folder}/part-{number:06d}-{uuid.uuid4().hex}.xml.zst", 0
            with fs.open_output_stream(part, compression="zstd") as out:
                for row in islice(iterator, self.most):
                    out.write(("<row>" + "".join(map(_xml_cell, row)) + "</row>").encode())
                    rows += 1
            parts.append((part, rows))
        return Message(number, parts)

    def commit(self, messages: list[Message | None]) -> None:
        fs, folder = arrow_fs(self.folder)
        fs.create_dir(folder, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with fs.open_output_stream(f"{folder}/sheet.json") as out:
            out.write(json.dumps([p for m in done for p in m.parts]).encode())

    def abort(self, messages: list[Message | None]) -> None:
        fs, folder = arrow_fs(self.folder)
        if fs.get_file_info(folder).type == files.FileType.Directory:
            fs.delete_dir(folder)


class Workbook(DataSource):
    """Reading: path, sheet (else the first) and range; rows (n, v). Writing: path, a
    folder for the parts of one sheet, and rows, those of a part at most."""

    @classmethod
    def name(cls) -> str:
        return "workbook_rows"

    def schema(self) -> str:
        return "n bigint, v array<string>"

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options))


def read_rows(spark: SparkSession, path: str, sheet: str | None = None, size: int = RANGE) -> DataFrame:
    """(n, v): the rows of a sheet, as of sheet_rows(), and their cells as texts."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook_rows").options(path=path, sheet=sheet or "", range=str(size)).load()


_MAIN, _REL = _NS["m"], _NS["r"]
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_STYLES = f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'


def _dealt(parts: list[tuple[str, int]]) -> list[list[str]]:
    """A frame's parts by sheet, in order; the header takes a row of each."""
    out, rows = [[]], 1
    for part, more in parts:
        if rows + more > MOST_ROWS:
            out.append([])
            rows = 1
        out[-1].append(part)
        rows += more
    return out


def _further(name: str, taken: set[str]) -> str:
    """A name for a sheet that goes on with this one, of 31 characters at most."""
    names = (f"{name[: 31 - len(end)]}{end}" for end in map(" ({})".format, count(2)))
    found = next(n for n in names if n.casefold() not in taken)
    taken.add(found.casefold())
    return found


def write_workbook(frames: dict[str, DataFrame], path: str) -> str:
    """One .xlsx with a sheet for each frame, in the frames' order, with a header row; as
    many sheets as its rows need. Tasks write the sheets' rows; the driver only copies the
    parts, a piece at a time. The workbook takes its place by a rename at the end; the
    parts go whatever happens."""
    fs, target = arrow_fs(path)
    aside = f"{target}.{uuid.uuid4().hex}"
    try:
        parts = {}
        for i, (name, df) in enumerate(frames.items()):
            df.sparkSession.dataSource.register(Workbook)
            df.write.format("workbook_rows").mode("append").option("rows", min(PART_ROWS, MOST_ROWS - 1)).save(f"{aside}/{i}")
            with fs.open_input_stream(f"{aside}/{i}/sheet.json") as stream:
                parts[name] = json.loads(stream.readall())
        taken = {name.casefold() for name in frames}
        dealt = [(name, held, n) for name, found in parts.items() for n, held in enumerate(_dealt(found))]
        order = [(i, _further(name, taken) if n else name) for i, (name, _, n) in enumerate(dealt, 1)]
        with fs.open_output_stream(f"{aside}/workbook.xlsx") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in order)
            z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{overrides}</Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in order)
            marks = "".join(f'<definedName name="{GOES_ON}" localSheetId="{i}" hidden="1">{escape(_first_cell(name))}</definedName>' for i, (name, _, n) in enumerate(dealt) if n)
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets>{marks and f"<definedNames>{marks}</definedNames>"}</workbook>')
            related = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in order)
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{related}<Relationship Id="styles" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/styles.xml", _STYLES)
            for i, (name, held, _) in enumerate(dealt, 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData><row>{"".join(map(_xml_cell, frames[name].columns))}</row>'.encode())
                    for part in held:
                        with fs.open_input_stream(part, compression="zstd") as stream:
                            while piece := stream.read(CHUNK):
                                sheet.write(piece)
                    sheet.write(b"</sheetData></worksheet>")
        fs.move(f"{aside}/workbook.xlsx", target)
        return path
    finally:
        if fs.get_file_info(aside).type == files.FileType.Directory:
            fs.delete_dir(aside)
