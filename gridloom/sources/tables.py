"""Readers: Parquet, delimited text and workbooks, with header and type inference.

Delimited text is read in splits (delimited.py); only a few lines come to the driver to find
the delimiter and header row. Workbooks are read in ranges of a sheet (workbooks.py).
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import NUMBER
from ..operators.grid import kinds
from ..scratch import materialise
from . import delimited, workbooks

SCAN_ROWS = 12
SERIAL_SHARE = 0.9


def clean_names(names: list[str | None]) -> list[str]:
    """One blank for white space; Column N for blanks; .1, .2 for repeats."""
    out: list[str] = []
    for i, raw in enumerate(names):
        base = " ".join(str(raw or "").split()) or f"Column {i + 1}"
        name, n = base, 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def header_row(rows: list[list[str | None]]) -> int:
    """The row that looks most like a header: texts, filled, wide, without repeats, and
    above numbers; earlier rows are better."""
    width, best, at = max((sum(v not in (None, "") for v in r) for r in rows), default=1) or 1, float("-inf"), 0
    for i, row in enumerate(rows[:SCAN_ROWS]):
        cells = [str(v).strip() for v in row if v not in (None, "")]
        if not cells:
            continue
        below = [str(v) for v in (rows[i + 1] if i + 1 < len(rows) else []) if v not in (None, "")]
        numeric = lambda vs: sum(bool(re.match(NUMBER, v)) for v in vs) / max(len(vs), 1)
        score = 2 * (1 - numeric(cells)) + 1.5 * len(cells) / max(len(row), 1) + len(cells) / width - 0.8 * (len(cells) - len({c.lower() for c in cells})) + 1.2 * numeric(below) - 0.15 * i
        if score > best:
            best, at = score, i
    return at


def delimiter(lines: list[str]) -> str:
    bare = [re.sub(r'"[^"]*"', "", line) for line in lines]
    counts = {d: [line.count(d) for line in bare if line.strip()] for d in (",", "\t", ";", "|")}
    return max(counts, key=lambda d: (min(counts[d], default=0) > 0, min(counts[d], default=0), sum(counts[d])))


def tidy(df: DataFrame) -> DataFrame:
    """Typed and cleaned: no empty rows, no unnamed empty columns, NaN as null, serial
    numbers under a date's name as dates, texts of dates as dates (of times as times). A column with a number like 007 stays text.
    One aggregation decides all of it."""
    names = df.columns
    text = {c for c, k in kinds(df).items() if k == "text"}
    blank = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")) if c in text else F.col(f"`{c}`")
    df = df.select(*[blank(c).alias(c) for c in names])
    df = df.filter(reduce(Column.__or__, [F.col(f"`{c}`").isNotNull() for c in names])) if names else df
    number = lambda c: F.when(F.col(f"`{c}`").rlike(NUMBER), F.trim(F.col(f"`{c}`")).try_cast("double")) if c in text else F.col(f"`{c}`").try_cast("double")
    whole = lambda c: F.count_if(number(c) == F.floor(number(c)))
    day = lambda c: F.col(f"`{c}`").try_cast("date") if c in text else F.lit(None)
    timed = lambda c: F.count_if(F.col(f"`{c}`").try_cast("timestamp") != F.col(f"`{c}`").try_cast("date")) if c in text else F.lit(0)
    stats = df.agg(F.array(*[F.array(F.count(F.col(f"`{c}`")), F.count(number(c)), whole(c), F.count_if(number(c).between(20000, 80000)), F.count(day(c)), F.count_if(F.col(f"`{c}`").rlike(r"^\s*[+-]?0[0-9]") if c in text else F.lit(False)), timed(c)) for c in names])).first()[0]
    out = []
    for c, (n, numbers, wholes, serials, days, zeros, times) in zip(names, stats):
        if n == 0 and re.fullmatch(r"(Column|Unnamed:?) ?\d+", c):
            continue
        own = F.col(f"`{c}`")
        if c in text or kinds(df)[c] == "number":
            if n and numbers == n and serials > SERIAL_SHARE * n and "date" in c.lower():
                own = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number(c)).cast("int"))
            elif c in text and n and numbers == n and not zeros:
                own = number(c).cast("bigint") if wholes == n else F.nanvl(number(c), F.lit(None))
            elif c in text and n and days == n and numbers == 0:
                own = own.try_cast("timestamp") if times else day(c)
        out.append(own.alias(c))
    return df.select(*out)


def parse_text(spark: SparkSession, path: str, header: int | None = None, sep: str | None = None, encoding: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV, TSV or other delimited text with a header somewhere in its first rows: the good
    records as a table, and (file, start, problem, raw) of those that are not. Each file's
    rows up to the header go by their position. encoding: else that of the byte order
    mark, else UTF-8."""
    top = lambda e: [bytes(r[0]) for r in delimited.lines(spark, path, e).filter("start = 0").limit(4 * SCAN_ROWS).select("value").collect()]
    first = top("utf-8")
    encoding = encoding or delimited.encoding_of(first[0] if first else b"") or "utf-8"
    if encoding.startswith("utf-16"):
        first = top(encoding)
    head = [v.decode(encoding, "backslashreplace").removeprefix("\ufeff").removesuffix("\r") for v in first]
    sep = sep or ("\t" if path.endswith(".tsv") else delimiter(head))
    cells = [row for row in csv.reader(io.StringIO("\n".join(head)), delimiter=sep) if row][: SCAN_ROWS + 3]
    at = header_row(cells) if header is None else header
    names = clean_names(cells[at]) if cells else []
    records = delimited.checked(delimited.parse(spark, path, sep, encoding), len(names)).filter(~((F.col("start") == 0) & (F.col("n") <= at)))
    bad = records.filter("problem is not null").select("file", "start", "problem", F.coalesce("raw", F.array_join("cells", sep)).alias("raw"))
    if not names:
        return spark.createDataFrame([], "`Column 1` string"), bad
    good = records.filter("problem is null")
    return tidy(good.select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)])), bad


def read_text(spark: SparkSession, path: str, header: int | None = None, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """The table of parse_text(); a record that is not good is an error."""
    good, bad = parse_text(spark, path, header, sep, encoding)
    shown = bad.limit(5).collect()
    if shown:
        raise ValueError(f"{path}: " + "; ".join(f"{r['problem']}: {r['raw'][:200]!r}" for r in shown))
    return good


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header: int | None = None) -> DataFrame:
    """A sheet of a workbook, parsed once, in ranges."""
    cells = materialise(workbooks.read_rows(spark, path, sheet), "workbook")
    head = [r["v"] for r in cells.filter(F.col("n") < SCAN_ROWS + 3).orderBy("n").collect()]
    if not head:
        raise ValueError(f"{path}: the sheet is empty")
    at = header_row(head) if header is None else header
    names = clean_names(head[at])
    return tidy(cells.filter(F.col("n") > at).select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(names)]))


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    if not path.lower().endswith(workbooks.READABLE):
        return ["(csv)"]
    with workbooks.open_workbook(path) as z:
        return list(workbooks.sheets(z))


def read_table(spark: SparkSession, path: str, sheet: str | None = None, header: int | None = None) -> DataFrame:
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if re.search(r"\.(csv|tsv|txt)$", path, re.I):
        return read_text(spark, path, header)
    return read_workbook(spark, path, sheet, header)


# Words of file names by role, the sheet of results and those beside it.
ROLE_WORDS = {"master": ("master",), "historical": ("hist", "template", "db final", "sales db"), "new": ("new", "raw", "input")}
OUTPUT_SHEET = "output data"
AUX_SHEETS = {"quarantined rows", "validation issues", "excluded new rows", "master additions", "master data additions", "run summary"}
READABLE = (".csv", ".tsv", ".txt", ".parquet", *workbooks.READABLE)


def guess_role(name: str) -> str | None:
    low = name.lower()
    return next((role for role, words in ROLE_WORDS.items() if any(w in low for w in words) or (role == "master" and low.startswith("md"))), None)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[dict]:
    """name, path, size and mtime (ms) of what a folder holds, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    rows = [{"name": s.getPath().getName(), "path": s.getPath().toString(), "size": s.getLen(), "mtime": s.getModificationTime()} for s in found or []]
    return sorted(rows, key=lambda r: r["name"])


def resolve_files(spark: SparkSession, folder: str, named: dict[str, str] | None = None, new_file: str | None = None) -> dict[str, str]:
    """Paths by role: new_file, then those named, then by the words of the file names. A
    named file that is missing, or a role without a file, is an error."""
    files = {f["name"]: f["path"] for f in list_files(spark, folder)}
    out: dict[str, str] = {}
    for role, name in {**(named or {}), **({"new": new_file} if new_file else {})}.items():
        if name:
            elsewhere = list_files(spark, *name.rsplit("/", 1)) if "/" in name else []
            if not elsewhere and name not in files:
                raise FileNotFoundError(f"{role}: {name} not found in {folder}")
            out[role] = elsewhere[0]["path"] if elsewhere else files[name]
    for name, path in files.items():
        role = guess_role(name)
        if role and role not in out and name.lower().endswith(READABLE) and not name.startswith("~$"):
            out[role] = path
    missing = [r for r in ("new", "master", "historical") if r not in out]
    if missing:
        raise FileNotFoundError(f"no file for {', '.join(missing)} in {folder}")
    return out


def choose_sheet(spark: SparkSession, path: str, role: str, wanted: str | None = None) -> str | None:
    """The sheet wanted; else the first, or for master and historical the sheet of results,
    or of those that are not written beside it the one with most cells in its first rows."""
    sheets = list_sheets(spark, path)
    if wanted or role == "new" or len(sheets) < 2:
        return wanted or (sheets[0] if sheets else None)
    exact = [s for s in sheets if s.strip().casefold() == OUTPUT_SHEET]
    if exact:
        return exact[0]
    filled = lambda s: sum(v not in (None, "") for _, row in islice(workbooks.sheet_rows(path, s), 30) for v in row)
    return max([s for s in sheets if s.strip().casefold() not in AUX_SHEETS] or sheets, key=filled)
