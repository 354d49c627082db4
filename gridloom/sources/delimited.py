"""Records of delimited text, read in splits whatever its cells hold.

A line break may stand inside a quoted cell, so whether a line starts a record depends on all
lines before it. Each split tells, for a start outside and one inside a quoted cell, whether
it ends inside; these small functions compose along a file, which gives the state at each
split's start. The records are then parsed within the splits, in one narrow pass, and only
those that cross a split's border are put together from their pieces. No file is read whole
by one task, and lines keep their order without a sort.

Quotes count where the format gives them a meaning: a cell is quoted if it starts with a
quote, and two quotes within it are one; a quote elsewhere (5" pipe) is a plain character.

Edge cases: blank lines are no records; a record of fewer cells than the header is filled
with nulls, and empty cells beyond the header are dropped; other cells beyond it, bytes that
are not in the encoding and a quote that is never closed make the record a problem, kept with
its text beside the good ones. A byte order mark is not part of the text and names the
encoding. Line breaks within cells become a single line feed.
"""

from __future__ import annotations

import csv
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import discard, materialise

_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
PARSED = "file string, start bigint, n bigint, kind int, closed boolean, problem string, raw string, cells array<string>"


def open_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open at the end of a line."""
    at = 0
    if not inside and line.startswith('"'):
        at, inside = 1, True
    while True:
        if not inside:
            # The next cell that starts with a quote.
            found = line.find(f'{sep}"', at)
            if found < 0:
                return False
            at = found + len(sep) + 1
        close = _CLOSE.match(line, at)
        if not close:
            return True
        # What follows the closing quote belongs to the cell, up to the separator.
        at, inside = line.find(sep, close.end()), False
        if at < 0:
            return False


def cells(record: str, sep: str) -> list[str]:
    csv.field_size_limit(2**31 - 1)
    return next(csv.reader([record], delimiter=sep))


def encoding_of(first: bytes) -> str | None:
    return next((name for mark, name in MARKS if first.startswith(mark)), None)


def lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(value, file, start): lines as bytes, with their file and the place of their split."""
    reader = spark.read
    if encoding.startswith("utf-16"):
        reader = reader.option("encoding", encoding.upper().replace("UTF-16-", "UTF-16")).option("lineSep", "\n")
    return reader.text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _decoded(value: bytes, encoding: str, first: bool) -> tuple[str, str | None]:
    if first:
        value = next((value[len(m) :] for m, _ in MARKS if value.startswith(m)), value)
    try:
        return bytes(value).decode(encoding).removesuffix("\r"), None
    except UnicodeDecodeError:
        return bytes(value).decode(encoding, "backslashreplace").removesuffix("\r"), f"bytes that are not {encoding}"


def _ends(sep: str, encoding: str) -> Callable:
    """For each split with quotes: is a cell open at its end, if none was open at its start
    (o), and if one was (i)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list] = []
        for batch in batches:
            for value, file, start in zip(batch["value"], batch["file"], batch["start"]):
                if not out or out[-1][:2] != [file, start]:
                    out.append([file, start, False, True])
                line = _decoded(value, encoding, False)[0]
                o, i = out[-1][2:]
                after = open_after(line, o, sep)
                out[-1][2:] = [after, after if o == i else open_after(line, i, sep)]
        yield pd.DataFrame(out, columns=["file", "start", "o", "i"])

    return run


def borders(spark: SparkSession, path: str, sep: str, encoding: str) -> dict[str, list[tuple[int, bool]]]:
    """By file, the splits after which the state is another than before them: no more than
    there are borders of splits in quoted cells, and two each."""
    quoted = lines(spark, path, encoding).filter(F.contains("value", F.lit(b'"')))
    ends = quoted.mapInPandas(_ends(sep, encoding), "file string, start bigint, o boolean, i boolean")
    listed = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "o", "i"))).alias("e"))
    none = F.array().cast("array<struct<start:bigint,inside:boolean>>")

    def step(acc, x):
        after = F.when(acc["inside"], x["i"]).otherwise(x["o"])
        point = F.array(F.struct(x["start"].alias("start"), after.alias("inside")))
        return F.struct(after.alias("inside"), F.when(after == acc["inside"], acc["points"]).otherwise(F.concat(acc["points"], point)).alias("points"))

    folded = F.aggregate("e", F.struct(F.lit(False).alias("inside"), none.alias("points")), step)
    rows = listed.select("file", F.explode(folded["points"]).alias("p")).select("file", "p.*").collect()
    out: dict[str, list[tuple[int, bool]]] = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        out.setdefault(r["file"], []).append((r["start"], r["inside"]))
    return out


def _parse(sep: str, encoding: str, changes: dict[str, list[tuple[int, bool]]]) -> Callable:
    """The records of each split (kind 0), and the piece of a record that it leaves open
    (kind 1) or goes on with (kind 2)."""

    def inside_at(file: str, start: int) -> bool:
        known = changes.get(file, [])
        i = bisect_left(known, (start,))
        return known[i - 1][1] if i else False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, n, inside, goes_on, part, problem = None, 0, False, False, [], None

        def piece(closed: bool):
            return (*split, n, 2 if goes_on else 1, closed, problem, "\n".join(part), None)

        for batch in batches:
            out: list[tuple] = []
            for value, file, start in zip(batch["value"], batch["file"], batch["start"]):
                first = split != (file, start)
                if first:
                    if part:
                        out.append(piece(False))
                    split, n, part, problem = (file, start), 0, [], None
                    goes_on = inside = inside_at(file, start)
                line, wrong = _decoded(value, encoding, first and start == 0)
                if not part and not goes_on and line == "":
                    continue
                part.append(line)
                problem = problem or wrong
                inside = open_after(line, inside, sep) if inside or '"' in line else False
                if inside:
                    continue
                if goes_on:
                    out.append(piece(True))
                else:
                    record = "\n".join(part)
                    out.append((*split, n, 0, True, problem, record if problem else None, cells(record, sep)))
                    n += 1
                part, goes_on, problem = [], False, None
            yield pd.DataFrame(out, columns=["file", "start", "n", "kind", "closed", "problem", "raw", "cells"])
        if part:
            yield pd.DataFrame([piece(False)], columns=["file", "start", "n", "kind", "closed", "problem", "raw", "cells"])

    return run


def _joined(pieces: DataFrame, sep: str) -> DataFrame:
    """Records from their pieces: each opens one, and those that follow go on with it."""
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == 1).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", (-F.col("kind")).alias("o"), "raw", "n")))
    whole = numbered.groupBy("file", "record").agg(parts.alias("p"), F.max((F.col("kind") == 2) & F.col("closed")).alias("closed"), F.max("problem").alias("problem"))
    flat = whole.select("file", F.element_at("p", 1)["start"].alias("start"), F.element_at("p", 1)["n"].alias("n"), "closed", F.coalesce("problem", F.when(~F.col("closed"), F.lit("a quote that is not closed"))).alias("problem"), F.array_join(F.transform("p", lambda x: x["raw"]), "\n").alias("raw"))

    @F.pandas_udf("array<string>")
    def split(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: cells(r, sep))

    return flat.select("file", "start", "n", F.lit(0).alias("kind"), "closed", "problem", "raw", split("raw").alias("cells"))


def parse(spark: SparkSession, path: str, sep: str, encoding: str = "utf-8") -> DataFrame:
    """A row for each record, as PARSED says: its cells, and its problem, if it has one, with
    its text. n numbers the records of a split; the first split of a file starts at 0."""
    changes = borders(spark, path, sep, encoding)
    rows = materialise(lines(spark, path, encoding).mapInPandas(_parse(sep, encoding, changes), PARSED), "text-records")
    pieces = rows.filter("kind > 0")
    if pieces.isEmpty():
        return rows
    joined = materialise(rows.filter("kind = 0").unionByName(_joined(pieces, sep)), "text-records")
    discard(rows)
    return joined


def checked(records: DataFrame, width: int) -> DataFrame:
    """With the problem of cells beyond the header."""
    more = F.exists(F.slice("cells", width + 1, F.greatest(F.size("cells"), F.lit(1))), lambda c: c != "")
    return records.withColumn("problem", F.coalesce("problem", F.when(more, F.lit("more cells than the header"))))
