"""Sinks: a dataset a sheet, keyed upsert, append of new dates, status files.

Keyed tables have a commit log (commits.py): half a write is never seen, a job never
overwrites what it reads, of two writers none loses the other's rows, and only files that
hold an incoming key are rewritten.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_date
from ..operators.grid import kinds
from . import commits, workbooks

#: Key columns by preference, when a configuration names none.
DEFAULT_KEYS = (("DATE", "CITY", "SKU STANDARD NAME"), ("UNIQUE ID",), ("ID",))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, path: str) -> int:
    return max(commits.versions(spark, path), default=0)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as it is now, or as of a version; None if there is none."""
    at = commits.snapshot(spark, path, version)
    return commits.frame(spark, path, at) if at.version else None


def write_version(df: DataFrame, path: str) -> int:
    return commits.replace(df, path)


def upsert_partitions(incoming: DataFrame, path: str, keys: list[str], partition: str) -> dict:
    """Upsert into a table whose files are ranged by one of its keys first, so that rows of
    other values of it stay in files that are not touched."""
    if partition not in keys:
        raise ValueError("the partition column must be one of the keys")
    return commits.upsert(incoming, path, keys, partition)


def resolve_keys(columns: list[str], wanted: list[str] | None = None) -> list[str]:
    """All of the wanted columns, else the first default set that is there, else none."""
    lower = {c.strip().lower(): c for c in columns}
    for group in ([wanted] if wanted else []) + [list(k) for k in DEFAULT_KEYS]:
        if all(k.strip().lower() in lower for k in group):
            return [lower[k.strip().lower()] for k in group]
    return []


def upsert_frames(prior: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Prior rows whose key does not come in, and all incoming rows; prior columns first."""
    if not keys:
        return prior.unionByName(incoming, allowMissingColumns=True)
    names = [f"__u{i}" for i in range(len(keys))]
    stay = commits.matched(prior, keys).join(commits.matched(incoming, keys).select(*names).distinct(), names, "left_anti").drop(*names)
    return stay.unionByName(incoming, allowMissingColumns=True)


def upsert(incoming: DataFrame, path: str, key_columns: list[str] | None = None) -> dict:
    """Idempotent: the same rows again change nothing."""
    at = commits.snapshot(incoming.sparkSession, path)
    keys = [k for k in resolve_keys(incoming.columns, key_columns) if at.schema is None or k in at.schema.names]
    return commits.upsert(incoming, path, keys)


def shared_date_column(a: list[str], b: list[str]) -> tuple[str, str] | None:
    """A column called date in both (any case), else one that has date in its name."""
    lower = {c.strip().lower(): c for c in b}
    ranked = sorted((c for c in a if "date" in c.lower() and c.strip().lower() in lower), key=lambda c: c.strip().lower() != "date")
    return (ranked[0], lower[ranked[0].strip().lower()]) if ranked else None


def append_new_dates(prior: DataFrame, incoming: DataFrame, skip_existing_dates: bool = True) -> DataFrame:
    """Prior rows and the incoming rows of dates that prior does not have. Columns meet
    by name in any case; new ones come last."""
    lower = {c.strip().lower(): c for c in prior.columns}
    incoming = incoming.toDF(*[lower.get(c.strip().lower(), c) for c in incoming.columns])
    both = shared_date_column(incoming.columns, prior.columns)
    if both and skip_existing_dates:
        day = lambda df, c: norm_date(F.col(f"`{c}`"), kinds(df)[c])
        old = prior.select(day(prior, both[1]).alias("__day")).filter("__day is not null").distinct()
        incoming = incoming.withColumn("__day", day(incoming, both[0])).join(old, "__day", "left_anti").drop("__day")
    return prior.unionByName(incoming, allowMissingColumns=True)


def template_columns(df: DataFrame, template: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in template])


def display(df: DataFrame) -> DataFrame:
    """Cells as a report shows them: NaN and infinities as null, times at midnight as days."""
    def cell(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        if kind in ("timestamp", "timestamp_ntz"):
            return F.when(x == F.date_trunc("day", x), F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "yyyy-MM-dd HH:mm:ss"))
        return F.date_format(x, "yyyy-MM-dd") if kind == "date" else x

    return df.select(*[cell(f.name, f.dataType.typeName()).alias(f.name) for f in df.schema])


def sheet_name(name: str) -> str:
    return "".join("_" if ch in "[]:*?/\\" else ch for ch in name).strip()[:31] or "Sheet"


def write_sheets(sheets: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """A dataset a sheet below folder; fmt xlsx: one workbook, folder/workbook.xlsx."""
    if fmt == "xlsx":
        path = workbooks.write_workbook({sheet_name(n): df for n, df in sheets.items()}, f"{folder}/workbook.xlsx")
        return dict.fromkeys(sheets, path)
    out = {}
    for name, df in sheets.items():
        out[name] = f"{folder}/{sheet_name(name)}"
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(out[name]) if fmt == "csv" else writer.parquet(out[name])
    return out


def write_status(spark: SparkSession, path: str, status: dict) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(status, default=str, indent=1).encode()))
    stream.close()


def summary(spark: SparkSession, items: dict) -> DataFrame:
    return spark.createDataFrame([(str(k), str(v)) for k, v in items.items()], "Item string, Detail string")


def union_missing(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
