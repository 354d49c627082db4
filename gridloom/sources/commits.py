"""Keyed tables with a commit log.

A table is a folder of data files and a log of numbered commits. A commit names the version
it was made from and the files that it adds and removes, so a table is the files that its
commits leave. Files are written first, under names of their own, and the commit last, by
a rename onto a number that must be free: a reader never sees half a write, a writer that
stops leaves the table as it was, and of two writers from one version the second gets a
Conflict and plans again on what the first has left.

Each file carries the range of its match keys. An upsert reads the key columns of the files
whose ranges can meet the incoming keys, rewrites the files that hold one of them and
leaves all others untouched. Written rows are ranged by their keys, so that ranges are narrow.

The log has one entry a data file, and every FULL_EVERY commits the whole list; lists of
files are all that reaches the driver. The schema is the log's, nothing is inferred from
folder names: a text key 007 stays text, and a null key is equal to a null key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key
from ..operators.grid import kinds
from ..scratch import discard, materialise

LOG = "_log"
FULL_EVERY, ATTEMPTS = 20, 50


class Conflict(RuntimeError):
    """The version to be written is there already."""


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    schema: T.StructType | None = None
    #: By path within the table: rows, and for each key column the lowest and highest key.
    files: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Change:
    """What a writer has ready: files to add and names to remove, made from a version."""

    base: int
    schema: T.StructType
    add: dict[str, dict]
    remove: tuple[str, ...]
    rewritten: int = 0


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict:
    fs, p = filesystem(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: dict) -> None:
    """The file appears whole or not at all, and never over another."""
    fs, p = filesystem(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, p, options)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(p):
            raise Conflict(path) from e
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = filesystem(spark, f"{path}/{LOG}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The table as of a version, else as it is now; version 0 has no schema and no files."""
    known = [v for v in versions(spark, path) if version is None or v <= version]
    if version is not None and version not in [0, *known]:
        raise ValueError(f"{path} has no version {version}")
    commits: list[dict] = []
    for v in reversed(known):
        commits.append(_read(spark, f"{path}/{LOG}/{v:010d}.json"))
        if commits[-1]["files"] is not None:
            break
    files: dict[str, dict] = {}
    for c in reversed(commits):
        files = dict(c["files"]) if c["files"] is not None else {n: f for n, f in files.items() if n not in set(c["remove"])} | c["add"]
    return Snapshot(known[-1], T.StructType.fromJson(commits[0]["schema"]), files) if commits else Snapshot()


def frame(spark: SparkSession, path: str, at: Snapshot, names: Iterable[str] | None = None) -> DataFrame:
    """The rows of a snapshot, or of some of its files."""
    wanted = at.files if names is None else names
    paths = [f"{path}/{n}" for n in wanted]
    return spark.read.schema(at.schema).parquet(*paths) if paths else spark.createDataFrame([], at.schema)


def commit(spark: SparkSession, path: str, change: Change) -> int:
    """Makes the change the next version, or raises Conflict."""
    version = change.base + 1
    content = {"version": version, "base": change.base, "schema": change.schema.jsonValue(), "add": change.add, "remove": list(change.remove), "files": None}
    if version == 1 or version % FULL_EVERY == 0:
        left = snapshot(spark, path, change.base).files if change.base else {}
        content["files"] = {n: f for n, f in left.items() if n not in set(change.remove)} | change.add
    _create(spark, f"{path}/{LOG}/{version:010d}.json", content)
    return version


def matched(df: DataFrame, keys: list[str]) -> DataFrame:
    """With the match keys of the key columns; null is the empty key."""
    by = kinds(df)
    return df.withColumns({f"__u{i}": key(F.col(f"`{k}`"), by[k]) for i, k in enumerate(keys)})


def _ranges(keys: list[str]) -> list:
    return [g(f"__u{i}").alias(f"{n}{i}") for i in range(len(keys)) for n, g in (("low", F.min), ("high", F.max))]


def _bounds(row, keys: list[str]) -> dict[str, list[str]]:
    return {k: [row[f"low{i}"], row[f"high{i}"]] for i, k in enumerate(keys)}


def _file():
    """The path of a row's file within the table."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"(data-[0-9a-f]{32}/.*)$", 1).alias("__file")


def write_files(df: DataFrame, path: str, schema: T.StructType, keys: list[str], first: str | None = None) -> dict[str, dict]:
    """New data files, ranged by first, then the keys; their entries for a commit. Rows of
    two values of first share no file."""
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    order = [F.col(f"`{c}`") for c in dict.fromkeys([*([first] if first else []), *keys])]
    out = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    out = out.repartitionByRange(*order) if order else out
    if first:
        value = F.hex(F.xxhash64(key(F.col(f"`{first}`"), kinds(out)[first])))
        out.withColumn("__part", value).write.partitionBy("__part").parquet(f"{path}/{folder}")
    else:
        out.write.parquet(f"{path}/{folder}")
    written = spark.read.schema(schema).parquet(f"{path}/{folder}").select(*[F.col(f"`{k}`") for k in keys], _file())
    stats = matched(written, keys).groupBy("__file").agg(F.count("*").alias("rows"), *_ranges(keys)).collect()
    return {r["__file"]: {"rows": r["rows"], "keys": _bounds(r, keys)} for r in stats}


_WIDTH = {"byte": 0, "short": 1, "integer": 2, "long": 3}


def _common(name: str, table: T.DataType, incoming: T.DataType) -> T.DataType:
    """The type that holds both without loss and that written files can be read as."""
    a, b = table.typeName(), incoming.typeName()
    if table == incoming or b == "void" or a == "string" or (a == "double" and b in ("float", "byte", "short", "integer")):
        return table
    if a in _WIDTH and b in _WIDTH:
        return table if _WIDTH[a] >= _WIDTH[b] else incoming
    if b == "double" and a in ("byte", "short", "integer", "float"):
        return incoming
    raise ValueError(f"column {name} of the table is {table.simpleString()}, {incoming.simpleString()} comes in")


def merged(table: T.StructType | None, incoming: T.StructType) -> T.StructType:
    """The table's columns, then new ones; all may be null."""
    own = {f.name: f.dataType for f in table} if table else {}
    came = {f.name: f.dataType for f in incoming}
    types = {n: _common(n, t, came[n]) if n in came else t for n, t in own.items()} | {n: t for n, t in came.items() if n not in own}
    return T.StructType([T.StructField(n, T.StringType() if t.typeName() == "void" else t) for n, t in types.items()])


def _fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def touched(spark: SparkSession, path: str, at: Snapshot, incoming: DataFrame, keys: list[str]) -> list[str]:
    """The files that hold a key of incoming: ranges first, then the key columns of those
    that may. incoming has the match keys."""
    span = incoming.agg(*_ranges(keys)).first()
    if span["low0"] is None:
        return []
    mine = _bounds(span, keys)
    meets = lambda f: all(k not in f["keys"] or (f["keys"][k][0] <= high and low <= f["keys"][k][1]) for k, (low, high) in mine.items())
    maybe = [n for n, f in at.files.items() if meets(f)]
    if not maybe:
        return []
    rows = frame(spark, path, at, maybe).select(*[F.col(f"`{k}`") for k in keys], _file())
    names = [f"__u{i}" for i in range(len(keys))]
    hit = matched(rows, keys).join(incoming.select(*names).distinct(), names, "left_semi").select("__file").distinct()
    return sorted(r[0] for r in hit.collect())


def plan_upsert(incoming: DataFrame, path: str, keys: list[str], first: str | None = None, before: Change | None = None) -> Change:
    """Writes the files of an upsert onto the table as it is now; commit() makes them count.
    before: an earlier plan that met a Conflict; its files are used again if the rows that
    they replace are the same."""
    spark = incoming.sparkSession
    at = snapshot(spark, path)
    schema = merged(at.schema, incoming.schema)
    keys = [k for k in keys if at.schema is None or k in at.schema.names]
    if not keys:
        add = write_files(_fitted(incoming, schema), path, schema, [], first)
        return Change(at.version, schema, add, ())
    marked = matched(_fitted(incoming, schema), keys)
    names = [f"__u{i}" for i in range(len(keys))]
    gone = touched(spark, path, at, marked, keys)
    if before is not None and tuple(gone) == before.remove and schema == before.schema:
        return Change(at.version, schema, before.add, before.remove, before.rewritten)
    out = marked.drop(*names)
    if gone:
        old = matched(_fitted(frame(spark, path, at, gone), schema), keys)
        out = old.join(marked.select(*names).distinct(), names, "left_anti").drop(*names).unionByName(out)
    add = write_files(out, path, schema, keys, first)
    return Change(at.version, schema, add, tuple(gone), sum(at.files[n]["rows"] for n in gone))


def upsert(incoming: DataFrame, path: str, keys: list[str], first: str | None = None) -> dict:
    """Rows of incoming replace those of equal keys; the same rows again change nothing.
    Without keys they are added. Commits of others in between are kept."""
    spark = incoming.sparkSession
    came, change = materialise(incoming, "upsert-in"), None
    try:
        for _ in range(ATTEMPTS):
            change = plan_upsert(came, path, keys, first, change)
            try:
                return {"version": commit(spark, path, change), "keys": list(keys), "files_added": len(change.add), "files_removed": len(change.remove), "rows_rewritten": change.rewritten}
            except Conflict:
                continue
        raise Conflict(f"{path}: {ATTEMPTS} commits of others came first")
    finally:
        discard(came)


def replace(df: DataFrame, path: str) -> int:
    """The table becomes df, whatever it was."""
    spark = df.sparkSession
    schema = merged(None, df.schema)
    add = write_files(_fitted(df, schema), path, schema, [])
    while True:
        at = snapshot(spark, path)
        try:
            return commit(spark, path, Change(at.version, schema, add, tuple(at.files)))
        except Conflict:
            continue


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 3600.0) -> int:
    """Deletes data folders that none of the last versions uses and that are older than so
    many seconds (a writer may be about to commit younger ones). The number of folders."""
    last = versions(spark, path)[-keep:]
    used = {n.split("/")[0] for v in last for n in snapshot(spark, path, v).files}
    fs, p = filesystem(spark, path)
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used and s.getModificationTime() <= (time.time() - older_than) * 1000]
    for folder in old:
        fs.delete(folder, True)
    return len(old)
