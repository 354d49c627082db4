"""Arriving files: each new file goes through the plan, its clean rows into the table.

watch() is a stream: the file source with a checkpoint delivers each landed file at least
once, and the keyed upsert makes a repeated delivery harmless. Files land by
write-then-rename. The file source does not see a file that is written again under its
name; poll() does, by path, size and time, and marks a file as done even if its run fails.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.batch import load, read_status
from ..plans.pipeline import Inputs, build_output, with_row_id
from ..sources import sinks, tables
from .changes import FileChanges


def process(new: DataFrame, master: DataFrame, historical: DataFrame, config: dict, path: str, key_columns: list[str] | None = None, **options) -> dict:
    return load(build_output(Inputs(new, master, historical), config), path, key_columns, **options)


def watch(
    spark: SparkSession, folder: str, schema: StructType, master: DataFrame, historical: DataFrame, config: dict, path: str, checkpoint: str,
    key_columns: list[str] | None = None, glob: str = "*", fmt: str = "parquet", interval: str | None = None, archive: str | None = None, report: Callable[[int, dict], None] | None = None,
    files: int = 1, quarantine: str | None = None, partition: str | None = None,
) -> StreamingQuery:
    """Without an interval it takes what is there and stops. files: how many a batch takes.
    quarantine: the folder for each batch's sheets, quarantined rows among them."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    if archive:
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    # The tables that do not arrive are numbered once, not for every batch.
    master, historical = with_row_id(master), with_row_id(historical)

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            got = process(batch, master, historical, config, path, key_columns, sheets=f"{quarantine}/batch_{number}" if quarantine else None, partition=partition)
            if report:
                report(number, got)

    writer = stream.format(fmt).load(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def follow(
    spark: SparkSession, folder: str, run: Callable[[dict], dict], checkpoint: str, pattern: str = "*", exclude: tuple[str, ...] = (), stable_seconds: float = 5.0,
    interval: str | None = None, report: Callable[[dict, dict], None] | None = None,
) -> StreamingQuery:
    """run gets path, name, size, mtime and entry of every version of a file, in the order
    of their times. A version counts as done when its batch is; if run raises, the query
    stops, and the next start goes on with the same versions."""
    spark.dataSource.register(FileChanges)
    options = {"folder": folder, "log": f"{checkpoint}/changes", "pattern": pattern, "exclude": "|".join(exclude), "stable_seconds": str(stable_seconds)}

    def each(batch: DataFrame, number: int) -> None:
        # One small row for each changed file.
        for event in sorted((r.asDict() for r in batch.collect()), key=lambda e: (e["entry"], e["mtime"], e["path"])):
            got = run(event)
            if report:
                report(event, got)

    writer = spark.readStream.format("file_changes").options(**options).load().writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/query")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def newest(spark: SparkSession, folder: str, glob: str = "*", exclude: tuple[str, ...] = ()) -> dict | None:
    """The file that changed last, without those that are named and a job's own."""
    found = [f for f in tables.list_files(spark, folder, glob) if f["name"] not in exclude and not f["name"].startswith(("_", ".", "~$"))]
    return max(found, key=lambda f: (f["mtime"], f["name"]), default=None)


def poll(spark: SparkSession, folder: str, state: str, run: Callable[[str], dict], glob: str = "*", exclude: tuple[str, ...] = (), stable_seconds: float = 5.0, archive: str | None = None) -> dict | None:
    """One look at the folder: if its newest file is another than the state's last, by
    path, size and time, and does not change while we wait, run gets its path. None if
    there was nothing to do. The file counts as processed even if run raises."""
    seen = newest(spark, folder, glob, exclude)
    known = (read_status(spark, state) or {}).get("last") or {}
    same = lambda a, b: all(a.get(k) == b.get(k) for k in ("path", "size", "mtime"))
    if not seen or same(seen, known):
        return None
    time.sleep(stable_seconds)
    if not same(seen, newest(spark, folder, glob, exclude) or {}):
        return None
    out: dict = {"error": "not finished"}
    try:
        out = run(seen["path"])
        return out
    finally:
        sinks.write_status(spark, state, {"last": seen | {"outcome": out}})
        if archive:
            fs, source = sinks._fs(spark, seen["path"])
            target = sinks._fs(spark, f"{archive}/{seen['mtime']}__{seen['name']}")[1]
            fs.mkdirs(target.getParent())
            fs.rename(source, target)
