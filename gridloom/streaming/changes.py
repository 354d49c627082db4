"""A stream of file changes: each version of a file, by path, size and time, comes once.

Spark's file source knows a file by its path and never sees it written again. Here an offset
is the number of an entry in a log that the source keeps beside the checkpoint: a look
at the folder compares all its files with what the log knows, and whatever is new or has
another size or time makes the next entry. So files that land together come together, a file
that is overwritten comes again, and a restart goes on from the checkpoint's offset with
the entries as they were written. Every FULL_EVERY entries one holds all that is known,
which bounds what a start has to read.

Edge cases: an empty or missing folder has no entries; a file that changed less than
stable_seconds ago waits for a later look; a file that goes away stays known, so the same
bytes under the same time do not come again; names that start with _, . or ~$ are a job's own.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import time
from collections.abc import Iterator

from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.paths import arrow_fs

FULL_EVERY = 50
#: Events of a partition of a batch.
EVENTS = 1000
SCHEMA = "path string, name string, size bigint, mtime bigint, entry bigint"


def _open(folder: str) -> tuple[files.FileSystem, str]:
    fs, path = arrow_fs(folder)
    return fs, path.rstrip("/")


class Log:
    """Numbered entries, each written once: {"changed": [[path, size, mtime], ...], "known"}."""

    def __init__(self, folder: str):
        self.fs, self.path = _open(folder)

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(files.FileSelector(self.path, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def read(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.path}/{number:010d}.json") as stream:
            return json.loads(stream.readall())

    def known(self) -> tuple[int, dict[str, list[int]]]:
        """The last entry's number, and size and time of every file up to it."""
        numbers, later = self.numbers(), []
        known: dict[str, list[int]] = {}
        for n in reversed(numbers):
            entry = self.read(n)
            if entry["known"] is not None:
                known = entry["known"]
                break
            later.append(entry)
        for entry in reversed(later):
            known |= {p: [size, mtime] for p, size, mtime in entry["changed"]}
        return (numbers[-1] if numbers else 0), known

    def append(self, number: int, changed: list[list], known: dict[str, list[int]]) -> None:
        self.fs.create_dir(self.path, recursive=True)
        aside = f"{self.path}/.{number}.part"
        with self.fs.open_output_stream(aside) as stream:
            stream.write(json.dumps({"changed": changed, "known": known if number % FULL_EVERY == 0 else None}).encode())
        self.fs.move(aside, f"{self.path}/{number:010d}.json")


def listing(folder: str, pattern: str, exclude: set[str], stable_seconds: float, now: float) -> list[list]:
    """(path, size, mtime in ms) of the files that count and no longer change, by time."""
    fs, path = _open(folder)
    found = fs.get_file_info(files.FileSelector(path, allow_not_found=True))
    out = []
    for f in found:
        name = posixpath.basename(f.path)
        if f.type != files.FileType.File or name.startswith(("_", ".", "~$")) or name in exclude or not fnmatch.fnmatch(name, pattern):
            continue
        mtime = f.mtime_ns // 1_000_000
        if mtime <= (now - stable_seconds) * 1000:
            out.append([f.path, f.size, mtime])
    return sorted(out, key=lambda r: (r[2], r[0]))


class Events(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.log = options, Log(options["log"])

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        number, known = self.log.known()
        o = self.options
        seen = listing(o["folder"], o.get("pattern", "*"), set(filter(None, o.get("exclude", "").split("|"))), float(o.get("stable_seconds", "5")), time.time())
        changed = [r for r in seen if known.get(r[0]) != r[1:]]
        if changed:
            number += 1
            self.log.append(number, changed, known | {p: [size, mtime] for p, size, mtime in changed})
        return {"entry": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [(p, posixpath.basename(p), size, mtime, n) for n in range(start["entry"] + 1, end["entry"] + 1) for p, size, mtime in self.log.read(n)["changed"]]
        return [Events(rows[i : i + EVENTS]) for i in range(0, len(rows), EVENTS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass


class FileChanges(DataSource):
    """Options: folder, log, pattern, exclude (names, parted by |), stable_seconds."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(dict(self.options))
