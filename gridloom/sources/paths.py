"""Files that Python opens by itself, in tasks of Python data sources."""

from __future__ import annotations

from urllib.parse import unquote

from pyarrow import fs


def arrow_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
