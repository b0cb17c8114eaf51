"""Shared plumbing: tables, the scratch folder, file systems, text decoding."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa

from ..session import scratch, shared_dir, ship_package, written
from ..session import table as load

__all__ = ["blobs", "file_system", "load", "scratch", "shared_dir", "ship_package", "strings", "written"]


def file_system(uri: str):
    """A pyarrow file system and the path in it, for a local path or a URI such as file: or hdfs:."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column: null is empty, bytes that are not UTF-8 become U+FFFD."""
    try:
        values: Iterable = column.to_pylist()
    except UnicodeDecodeError:
        values = (None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist())
    return ["" if v is None else v for v in values]


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
