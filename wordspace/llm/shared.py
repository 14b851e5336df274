"""Binary files in the folder that all tasks share.

Tasks write a file whole under a name of their own attempt and then rename it, so a
retried or doubled task leaves the same bytes. A folder given as a path or ``file:`` URI
is reached directly; others go through ``pyarrow.fs``, and a file to be mapped is then
copied into an unlinked temporary file first.
"""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs as fs


def local_path(uri: str) -> str | None:
    """The plain path of a folder every machine mounts, None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    path = local_path(uri)
    return (fs.LocalFileSystem(), path) if path is not None else fs.FileSystem.from_uri(uri)


def write_file(uri: str, chunks) -> int:
    """Write the byte chunks as one file; returns its length."""
    store, path = _resolve(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, path)
    return size


def write_array(uri: str, values: np.ndarray) -> None:
    write_file(uri, [memoryview(np.ascontiguousarray(values)).cast("B")] if values.size else [])


def map_array(uri: str, dtype) -> np.ndarray:
    """A file as a read-only array whose pages are read as they are touched."""
    path = local_path(uri)
    if path is None:
        store, far = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as copy, store.open_input_stream(far) as source:
            while piece := source.read(1 << 24):
                copy.write(piece)
            copy.flush()
            return _mapped(copy, dtype)
    with open(path, "rb") as source:
        return _mapped(source, dtype)


def _mapped(source, dtype) -> np.ndarray:
    if not os.fstat(source.fileno()).st_size:
        return np.empty(0, dtype)
    return np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ), dtype)


def open_output(uri: str):
    """A new file open for writing; its name has to be of this attempt."""
    store, path = _resolve(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_file(uri: str):
    """A file open for reading at any offset."""
    store, path = _resolve(uri)
    return store.open_input_file(path)
