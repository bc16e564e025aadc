"""Whole files in the shared folder, from the driver and from executors' Python.

``file:`` paths are opened directly; other schemes go through pyarrow's file systems (hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def _open(uri: str):
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path) if parts.scheme else uri
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own and rename: a retried or doubled task leaves one whole file."""
    fs, path = _open(uri)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    if fs is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
        return
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    fs.move(temporary, path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = _open(uri)
    if fs is None:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length)


def read_file(uri: str) -> bytes:
    fs, path = _open(uri)
    if fs is None:
        with open(path, "rb") as f:
            return f.read()
    with fs.open_input_file(path) as f:
        return f.read()
