"""Binary files in the shared folder, opened by tasks through pyarrow's file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def create(folder: str, suffix: str):
    """(uri, output stream) of a new file; the random name keeps a retried or speculative task apart."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    return uri, where.open_output_stream(path, compression=None)


def open_random(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def open_stream(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)
