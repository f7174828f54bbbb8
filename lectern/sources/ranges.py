"""Reads of byte ranges: files are opened where they lie and only the bytes asked for are fetched."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def opened(path: str) -> Iterator:
    """A seekable file of any file system that Arrow knows, by the path that Spark gives."""
    uri = re.sub(r"^file:/+", "file:///", path)
    system, name = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
    with system.open_input_file(name) as file:
        yield file


def read_at(file, at: int, size: int) -> bytes:
    """At most ``size`` bytes from ``at``; fewer where the file ends."""
    return file.read_at(size, at) if at < file.size() else b""
