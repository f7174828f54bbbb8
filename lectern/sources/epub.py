"""EPUB containers to blocks: one container per row, chapters streamed in spine order."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from .html import BLOCK_COLUMNS, blocks_of, frames

CONTAINER = "META-INF/container.xml"
COLUMNS = ["ord", "type", "level", "content", "metadata", "failure"]


class BadContainer(ValueError):
    pass


def _elements(xml: bytes, name: str):
    return [e for e in ElementTree.fromstring(xml).iter() if str(e.tag).rsplit("}", 1)[-1] == name]


def _entry(archive: zipfile.ZipFile, path: str) -> bytes | None:
    wanted = path.replace("\\", "/").lower()
    for name in archive.namelist():
        found = name.replace("\\", "/").lower()
        if not name.endswith("/") and (found == wanted or found.endswith("/" + wanted)):
            return archive.read(name)
    return None


def _chapters(archive: zipfile.ZipFile) -> tuple[str | None, Iterator[str]]:
    """The book title and the chapter sources in reading order."""
    container = _entry(archive, CONTAINER)
    if container is None:
        raise BadContainer("no_container")
    roots = _elements(container, "rootfile")
    root = roots[0].get("full-path") if roots else None
    if root is None:
        raise BadContainer("no_rootfile")
    package = _entry(archive, root)
    if package is None:
        raise BadContainer("no_package")
    base = root.rpartition("/")[0]
    hrefs = {
        e.get("id"): e.get("href")
        for e in _elements(package, "item")
        if e.get("id") and e.get("href") and "html" in (e.get("media-type") or "")
    }
    spine = [
        e.get("idref")
        for e in _elements(package, "itemref")
        if (e.get("linear") or "").lower() != "no" and e.get("idref")
    ]
    if not spine:
        raise BadContainer("empty_spine")
    titles = ("".join(e.itertext()).strip() for e in _elements(package, "title"))

    def sources():
        for idref in spine:
            if idref not in hrefs:
                continue
            clean = hrefs[idref].split("#")[0]
            path = clean[1:] if clean.startswith("/") else f"{base}/{clean}" if base else clean
            data = _entry(archive, path)
            if data is not None:
                yield data.decode("utf-8", "replace")

    return next((t for t in titles if t), None), sources()


def _rows(content: bytes) -> list[tuple]:
    """All blocks of a book, or one failure row; no input ends the job."""
    rows: list[tuple] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            title, sources = _chapters(archive)
            for source in sources:
                # The book title stands in only until the first block has been produced.
                for row in blocks_of(source, title if not rows else None):
                    rows.append((len(rows), *row, None))
    except BadContainer as reason:
        failure = str(reason)
    except (zipfile.BadZipFile, zlib.error, struct.error, ElementTree.ParseError, EOFError, LookupError, ValueError, OSError,
            NotImplementedError):
        failure = "damaged"
    except RuntimeError:  # zipfile's error for an entry that needs a password
        failure = "encrypted_document"
    else:
        failure = None if rows else "no_text"
    return rows if failure is None else [(None, None, None, None, None, failure)]


def epub_to_blocks(files: DataFrame, id: str = "document_id", content: str = "content") -> DataFrame:
    """Blocks of every container with a gapless order; a bad container is one row with ``failure``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((key, *row) for key, data in zip(batch[id], batch[content]) for row in _rows(bytes(data or b"")))
            for out in frames(rows, [id, *COLUMNS]):
                yield out.astype({"ord": "Int32", "level": "Int32"})

    key = files.schema[id].dataType.simpleString()
    return files.select(id, content).mapInPandas(
        parse, f"{id} {key}, ord int, {BLOCK_COLUMNS}, failure string"
    )
