"""Inventory of WAV files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from .files import _le
from .ranges import opened, read_at

FIELDS = "audio_format int, channels int, sample_rate bigint, bits int, data_bytes bigint, reason string"
NAMES = ["audio_format", "channels", "sample_rate", "bits", "data_bytes", "reason"]


def _walk(read: Callable[[int, int], bytes], length: int) -> tuple:
    """Format fields and sample bytes of one file, or the reason there are none.

    ``read(at, size)`` is asked for the heads of chunks and the format only, never for samples.
    """
    if length < 44:
        return (None,) * 5 + ("too_short",)
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return (None,) * 5 + ("not_wav",)
    fmt, size, at = None, None, 12
    while at + 8 <= length:
        name, declared = struct.unpack("<4sI", read(at, 8))
        body = at + 8
        if name == b"fmt ":
            if declared < 16 or body + 16 > length:
                return (None,) * 5 + ("bad_format",)
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(body, 16))
            fmt = (kind, channels, rate, bits)
        elif name == b"data":
            if body + declared > length:
                return (None,) * 5 + ("truncated",)
            size = declared
        at = body + declared + declared % 2
    if fmt is None:
        return (None,) * 5 + ("no_format",)
    return (*fmt, size, "no_data" if size is None else None)


def wav_inventory(files: DataFrame, id: str = "path") -> DataFrame:
    """Format, sample bytes, duration and rejection reason of every file.

    Files laid out as header, format, samples are read by expressions over their first 44
    bytes; only files with other chunks are handed to the walker.
    """
    text = lambda head, at: F.hex(F.substring(head, at + 1, 4))

    def header(start):
        head, size, data = start["head"], start["size"], _le(start["head"], 40, 4)
        simple = (
            (size >= 44) & (text(head, 0) == "52494646") & (text(head, 8) == "57415645")
            & (text(head, 12) == "666D7420") & (_le(head, 16, 4) == 16) & (text(head, 36) == "64617461")
            & (F.lit(44) + data <= size) & (size - 44 - data - data % 2 < 8)
        )
        return F.struct(
            F.coalesce(simple, F.lit(False)).alias("simple"),
            _le(head, 20, 2).cast("int").alias("audio_format"),
            _le(head, 22, 2).cast("int").alias("channels"),
            _le(head, 24, 4).alias("sample_rate"),
            _le(head, 34, 2).cast("int").alias("bits"),
            data.alias("data_bytes"),
        )

    start = F.struct(F.substring("content", 1, 44).alias("head"), F.length("content").alias("size"))
    marked = files.select(id, "content", bind(start, header).alias("_h"))
    direct = marked.filter("_h.simple").select(
        id, *[F.col(f"_h.{n}").alias(n) for n in NAMES[:5]], F.lit(None).cast("string").alias("reason")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *_walk(lambda at, size: bytes(data[at : at + size]), len(data))) for key, data in zip(batch[id], batch["content"])]
            yield pd.DataFrame(rows, columns=[id, *NAMES]).astype({n: "Int64" for n in NAMES[:5]})

    key = files.schema[id].dataType.simpleString()
    other = marked.filter("not _h.simple").select(id, "content").mapInPandas(walk, f"{id} {key}, {FIELDS}")
    return _judged(direct.unionByName(other))


def wav_headers(files: DataFrame) -> DataFrame:
    """The same rows for files named by ``path`` and ``length``, whose contents are not loaded.

    Every file is opened in its task and followed from chunk to chunk, so a file of any size costs the bytes of its chunk heads.
    A file that can't be opened has the reason ``unreadable``.  Listings come for instance from the ``binaryFile``
    source without its ``content`` column.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with opened(path) as file:
                        rows.append((path, *_walk(lambda at, size: read_at(file, at, size), length)))
                except OSError:
                    rows.append((path, *(None,) * 5, "unreadable"))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", *NAMES])

    return _judged(files.select("path", F.col("length").cast("bigint")).mapInArrow(walk, f"path string, {FIELDS}"))


def _judged(found: DataFrame) -> DataFrame:
    """Add the rejections that follow from the format, and the duration."""
    rate = F.col("sample_rate") * F.col("channels") * F.floor(F.col("bits") / 8)
    reason = F.coalesce(
        "reason",
        F.when(~F.col("audio_format").isin(1, 3), "compressed"),
        F.when(rate <= 0, "zero_rate"),
    )
    return (
        found.withColumn("reason", reason)
        .withColumn(
            "duration_ms",
            F.when(F.col("reason").isNull(), F.round(F.col("data_bytes") * 1000 / rate).cast("bigint")),
        )
    )
