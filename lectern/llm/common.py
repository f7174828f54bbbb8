"""What the operators of this subpackage share: tables, keys of rows, written intermediate tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A given table, by a path that only Spark has to understand."""
    return tune(spark).read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a session of one machine without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares")
        folder = tempfile.mkdtemp(prefix="lectern-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    Later reads survive lost executors and never repeat the work above.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> list[Column]:
    """128 bits that name a row by its values, as columns ``_k1`` and ``_k2``.

    Rows with equal values get one key: they are told apart nowhere, and a join on the key
    gives each of them the same result.  No row number is needed, so a recomputed partition
    names its rows as before.
    """
    return [
        F.xxhash64(*columns).alias("_k1"),
        F.xxhash64(F.lit(0x5EED), *columns).alias("_k2"),
    ]


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fold_of(key: str, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key belongs to no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of a column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one holds at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(rows, int(size / max(1, batch.nbytes / batch.num_rows))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Hand the freed memory of a Python worker back to the system.

    Workers live on between tasks, and an executor's limit counts all of them: the working one and those that wait.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` over the batches of a task, at whose end the worker gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def chunks(items: Iterable, size: int) -> Iterator[list]:
    """Lists of at most ``size`` consecutive items."""
    items = iter(items)
    while part := list(islice(items, size)):
        yield part


def with_labels(docs: DataFrame, labels: DataFrame, id: str, columns: list[str], broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` with the ``columns`` of their labels; rows without a label go.

    Labels up to ``broadcast_rows`` are sent to the tasks that read the texts, so no text is
    shuffled; more of them are joined by a shuffle.  One label row counts for each id.
    """
    one = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_label_id")).agg(
        *[F.max(c).alias(c) for c in columns]
    )
    small = labels.count() <= broadcast_rows
    return docs.join(F.broadcast(one) if small else one, docs[id] == F.col("_label_id")).drop("_label_id")
