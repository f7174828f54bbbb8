"""Pairs of neighbouring words of whole texts, every occurrence of them, by 64 bits.

The counts of all pairs stay in a table that grows with the rows counted.  The most frequent pairs are sent to the tasks
that read texts; all other occurrences meet the table by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, row_key, saved, slices, texts

ENTRIES = 1 << 21  # occurrences after which a task passes its counts on
_WORD = re.compile(r"\w+")
_AT_ONCE = 1 << 18
_ROWS = 1 << 16
_KNOWN = 200_000  # words whose hashes a task remembers
_SEED = 42


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode(), _SEED)
        return found


def codes(text: str, hashes: dict[str, int] | None = None) -> Iterator[np.ndarray]:
    """Codes of all pairs of neighbouring lowered words of a whole text, in order and with repeats, some at a time."""
    get, low, last = (_Hashes() if hashes is None else hashes).__getitem__, text.lower(), np.zeros(0, np.uint64)
    for part in [_WORD.findall(low)] if len(low) <= _AT_ONCE else chunks((m.group() for m in _WORD.finditer(low)), _AT_ONCE):
        words = np.concatenate([last, np.fromiter(map(get, part), np.uint64, len(part))])
        last = words[-1:]
        if len(words) > 1:
            after = words[1:]
            code = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + ((after << np.uint64(32)) | (after >> np.uint64(32)))
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield code.view(np.int64)


def counts(rows: DataFrame) -> DataFrame:
    """Written rows ``pair, toxic, plain``: how often every pair occurs in the texts of each class; ``rows`` has a text and 0 or 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = _Hashes(), ([], []), 0
        for batch in slices(batches, 4096):
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                for found in codes(text, hashes):
                    held[toxic].append(found)
                    n += len(found)
                    if n > ENTRIES:
                        yield from out(*held)
                        held, n = ([], []), 0
        yield from out(*held)

    def out(plain: list[np.ndarray], toxic: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = sum(map(len, plain))
        pair, place = np.unique(np.concatenate([np.zeros(0, np.int64), *plain, *toxic]), return_inverse=True)
        kinds = [np.bincount(p, minlength=len(pair)) for p in (place[first:], place[:first])]
        for at in range(0, len(pair), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _ROWS]) for c in (pair, *kinds)], names=["pair", "toxic", "plain"])

    parts = rows.mapInArrow(lean(count), "pair long, toxic long, plain long")
    return saved(parts.groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "pairs")


def evidence(docs: DataFrame, table: DataFrame, other: float, often: pa.Table, text: str = "text") -> DataFrame:
    """``_k1, _k2, pairs`` for every distinct row: the mean gain of all pairs of its text, repeats included; 0 without pairs.

    ``table`` has ``pair, gain``, any other pair has the gain ``other``; ``often`` are the rows that are sent to the tasks.
    """
    pair, gain = often["pair"].to_numpy(), often["gain"].to_numpy()
    order = np.argsort(pair)
    sent = docs.sparkSession.sparkContext.broadcast((pair[order], gain[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gains = sent.value
        hashes = _Hashes()
        for batch in slices(batches, 256):
            for k1, k2, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                total, n = 0.0, 0
                for found in codes(whole, hashes):
                    n += len(found)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        hit = known[at] == found
                        total += float(gains[at[hit]].sum())
                        found = found[~hit]
                    for start in range(0, len(found), _ROWS):
                        yield out(k1, k2, found[start : start + _ROWS])
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((k1, k2, k1, total, n), kinds)], schema=kinds)

    def out(k1: int, k2: int, found: np.ndarray) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(found), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())], schema=kinds)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text gives several small batches; they leave together.
        held, n = [], 0
        for batch in look(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= _ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    kinds = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("pair", pa.int64()), ("total", pa.float64()), ("n", pa.int64())])
    # A text is one row of ``total`` and ``n``, which is dealt by its key, and one for each occurrence to be looked up.
    asked = docs.select(*row_key(*docs.columns), text).mapInArrow(lean(gathered), "_k1 long, _k2 long, pair long, total double, n long")
    value: Column = F.coalesce("total", "gain", F.lit(other))
    sums = asked.join(table.select("pair", "gain"), "pair", "left").groupBy("_k1", "_k2").agg(F.sum(value).alias("total"), F.sum("n").alias("n"))
    # Rows that repeat add as much to both sums.
    return sums.select("_k1", "_k2", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("pairs"))
