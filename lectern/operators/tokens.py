"""Byte-pair tokens of whole documents.

Pieces are cut by expressions; merging runs on Arrow batches with a memo per task.  Word
frequencies make the memo hit almost always, and no text is ever shuffled: exploding every
piece to join it with a piece dictionary would move many times the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCE, SPACE

MEMO, MEMO_LETTERS = 1 << 18, 64  # pieces whose tokens a task remembers, and how long they may be
ROWS = 64  # texts whose ids a task holds at once
ENTRIES = 2_000_000  # tokens and merges of a vocabulary at most
UNKNOWN = "<|unk|>"
# Fixed value: the pre-token pattern.
PIECE = (
    "(?:'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD])"
    "|[^\\r\\n\\p{L}\\p{N}]?\\p{L}+"
    "|\\p{N}"
    f"| ?[^{SPACE}\\p{{L}}\\p{{N}}]+[\\r\\n]*"
    f"|[{SPACE}]*[\\r\\n]+"
    f"|[{SPACE}]+(?![^{SPACE}])"
    f"|[{SPACE}]+"
)


def byte_symbols() -> list[str]:
    """A printable character for each byte; unprintable bytes continue from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in printable else chr(256 + next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Token ids, merge pairs best first, and whole tokens that are never split."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    added: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_json(cls, doc: dict) -> "Vocabulary":
        pairs = [tuple(m.split(" ")[:2]) if isinstance(m, str) else tuple(m[:2]) for m in doc["model"].get("merges", [])]
        added = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        return cls(dict(doc["model"]["vocab"]), pairs, added)


def pieces(text: Column | str, added: list[str]) -> Column:
    """Alternating prose and added-token sections, each prose section cut into pieces."""
    text = F.col(text) if isinstance(text, str) else text
    if not added:
        return F.regexp_extract_all(text, F.lit(PIECE), 0)
    longest_first = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
    sections = F.split(F.regexp_replace(text, f"({longest_first})", f"{FENCE}$1{FENCE}"), FENCE)
    return F.flatten(
        F.transform(
            sections,
            lambda s, i: F.when(i % 2 == 1, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(PIECE), 0)),
        )
    )


def _encoder(vocabulary: Vocabulary):
    symbols = byte_symbols()
    ranks = {pair: rank for rank, pair in enumerate(vocabulary.merges)}
    unknown = vocabulary.ids.get(UNKNOWN, 0)

    def encode(piece: str) -> tuple[int, ...]:
        if piece in vocabulary.added:
            return (vocabulary.added[piece],)
        parts = merged([symbols[b] for b in piece.encode("utf-8")], ranks)
        return tuple(vocabulary.ids.get(symbol, unknown) for symbol in parts)

    known = lru_cache(MEMO)(encode)
    return lambda piece: known(piece) if len(piece) <= MEMO_LETTERS else encode(piece)


def merged(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge adjacent parts by the best rank first, the leftmost of equal ones.

    Parts are linked to their neighbours and the ranks of pairs wait in a heap, so a piece of n letters takes
    n log n steps.  A pair that has changed since it was put there is passed over.
    """
    right = [*range(1, len(parts)), -1]
    left = [-1, *range(len(parts) - 1)]
    waiting = [(ranks[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
    heapify(waiting)
    while waiting:
        _, i, pair = heappop(waiting)
        j = right[i]
        if j < 0 or (parts[i], parts[j]) != pair:
            continue
        parts[i], parts[j] = "".join(pair), ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        right[j] = -1
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (parts[a], parts[b]) in ranks:
                heappush(waiting, (ranks[parts[a], parts[b]], a, (parts[a], parts[b])))
    return [p for p in parts if p]


def _shared(df: DataFrame, vocabulary: Vocabulary):
    """The vocabulary in all tasks; its size is checked, as every Python worker holds a copy."""
    entries = len(vocabulary.ids) + len(vocabulary.merges) + len(vocabulary.added)
    if entries > ENTRIES:
        raise ValueError(f"a vocabulary of {entries} entries; {ENTRIES} are sent to tasks at most")
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def bpe_tokenize(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``n_tokens``."""
    shared = _shared(df, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _encoder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # ids of a few texts at a time, four bytes each
                yield batch.iloc[at : at + ROWS].map(
                    lambda row: np.fromiter((i for piece in row for i in one(piece)), np.int32) if row is not None else None
                )

    ids = encode(pieces(F.coalesce(text, F.lit("")), list(vocabulary.added)))
    return df.withColumn("ids", ids).withColumn("n_tokens", F.size("ids"))


def bpe_decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: added tokens are left out, broken bytes become replacement marks."""
    shared = _shared(df, vocabulary)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
        data = {
            i: bytes(byte_of[c] for c in token if c in byte_of)
            for token, i in shared.value.ids.items()
            if token not in shared.value.added
        }
        for batch in batches:
            yield batch.map(lambda row: b"".join(data.get(i, b"") for i in row).decode("utf-8", "replace"))

    return df.withColumn("decoded", decode(ids))
