"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions; its hash ignores the positions that the mask
leaves out, so a changed word does not hide the words around it.  Hashes of the benchmark items and of the
documents are joined; around a hit both are laid on each other and the overlap is verified,
changed words included.

The benchmark is joined block by block.  A block has at most ``BLOCK_CHARS`` characters, which
bounds what a task holds; more benchmark means more blocks, each against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, lean, texts

# Positions that count, in a window of tokens.  One of these hits every overlap of 13 tokens or more that is 80 % equal:
# those of 13 to 25 tokens are enumerated by the tests, and a longer one has a part among these.
MASKS = ("11110111", "11101001011", "100100011111", "1110100010011", "1001110010011", "1111111")
LEAST_TOKENS = 13  # of an overlap; a shorter item has to be there whole
LEAST_EQUAL = 0.8  # of an overlap's tokens
BLOCK_CHARS = 8 << 20
_WORD = re.compile(r"\w+")
_AT_ONCE = 1 << 17
_CHANGED = 2.0  # what a changed token costs in the best overlap, in equal tokens
_LOST = round(LEAST_EQUAL / (1 - LEAST_EQUAL))  # what it costs where the sum of a stretch tells whether it is equal enough
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of the mask laid at every start where all its positions hold known tokens."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = [i for i, c in enumerate(mask) if c == "1"]
    known = ids > 0
    starts = np.flatnonzero(np.logical_and.reduce([known[i : i + n] for i in at]))
    out = np.zeros(len(starts), np.uint64)
    for i in at:
        out = (out ^ ids[starts + i].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return starts, out


def whole_masks(n: int) -> list[str]:
    """Masks over the whole of a shorter item: one of them has none of the tokens that may be changed in it.

    Positions are dealt into three groups more than changes, and each mask leaves out as many groups as there are changes.
    """
    changes = next(k for k in range(n, -1, -1) if n - k >= LEAST_EQUAL * n)
    groups = changes + 3
    return ["".join("0" if i % groups in out else "1" for i in range(n)) for out in combinations(range(groups), changes)]


class Block:
    """Benchmark items of one block: tokens as ids and the hashes of all masks in order."""

    def __init__(self, items: list[tuple[object, str]]):
        self.names = [name for name, _ in items]
        tokens = [_WORD.findall((text or "").lower()) for _, text in items]
        self.vocabulary: dict[str, int] = {}
        for t in tokens:
            for w in t:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.ids = [np.array([self.vocabulary[w] for w in t], np.int64) for t in tokens]
        by_mask = {mask: [i for i, ids in enumerate(self.ids) if len(ids) >= LEAST_TOKENS] for mask in MASKS}
        # Shorter items have masks of their own length; those that allow no change are looked up as they are.
        self.short: dict[tuple[int, ...], list[int]] = {}
        for item, ids in enumerate(self.ids):
            if len(ids) < LEAST_TOKENS:
                own = whole_masks(len(ids))
                if len(own) > 1:
                    for mask in own:
                        by_mask.setdefault(mask, []).append(item)
                elif len(ids):
                    self.short.setdefault(tuple(ids.tolist()), []).append(item)
        self.tables = []
        for mask, items in by_mask.items():
            if items:
                found = [(_hashes(self.ids[item], mask), item) for item in items]
                hashes = np.concatenate([h for (_, h), _ in found])
                places = np.concatenate([p for (p, _), _ in found])
                owners = np.concatenate([np.full(len(h), item) for (_, h), item in found])
                order = np.argsort(hashes, kind="stable")
                self.tables.append((mask, hashes[order], owners[order], places[order]))

    def overlaps(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """``item -> (equal, length, start in the document, start in the item)`` of the best verified overlap."""
        low = text.lower()
        if len(low) <= _AT_ONCE:
            parts = [_WORD.findall(low)]
        else:
            parts = chunks((m.group() for m in _WORD.finditer(low)), _AT_ONCE)
        get = self.vocabulary.get
        ids = np.concatenate([np.array([get(w, 0) for w in p], np.int32) for p in parts] or [np.zeros(0, np.int32)])
        lined: set[tuple[int, int]] = set()
        for mask, hashes, owners, places in self.tables:
            starts, own = _hashes(ids, mask)
            if not len(own) or not len(hashes):
                continue
            a, b = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            hit = np.flatnonzero(b > a)
            for p, i, j in zip(starts[hit].tolist(), a[hit].tolist(), b[hit].tolist()):
                lined.update(zip(owners[i:j].tolist(), (p - places[i:j]).tolist()))
        best: dict[int, tuple[int, int, int, int]] = {}
        for item, gap in sorted(lined):
            self._take(best, item, self._verified(ids, item, gap))
        for key, items in self.short.items():
            n = len(key)
            same = np.ones(max(0, len(ids) - n + 1), bool)
            for i, w in enumerate(key):
                same &= ids[i : i + len(same)] == w
            for p in np.flatnonzero(same)[:1].tolist():
                for item in items:
                    self._take(best, item, (n, n, p, 0))
        return best

    @staticmethod
    def _take(best: dict, item: int, found: tuple[int, int, int, int] | None) -> None:
        if found and (item not in best or (-found[0], *found[1:]) < (-best[item][0], *best[item][1:])):
            best[item] = found

    def _verified(self, ids: np.ndarray, item: int, gap: int) -> tuple[int, int, int, int] | None:
        """The best stretch of the item laid on the document at ``gap``, if any is long and equal enough.

        That is the best one by what changed tokens cost if it qualifies, or else the one of most equal
        tokens among all that do, of these the shortest, then the first.
        """
        own = self.ids[item]
        a, b = max(0, -gap), min(len(own), len(ids) - gap)
        equal = own[a:b] == ids[a + gap : b + gap]
        least = min(LEAST_TOKENS, len(own))
        if len(equal) < least or equal.sum() < LEAST_EQUAL * least:
            return None
        sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -_CHANGED))])
        low = np.minimum.accumulate(sums)
        stop = int((sums - low).argmax())
        start = int(sums[: stop + 1].argmin())
        n, same = stop - start, int(equal[start:stop].sum())
        if n < least or same < LEAST_EQUAL * n:
            found = _most_equal(equal, least)
            if found is None:
                return None
            start, stop = found
            n, same = stop - start, int(equal[start:stop].sum())
        return same, n, a + start + gap, a + start


def _most_equal(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """``(start, stop)`` of the stretch of most equal tokens among those of ``least`` tokens that are equal enough."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -_LOST))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # The farthest stop of a start is the last one from which the largest later sum is not below its own.
    later = np.maximum.accumulate(sums[::-1])
    stop = len(equal) - np.searchsorted(later, sums, "left")
    start = np.flatnonzero(stop - np.arange(len(sums)) >= least)
    if not len(start):
        return None
    last = np.maximum.accumulate(np.concatenate([[0], np.where(equal, np.arange(1, len(equal) + 1), 0)]))
    stop = np.maximum(start + least, last[stop[start]])  # changed tokens at the end are left out
    best = np.lexsort((start, stop - start, count[start] - count[stop]))[0]
    return int(start[best]), int(stop[best])


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The items in blocks of about ``chars`` characters; repeated rows count once, null texts are empty."""
    rows = benchmark.select(F.col(item).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    total = rows.agg(F.sum(F.length("t") + 16)).first()[0] or 0
    n = -(-total // chars)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield Block(sorted(((r["i"], r["t"]) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``id, item, n_equal, n_tokens, doc_start, item_start``: verified overlaps, the best for each row and item.

    Tokens are lowered runs of word characters.  An overlap lies without gaps on both sides, has
    at least ``LEAST_TOKENS`` tokens (or the whole of a shorter item) and at least ``LEAST_EQUAL``
    of them equal; others may be changed.  Of equal overlaps the shortest, then the first counts.
    Null and empty texts overlap with nothing.  Repeated rows are judged each by itself; null ids
    come back as null.
    """
    spec = f"`{id}` {docs.schema[id].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, n_equal long, n_tokens long, doc_start long, item_start long"
    out = docs.sparkSession.createDataFrame([], spec)
    for block in blocks(benchmark, item, item_text):
        out = out.unionByName(docs.select(id, text).mapInArrow(lean(_search(docs.sparkSession.sparkContext.broadcast(block), id, item, docs, benchmark)), spec))
    return out


def _search(sent, id: str, item: str, docs: DataFrame, benchmark: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema[id].dataType), to_arrow_type(benchmark.schema[item].dataType)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            rows = [
                (name, block.names[i], *found)
                for name, t in zip(names, texts(batch.column(1))) for i, found in sorted(block.overlaps(t).items())
            ]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kinds[0]), pa.array(columns[1], kinds[1]), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    names=[id, item, "n_equal", "n_tokens", "doc_start", "item_start"])

    return search


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns as they are.  Rows are judged in place, without a shuffle."""
    out = docs
    for block in blocks(benchmark, item, item_text):
        out = out.where(_free(docs.sparkSession.sparkContext.broadcast(block))(F.col(text)))
    return out


def _free(sent):
    @F.arrow_udf("boolean")
    def free(column: pa.Array) -> pa.Array:
        out = pa.array([not sent.value.overlaps(t) for t in texts(column)], pa.bool_())
        give_back()
        return out

    return free
