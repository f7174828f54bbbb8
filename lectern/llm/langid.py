"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs.  An n-gram is bound from its letters' vectors, each
permuted by its place; a text bundles its n-grams, a language bundles its texts, and a text is
compared with the languages by cosine.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts

DIMENSIONS = 512
ORDER = 3
SHARPNESS = 25.0  # of the softmax over cosines that gives the score
UNKNOWN = "und"
_CHUNK = 1 << 18  # letters of a text that are looked at together
_BITS = 21  # of a code point
_LETTER = np.zeros(0, bool)


class Letters:
    """Random sign vectors of code points; the same on every machine."""

    def __init__(self, dimensions: int, seed: int = 7, most: int = 4096):
        self.dimensions, self.seed, self.most, self.known = dimensions, seed, most, OrderedDict()

    def __getitem__(self, code: int) -> np.ndarray:
        if code not in self.known:
            signs = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dimensions)
            self.known[code] = (2 * signs - 1).astype(np.int8)
            if len(self.known) > self.most:
                self.known.popitem(last=False)
        return self.known[code]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of packed n-grams: letters' vectors, rotated by their place, multiplied."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(ORDER):
            codes, at = np.unique((grams >> np.uint64(_BITS * place)) & np.uint64((1 << _BITS) - 1), return_inverse=True)
            out *= np.stack([np.roll(self[int(c)], place) for c in codes])[at]
        return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a text and their counts.

    Letters are lowered, every run of other characters is one space, and the text stands between
    spaces.  A text without letters has none.
    """
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    tail, seen = np.array([32], np.uint64), False
    for start in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[start : start + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(_LETTER[codes], codes, 32).astype(np.uint64)
        seen = seen or bool((codes != 32).any())
        end = [] if start + _CHUNK < len(text) else [np.uint64(32)]
        codes = np.concatenate([tail, codes, np.array(end, np.uint64)])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        if len(codes) >= ORDER:
            packed = sum(codes[i : len(codes) - ORDER + 1 + i] << np.uint64(_BITS * (ORDER - 1 - i)) for i in range(ORDER))
            found, n = np.unique(packed, return_counts=True)
            if len(total[0]):
                found, at = np.unique(np.concatenate([total[0], found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([total[1], n])).astype(np.int64)
            total = found, n
        tail = codes[-(ORDER - 1) :]
    return total if seen else (total[0][:0], total[1][:0])


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct n-grams, row, place of n-gram, count)`` of a batch of texts."""
    each = [grams(t) for t in texts(column)]
    rows = np.repeat(np.arange(len(each)), [len(g) for g, _ in each])
    found, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
    return found, rows, at, np.concatenate([n for _, n in each])


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """``lang, prototype array<double>``: the bundled, centred and normed profile of every non-null language.

    Each partition bundles its own texts, so the shuffle carries one vector for each language
    and partition.  All rows count.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dimensions), {}
        for batch in slices(batches, 256):
            langs = batch.column(0).to_pylist()
            found, rows, at, n = _counted(batch.column(1))
            if not len(found):
                continue
            names = sorted(set(langs))
            place = np.array([names.index(x) for x in langs])
            counts = np.bincount(place[rows] * len(found) + at, n, len(names) * len(found)).reshape(len(names), -1)
            for name, vector in zip(names, counts @ letters.bound(found).astype(np.float64)):
                sums[name] = sums.get(name, 0) + vector
                if len(sums) > 1000:  # many languages: hand on what there is
                    yield _vectors(sums)
                    sums = {}
        if sums:
            yield _vectors(sums)

    parts = docs.where(F.col(lang).isNotNull()).select(lang, text).mapInArrow(bundle, "lang string, vector array<double>")
    sums = (
        parts.select("lang", F.posexplode("vector").alias("at", "x"))
        .groupBy("lang", "at")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x"))
    )
    # A language's own share of what all languages have in common tells nothing: the mean of the normed bundles goes.
    normed = sums.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("lang"))))
    centred = normed.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("at")))
    return centred.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("prototype")
    )


def _vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
        names=["lang", "vector"],
    )


def predict(
    docs: DataFrame, model: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, most_languages: int = 4096
) -> DataFrame:
    """Add ``lang_pred string, score double`` for every whole text.

    The score is the prediction's share in a softmax of cosines, from 0 to 1.  Null texts, texts
    without a letter, and all texts under an empty model get ``und`` and 0.  Equal cosines go to
    the language first in order.  The prototypes are sent to all tasks; more than
    ``most_languages`` of them (8 kB each) are an error, not a cut.  Columns of the added names are
    replaced, others stay.
    """
    learned = sorted((r["lang"], r["prototype"]) for r in model.take(most_languages + 1))
    if len(learned) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = [name for name, _ in learned]
    matrix = np.array([v for _, v in learned], np.float32).reshape(len(names), dimensions)
    sizes = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    matrix = matrix / np.where(sizes == 0, 1, sizes)

    @F.arrow_udf("lang_pred string, score double")
    def best(column: pa.Array) -> pa.Array:
        letters, out = Letters(dimensions), []
        for at in range(0, len(column), 64):
            part = column.slice(at, 64)
            found, rows, place, n = _counted(part)
            cosines = np.zeros((len(part), max(1, len(names))))
            has = np.zeros(len(part), bool)
            has[rows] = bool(names)
            if len(found) and names:
                counts = np.zeros((len(part), len(found)), np.float32)
                counts[rows, place] = n
                vectors = counts @ letters.bound(found).astype(np.float32)
                norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
                cosines = (vectors / np.where(norms == 0, 1, norms)) @ matrix.T
            weight = np.exp(SHARPNESS * (cosines - cosines.max(1, keepdims=True)))
            for row, w in enumerate(weight):
                k = int(w.argmax())
                out.append((names[k], float(w[k] / w.sum())) if has[row] else (UNKNOWN, 0.0))
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())],
            names=["lang_pred", "score"],
        )

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*own, best(F.col(text)).alias("_best")).select(*own, "_best.lang_pred", "_best.score")
