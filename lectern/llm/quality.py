"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a sparse random index vector.  Tokens that are frequent in the training sample
carry the index vectors of their neighbours as a context vector; all others are looked up by
their shape, whose context vector is learned the same way.  A document is the mean of its
tokens' vectors and of their shapes' index vectors.  The network is trained in numpy and its
logits are divided by a temperature fitted on rows it was not trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, give_back, lean, saved, slices, texts

DIMENSIONS = 128
NONZERO = 4
WINDOW = 2
SAMPLE_ROWS = 8_000  # labelled rows a model is fitted on at most
VOCABULARY, FORMS = 8_192, 65_536  # words and shapes with a context vector of their own, the most frequent of the sample
PARTS = 16  # tasks that hold the sample
HIDDEN = 32
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_AT_ONCE = 1 << 18
REPEAT = "\0="


@lru_cache(50_000)
def shape(token: str) -> str:
    """The shape of a token: signs as they are (three at most), words by case, digits and length."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    kind = "0" if token.isdigit() else "9a" if any(c.isdigit() for c in token) else (
        "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a" if token.islower() else "aA")
    return f"\0{kind}{min(len(token).bit_length(), 7)}"


def shapes_of(tokens: list[str], low: list[str]) -> list[str]:
    """Shapes of consecutive tokens; a word that repeats the one before has the shape of a repeat."""
    return [REPEAT if a == b and a[0].isalnum() else shape(t) for t, a, b in zip(tokens, low, ["", *low])]


def index_vector(token: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The sparse random vector of a token: a few signs at places that its hash gives."""
    out = np.zeros(dimensions, np.float32)
    for i in range(NONZERO):
        h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), i)
        out[h % dimensions] += 1 if h >> 63 else -1
    return out


@dataclass
class Model:
    """A fitted classifier; its size is bounded by its parameters, never by the data."""

    known: dict[str, int]  # words and shapes -> row of ``vectors``
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float
    prior: float

    def places(self, tokens: list[str]) -> np.ndarray:
        """Rows of tokens and, behind them, of their shapes."""
        get, other = self.known.get, len(self.known)
        low = [t.lower() for t in tokens]
        shapes = [get(s, other) for s in shapes_of(tokens, low)]
        words = [get(t, s) for t, s in zip(low, shapes)]
        return np.array(words + shapes, np.int64)

    def pooled(self, text: str) -> np.ndarray:
        """The mean vector of the tokens of a whole text, beside that of their shapes."""
        rows = len(self.known) + 1
        counts = np.zeros(2 * rows, np.int64)
        n = 0
        for tokens in split(text):
            at = self.places(tokens)
            at[len(tokens) :] += rows
            counts += np.bincount(at, minlength=2 * rows)
            n += len(tokens)
        if not n:
            return np.zeros(2 * self.vectors.shape[1], np.float32)
        out = []
        for part in (counts[:rows], counts[rows:]):
            used = np.flatnonzero(part)
            out.append((part[used] / n).astype(np.float32) @ self.vectors[used])
        return np.concatenate(out)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum((pooled - self.mean) / self.scale @ a + b, 0) @ c + d

    def scores(self, whole: list[str]) -> np.ndarray:
        """Probability of label 1; a text without tokens gets the share of label 1 in the sample."""
        pooled = np.stack([self.pooled(t) for t in whole])
        p = 1 / (1 + np.exp(-np.clip(self.logits(pooled) / self.temperature, -60, 60)))
        return np.where(np.abs(pooled).sum(1) == 0, self.prior, p)


def split(text: str) -> Iterator[list[str]]:
    """Tokens of a whole text, in lists of bounded size."""
    if len(text) <= _AT_ONCE:
        yield _TOKEN.findall(text)
    else:
        yield from chunks((m.group() for m in _TOKEN.finditer(text)), _AT_ONCE)


def token_counts(sample: DataFrame) -> DataFrame:
    """``token, form, n`` over the sample: lowered words, and shapes with the mark ``form``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forms = Counter(), Counter()
        for batch in slices(batches, 64):
            for text in texts(batch.column(0)):
                for tokens in split(text):
                    low = [t.lower() for t in tokens]
                    words.update(low)
                    forms.update(shapes_of(tokens, low))
        rows = [(t, f, n) for f, found in ((False, words), (True, forms)) for t, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 3, (pa.string(), pa.bool_(), pa.int64()))], names=["token", "form", "n"])

    return sample.select("text").mapInArrow(lean(count), "token string, form boolean, n long").groupBy("token", "form").agg(F.sum("n").alias("n"))


def neighbour_sums(rows: np.ndarray, before: np.ndarray, index: np.ndarray, sums: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours; ``before`` are the rows that were added last."""
    every = np.concatenate([before, rows])
    for gap in range(1, WINDOW + 1):
        first = max(len(before), gap)
        a, b = every[first - gap : len(every) - gap], every[first:]
        np.add.at(sums, a, index[b])
        np.add.at(sums, b, index[a])


def _context_vectors(sample: DataFrame, dimensions: int) -> tuple[dict[str, int], np.ndarray]:
    """Random indexing over the sample: rows of its most frequent words and shapes; what is neither has a zero vector.

    Tokens are counted and neighbours summed in the tasks that hold the texts; what comes to the driver is the vocabulary and
    one matrix of its size from each of ``PARTS`` tasks.  Sums are of whole numbers, so their order tells nothing.
    """
    counted = saved(token_counts(sample), "tokens")
    often = [r["token"] for r in counted.where("not form and n >= 5").orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]
    forms = sorted({REPEAT, *(r["token"] for r in counted.where("form").orderBy(F.desc("n"), "token").limit(FORMS).collect())})
    known = {w: i for i, w in enumerate(dict.fromkeys([*often, *forms]))}
    index = np.stack([index_vector(w, dimensions) for w in known] + [np.zeros(dimensions, np.float32)])
    other = len(known)
    sent = sample.sparkSession.sparkContext.broadcast((known, index))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = sent.value
        get, sums = known.get, np.zeros_like(index)
        for batch in slices(batches, 64):
            for text in texts(batch.column(0)):
                before = np.zeros(0, np.int64)
                for tokens in split(text):
                    low = [t.lower() for t in tokens]
                    forms = shapes_of(tokens, low)
                    rows = np.array([get(t, get(f, other)) for t, f in zip(low, forms)], np.int64)
                    neighbour_sums(rows, before, index, sums)
                    before = rows[-WINDOW:]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = np.zeros_like(index)
    for r in sample.select("text").mapInArrow(lean(add), "sums binary").toLocalIterator():
        sums += np.frombuffer(r["sums"], np.float32).reshape(sums.shape)
    # A token keeps its own index vector too, so words with like neighbours stay distinct.
    norms = np.sqrt((sums * sums).sum(1, keepdims=True))
    vectors = index + sums / np.where(norms == 0, 1, norms)
    vectors[other] = 0
    return known, vectors


def _train(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 60, rate: float = 3e-3):
    """Two layers by Adam on the log loss, with weight decay."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [0 * q for q in p], [0 * q for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (h > 0)
            step += 1
            for k, g in enumerate((x[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ e + 1e-4 * p[2], np.array([e.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(p)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows the network has not seen."""
    def loss(t):
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return min(np.geomspace(0.25, 16, 49), key=loss)


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = SAMPLE_ROWS, dimensions: int = DIMENSIONS, seed: int = 11,
) -> Model:
    """Fit on at most ``rows`` labelled rows, those whose ids have the smallest hashes.

    The sample is drawn from the labels, so only its ids (a bounded set) go to the tasks that
    read texts.  Texts of any length are taken whole and stay in the tasks: what comes back of each is its pooled
    vector.  Rows with a null id, label or text are passed over, and of rows with equal text and label one
    counts.  With no rows, or rows of one label only, every text gets that label's share (0.5 with none).
    """
    chosen = (
        labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    sample = saved(
        docs.where(F.col(text).isNotNull()).select(F.col(id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
        .select("text", (F.col("y") > 0).cast("double").alias("y")).dropDuplicates(["text", "y"]).repartition(PARTS, F.xxhash64("text", "y")),
        "sample")
    # Partitions hold what they were dealt, whatever files they were read from.
    sample = sample.repartition(PARTS, F.xxhash64("text", "y"))
    share = sample.agg(F.avg("y"), F.count("*")).first()
    prior = float(share[0]) if share[1] else 0.5
    known, vectors = _context_vectors(sample, dimensions)
    width = 2 * dimensions
    model = Model(known, vectors, np.zeros(width, np.float32), np.ones(width, np.float32),
                  (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([np.log((prior + 1e-6) / (1 - prior + 1e-6))])), 1.0, prior)
    if share[1] and 0 < prior < 1:
        pooled = _pooled(sample.withColumn("h", F.xxhash64("text", "y", F.lit(seed))), model).collect()  # one vector for each of at most ``rows`` rows
        pooled = sorted((r["h"], r["y"], r["pooled"]) for r in pooled)
        x, y = np.stack([np.frombuffer(p, np.float32) for *_, p in pooled]), np.array([y for _, y, _ in pooled])
        model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
        held = np.arange(len(y)) % 5 == 0
        z = (x - model.mean) / model.scale
        model.layers = _train(z[~held], y[~held], seed)
        model.temperature = _temperature(model.logits(x[held]), y[held])
    return model


def _pooled(sample: DataFrame, model: Model) -> DataFrame:
    """``h, y, pooled`` of the rows ``text, y, h``."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("binary")
    def pool(column: pa.Array) -> pa.Array:
        out = pa.array([sent.value.pooled(t or "").tobytes() for at in range(0, len(column), 64) for t in column.slice(at, 64).to_pylist()], pa.binary())
        give_back()
        return out

    return sample.select("h", "y", pool("text").alias("pooled"))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that a whole text is of label 1; null counts as empty.

    Only the text is looked at, so equal texts have equal scores; other columns stay, one of the
    added name is replaced.
    """

    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        out = [sent.value.scores(texts(column.slice(at, 64))) for at in range(0, len(column), 64)]
        shape.cache_clear()  # the worker lives on, and later stages need its memory
        give_back()
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn(name, of(F.col(text)))
