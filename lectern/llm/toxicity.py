"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary documents each give a model of words with absolute discounts, estimated from
how many words have each of the smallest counts.  The mass that the discounts free goes, in both
models, to one distribution shared by the classes: the number of contexts a word stands in.  A context is a
document, and a word counts once in each, so that a repeated line says no more than one.  A rare word
thus gets most of its probability from what both models share, and speaks for neither.

Above the words stands an order of pairs: every pair of neighbouring words counts as often as it occurs (``pairs.py``),
with discounts of its own, and what these free goes to a distribution shared by the classes as well.

A text's evidence is the difference of its log-likelihoods under the models of words divided by the number of its
distinct words, the difference of its most telling word, for a few expressions in a long text, and the mean difference of
all its pairs, in order and with every repeat.  They are mapped to a
probability on labelled rows that neither model counted.

All counts stay in tables that grow with the labelled rows.  The most frequent words are sent to the tasks that read texts; every
other word of a text is joined with the table by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pairs
from .common import chunks, row_key, saved, slices, texts, with_labels

HEAD = 200_000  # most frequent words, which are sent to the tasks; all others are joined
PAIR_HEAD = 500_000  # most frequent pairs, likewise
CALIBRATION_ROWS = 20_000  # held-back labelled rows that the calibration is fitted on at most
ENTRIES = 300_000  # counted words after which a task passes its counts on
_WORD = re.compile(r"\w+")
_AT_ONCE = 1 << 18
_HELD_BACK = 5  # one labelled row in so many is for the calibration


@dataclass
class Model:
    """``table`` has ``word, gain, n``, the log-likelihood difference of every counted word; ``other`` is that of all others.

    ``pair_table`` (``pair, gain, n``) and ``pair_other`` are the same for pairs.
    """

    table: DataFrame
    other: float
    prior: float
    pair_table: DataFrame
    pair_other: float
    weights: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


def distinct_words(text: str) -> dict[str, None]:
    """The distinct lowered words of a whole text, in order."""
    low = text.lower()
    if len(low) <= _AT_ONCE:
        return dict.fromkeys(_WORD.findall(low))
    out: dict[str, None] = {}
    for part in chunks((m.group() for m in _WORD.finditer(low)), _AT_ONCE):
        out.update(dict.fromkeys(part))
    return out


def _word_counts(rows: DataFrame) -> DataFrame:
    """``word, toxic, plain``: documents of each class that hold the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in slices(batches, 4096):
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                sums[toxic].update(distinct_words(text).keys())
                if len(sums[0]) + len(sums[1]) > ENTRIES:
                    yield out(*sums)
                    sums = (Counter(), Counter())
        yield out(*sums)

    def out(plain: Counter, toxic: Counter) -> pa.RecordBatch:
        names = list(plain.keys() | toxic.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([plain[w] for w in names], pa.int64())],
            names=["word", "toxic", "plain"],
        )

    parts = rows.mapInArrow(count, "word string, toxic long, plain long")
    return parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and three or more, from how many words have the counts one to four."""
    free = ones / (ones + 2 * twos) if ones else 0.5
    of = lambda k, n, more: min(max(k - (k + 1) * free * more / n, 0.1), k - 0.05) if n else free
    return of(1, ones, twos), of(2, twos, threes), of(3, threes, fours)


def _gains(counts: DataFrame, word: str = "word") -> tuple[DataFrame, float]:
    """``word, gain, n`` of all counted words or pairs, and the gain of one in no document of either class; ``n`` is the sum of its counts."""
    n = (F.col("toxic") + F.col("plain")).alias("n")
    few = [F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in ("toxic", "plain") for k in (1, 2, 3, 4)]
    more = [F.count_if(F.col(c) >= 3).alias(f"{c}_more") for c in ("toxic", "plain")]
    got = counts.agg(F.count("*").alias("words"), F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), *few, *more).first()
    if not got["toxic"] or not got["plain"]:
        return counts.select(word, F.lit(0.0).alias("gain"), n), 0.0
    every, words = got["toxic"] + got["plain"], got["words"]
    # A word in no document stands in half a context, so that nothing is impossible.
    shared = (F.col("toxic") + F.col("plain") + 0.5) / (every + 0.5 * (words + 1))
    logs, frees = {}, {}
    for c in ("toxic", "plain"):
        off = discounts(*(got[f"{c}{k}"] for k in (1, 2, 3, 4)))
        free = (off[0] * got[f"{c}1"] + off[1] * got[f"{c}2"] + off[2] * got[f"{c}_more"]) / got[c]
        own = F.col(c) - F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, off[0]).when(F.col(c) == 2, off[1]).otherwise(off[2])
        logs[c], frees[c] = F.log(own / got[c] + F.lit(free) * shared), free
    return counts.select(word, (logs["toxic"] - logs["plain"]).alias("gain"), n), float(np.log(frees["toxic"] / frees["plain"]))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Count every row of ``docs`` that has a label; one row in five only sets the calibration.

    Null texts count as empty, rows with a null id or label are passed over.  Without labelled
    rows, or with rows of one class, the models say nothing and every text gets that class's share.
    """
    texts_of = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    marks = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("_toxic"))
    back = F.pmod(F.xxhash64("_id"), F.lit(_HELD_BACK)) == 0
    rows = with_labels(texts_of, marks.where(~back), "_id", ["_toxic"])
    table, other = _gains(saved(_word_counts(rows.select("_text", "_toxic")), "words"))
    model = Model(table, other, 0.5, *_gains(pairs.counts(rows.select("_text", "_toxic")), "pair"))
    few = marks.where(back).orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(CALIBRATION_ROWS)
    chosen = with_labels(texts_of, saved(few, "calibration"), "_id", ["_toxic"]).select("_text", "_toxic")
    got = evidence(chosen, model, "_text").join(chosen.select(*row_key("_text", "_toxic"), "_toxic").distinct(), ["_k1", "_k2"])
    model.weights, model.prior = calibrated(sorted(map(tuple, got.select("mean", "most", "pairs", "_toxic").collect())))
    return model


def calibrated(rows: list[tuple[float, float, float, int]]) -> tuple[tuple[float, float, float, float], float]:
    """Logistic weights of the kinds of evidence and a constant, by Newton steps; and the share of toxic rows."""
    if not rows:
        return (0.0, 0.0, 0.0, 0.0), 0.5
    x, y = np.array([(*kinds, 1.0) for *kinds, _ in rows]), np.array([float(c) for *_, c in rows])
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weights = np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])
    if 0 < y.sum() < len(y):
        # Evidence far from zero that hardly varies would stand for the constant, and steps along both would not end.
        middle, scale = np.array([*x[:, :3].mean(0), 0.0]), np.array([*np.maximum(x[:, :3].std(0), 1e-6), 1.0])
        x = (x - middle) / scale
        ridge = np.array([1.0, 1.0, 1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
            weights = weights - np.clip(np.linalg.solve(hess, x.T @ (p - y) + ridge * weights), -2, 2)
        weights = weights / scale
        weights[-1] -= weights @ middle
    return tuple(map(float, weights)), share


def _often(table: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of a table of counts, at most ``most`` of them: all from the least count that so many reach.

    The least count comes from how many words have each count, so that no task sends more than its share of the head.
    """
    falling = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each different count
    reached = table.groupBy("n").count().withColumn("upto", F.sum("count").over(falling))
    least = reached.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return table.where(F.lit(False) if least is None else F.col("n") >= least)


def _head(table: DataFrame, most: int) -> dict[str, float]:
    """The gains of the most frequent words, at most ``most`` of them."""
    return {r["word"]: r["gain"] for r in _often(table, most).select("word", "gain").collect()}


def evidence(docs: DataFrame, model: Model, text: str = "text", head: int = HEAD, pair_head: int = PAIR_HEAD) -> DataFrame:
    """``_k1, _k2, mean, most, n, pairs`` for every distinct row.

    These are the mean difference by distinct word, the largest, how many words there are, and the mean difference of all pairs.
    Words and pairs of the heads are looked up in the tasks that read the texts, all others are joined with the model's
    tables, so that every counted one has its say however many there are.
    """
    by_word = _word_evidence(docs, model, text, head)
    often = _often(model.pair_table, pair_head).select("pair", "gain").toArrow()
    return by_word.join(pairs.evidence(docs, model.pair_table, model.pair_other, often, text), ["_k1", "_k2"])


def _word_evidence(docs: DataFrame, model: Model, text: str, head: int) -> DataFrame:
    often = _head(model.table, head)
    sent = docs.sparkSession.sparkContext.broadcast(often)  # ``head`` words at most

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in slices(batches):
            rows: list[tuple] = []
            for whole in texts(batch.column(2)):
                total, most, n, rest = 0.0, float("-inf"), 0, []
                for word in distinct_words(whole):
                    n += 1
                    gain = get(word)
                    if gain is None:
                        rest.append(word)
                    else:
                        total += gain
                        most = gain if gain > most else most
                rows.append((total, most, n, rest))
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["_k1", "_k2", "total", "most", "n", "rest"])

    read = docs.select(*row_key(*docs.columns), text).mapInArrow(look, "_k1 long, _k2 long, total double, most double, n long, rest array<string>")
    met = saved(read, "met")
    own = met.groupBy("_k1", "_k2").agg(*[F.first(c).alias(c) for c in ("total", "most", "n")], F.first(F.size("rest")).alias("asked"))
    # Rows that repeat ask once; the gains of all words asked for come back summed by row.
    asked = met.dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", F.explode("rest").alias("word"))
    found = asked.join(model.table.select("word", "gain"), "word").groupBy("_k1", "_k2").agg(
        F.sum("gain").alias("gains"), F.max("gain").alias("best"), F.count("*").alias("known"))
    joined = own.join(found, ["_k1", "_k2"], "left")
    unknown = F.col("asked") - F.coalesce("known", F.lit(0))
    total = F.col("total") + F.coalesce("gains", F.lit(0.0)) + unknown * F.lit(model.other)
    most = F.greatest("most", "best", F.when(unknown > 0, F.lit(model.other)))
    return joined.select(
        "_k1", "_k2", F.when(F.col("n") > 0, total / F.col("n")).otherwise(0.0).alias("mean"), F.when(F.col("n") > 0, most).otherwise(0.0).alias("most"), "n")


def probability(model: Model) -> Column:
    mean, most, by_pair, constant = model.weights
    z = F.col("mean") * mean + F.col("most") * most + F.col("pairs") * by_pair + constant
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that a whole text is toxic; null counts as empty, which has no evidence.

    Other columns stay, one of the added name is replaced; rows that repeat have one score each.
    """
    own = [c for c in docs.columns if c != name]
    docs = docs.select(*own)
    judged = evidence(docs, model, text).select("_k1", "_k2", probability(model).alias(name))
    rows = docs.select(*row_key(*own), F.struct(*own).alias("_row"))
    return rows.join(judged, ["_k1", "_k2"]).select("_row.*", name)
