"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, codes.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``, works on
all rows of ``docs`` and returns a table that is written and read again as the next one's input.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, quality, simhash, suffix
from lectern.llm.common import saved, table, text_key
from lectern.llm.queries import PASSAGE_WORDS, THRESHOLD, WORDS, quality_model

ORACLE_SQL = None  # no stage but the first steps of the others can be written in SQL


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = quality.score(docs, quality_model(spark, sf_dir), name="_score")
    return scored.where(F.col("_score") >= THRESHOLD).drop("_score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Links are texts whose five-word shingles have a similarity of 0.8 or more.  Empty texts are
    copies of each other, and of rows that repeat id and text one stays.
    """
    groups = saved(simhash.similar_texts(docs), "groups").where("kept")
    kept = groups.groupBy("doc_id", "text_key").count()
    key = text_key(F.col("text"))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]) & (key == kept["text_key"]), "left_semi")
    return rows if kept.where("count > 1").isEmpty() else rows.dropDuplicates(["doc_id", "text"])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 400 bytes, or of 50 words, that repeat; characters are never cut apart, and other columns stay."""
    cut = suffix.remove(suffix.repeats(docs, words=PASSAGE_WORDS), characters=True)
    text = F.when(F.col("runs") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    n = F.when(F.col("runs") > 0, F.length(F.decode("kept", "UTF-8")).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": n}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns if c != "spans"])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, with digests of them and of the decoded text."""
    coded = bpe.encode_decode(docs.select("doc_id", "text"), WORDS)
    return bpe.digests(coded, "doc_id", "ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("decontamination", without_leaks),
    ("bpe", codes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
