"""One registered query for each operator of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, counts, decontaminate, divergence, langid, mixing, quality, simhash, spelling, suffix, topk, toxicity
from .common import fold_of, saved, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
THRESHOLD = 0.3
PASSAGE_WORDS = 50


def op1_chat(spark: SparkSession, directory: str) -> DataFrame:
    """All conversations in windows of 2048 tokens, read back, with one whose texts are control strings."""
    odd = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.digests(chat.windows(turns))


def op2_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Words and tokens of every document."""
    return counts.token_counts(table(spark, directory, "documents").select("doc_id", "text"), PIECES).drop("text")


def quality_model(spark: SparkSession, directory: str) -> quality.Model:
    """The classifier that the query and the pipeline share, from the labels outside the held-out fold."""
    fold = fold_of("doc_id", 5)
    labels = table(spark, directory, "labels").where(fold > 0)
    return quality.fit(table(spark, directory, "documents"), labels)


def _judged(scored: DataFrame, folds: int, held: int) -> DataFrame:
    return scored.select(
        "doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op3_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of every document."""
    model = quality_model(spark, directory)
    return _judged(quality.score(table(spark, directory, "documents").select("doc_id", "text"), model), 5, 0)


def op4_bpe(spark: SparkSession, directory: str) -> DataFrame:
    """Codes and decoded texts of every document."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, WORDS), "doc_id")


def op5_language(spark: SparkSession, directory: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, directory, "documents")
    model = saved(langid.prototypes(docs.where(fold_of("doc_id", 5) > 0)), "prototypes")
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """Toxicity of every document."""
    docs, fold = table(spark, directory, "documents"), fold_of("doc_id", 4)
    model = toxicity.fit(docs, table(spark, directory, "labels").where((fold >= 0) & (fold != 2)))
    return _judged(toxicity.score(docs.select("doc_id", "text"), model), 4, 2)


def op7_repeats(spark: SparkSession, directory: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that repeat, and whether a passage of 50 words of it repeats."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    cut = suffix.remove(suffix.repeats(docs, words=PASSAGE_WORDS, passages="passages"))
    return cut.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.col("removed").alias("n_removed"),
        F.col("runs").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("runs") > 0).alias("has_repeats"),
        (F.size("passages") > 0).alias("has_passages"),
    )


def op8_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, directory, "documents"), "doc_id", "text", shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_search(spark: SparkSession, directory: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = table(spark, directory, "embeddings").where(topk.usable("embedding"))
    return topk.search(vectors.select("vec_id", topk.whole_codes("embedding").alias("codes")), F.col("vec_id") % 50 == 0)


def op10_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    """Verified overlaps of documents with benchmark items."""
    return decontaminate.contaminated(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


def op11_spelling(spark: SparkSession, directory: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(spelling.words(table(spark, directory, "documents")))


def op12_divergence(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of sources of every language, and the terms that tell a source from its language."""
    return divergence.divergence(table(spark, directory, "documents"))


def op13_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """Words that a mix of one and a half times the documents takes of each."""
    docs = table(spark, directory, "documents")
    rows = saved(docs.select("doc_id", "source", mixing.words().alias("size"), mixing.draw(13, "doc_id", "text").alias("draw")), "rows")
    return mixing.allot(rows, mixing.cycle_weights(rows, [5, 2, 1])).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (op1_chat, op2_token_counts, op3_quality, op4_bpe, op5_language, op6_toxicity, op7_repeats,
              op8_near_duplicates, op9_search, op10_decontaminate, op11_spelling, op12_divergence, op13_mixing)
}
ORACLES = {"op1_chat": chat.ORACLE, "op9_search": topk.ORACLE, "op11_spelling": spelling.ORACLE,
           "op12_divergence": divergence.ORACLE, "op13_mixing": mixing.ORACLE}
