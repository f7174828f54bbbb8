"""Documents to paragraphs to sentences.

A document's text sits in one row, so its sentences are cut, numbered and paired inside
that row: no shuffle, and the gapless index comes from the array position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_speech, paragraph_array, sentence_array
from .ordered import number_rows, slice_of


def paragraphs(df: DataFrame, id: str = "document_id", text: str = "text") -> DataFrame:
    return df.select(id, F.posexplode(paragraph_array(text)).alias("paragraph", "text"))


def _by_paragraph(text: Column | str) -> Column:
    return F.transform(paragraph_array(text), sentence_array)


def sentences(df: DataFrame, id: str = "document_id", text: str = "text") -> DataFrame:
    """``(id, idx, paragraph, position, text)`` with a gapless 0-based index per document."""
    rows = F.flatten(
        F.transform(
            _by_paragraph(text),
            lambda items, p: F.transform(
                items, lambda s, i: F.struct(p.alias("paragraph"), i.alias("position"), s.alias("text"))
            ),
        )
    )
    return df.select(id, F.posexplode(rows).alias("idx", "s")).select(id, "idx", "s.*")


def speech_sentences(df: DataFrame, id: str = "document_id", text: str = "text") -> DataFrame:
    """Spoken sentences beside the text to display.

    The display text comes from the same paragraph of the raw text where both have the same
    number of sentences, and is null elsewhere.
    """
    rows = F.flatten(
        F.transform(
            "spoken",
            lambda items, p: F.transform(
                items,
                lambda s, i: F.struct(
                    p.alias("paragraph"),
                    i.alias("position"),
                    s.alias("text"),
                    F.when(
                        F.size(F.get("shown", p)) == F.size(items), F.get(F.get("shown", p), i)
                    ).alias("display_text"),
                ),
            ),
        )
    )
    both = df.select(
        id, _by_paragraph(normalize_speech(text)).alias("spoken"), _by_paragraph(text).alias("shown")
    )
    return both.select(id, F.posexplode(rows).alias("idx", "s")).select(id, "idx", "s.*")


def pair_display(raw: DataFrame, spoken: DataFrame, id: str = "document_id") -> DataFrame:
    """The same pairing for two stored sentence tables."""
    counts = lambda df, name: df.groupBy(id, "paragraph").agg(F.count(F.lit(1)).alias(name))
    agree = counts(spoken, "n_spoken").join(counts(raw, "n_raw"), [id, "paragraph"])
    agree = agree.filter("n_spoken = n_raw").select(id, "paragraph")
    shown = raw.join(agree, [id, "paragraph"], "left_semi").select(
        id, "paragraph", "position", F.col("text").alias("display_text")
    )
    return spoken.join(shown, [id, "paragraph", "position"], "left")


def number_sentences(paragraph_sentences: DataFrame, id: str = "document_id") -> DataFrame:
    """Gapless sentence index for a stored table of (paragraph, position) rows."""
    return number_rows(
        paragraph_sentences, [id], ["paragraph", "position"],
        [F.col("paragraph"), slice_of("position")], coarse=lambda cuts: [slice_of(cuts[0], 4096)],
    )


def sentence_stats(sentence_rows: DataFrame, id: str = "document_id") -> DataFrame:
    return sentence_rows.groupBy(id).agg(
        F.count(F.lit(1)).alias("sentences"), (F.max("paragraph") + 1).alias("paragraphs")
    )


def paragraph_stats(sentence_rows: DataFrame, id: str = "document_id") -> DataFrame:
    return sentence_rows.groupBy(id, "paragraph").agg(F.count(F.lit(1)).alias("sentences"))


def block_to_sentence(hits: DataFrame, blocks: DataFrame, sentence_rows: DataFrame, id: str = "document_id") -> DataFrame:
    """The first sentence of each hit's block, null when blocks and paragraphs do not line up."""
    first = sentence_rows.groupBy(id, "paragraph").agg(F.min("idx").alias("first_idx"))
    shape = (
        sentence_rows.groupBy(id).agg((F.max("paragraph") + 1).alias("n_paragraphs"))
        .join(blocks.groupBy(id).agg(F.count(F.lit(1)).alias("n_blocks")), id)
    )
    aligned = shape.filter("n_paragraphs = n_blocks").select(id)
    starts = first.join(aligned, id, "left_semi").select(
        id, F.col("paragraph").alias("block_order"), F.col("first_idx").alias("sentence_index")
    )
    return hits.join(starts, [id, "block_order"], "left")
