"""Case-insensitive literal search over blocks and names, with excerpts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TRIM
from .library import block_locations

BEFORE, AFTER, MAX_HITS = 48, 96, 200
# Fixed value: combining marks an excerpt must not start with.
COMBINING = "\\u0300-\\u036F\\u1AB0-\\u1AFF\\u20D0-\\u20FF\\uFE20-\\uFE2F"


def _needle(term: str) -> str:
    return re.sub(f"^[{TRIM}]+|[{TRIM}]+$", "", term)


def _position(text: Column, needle: str) -> Column:
    return F.instr(F.lower(text), F.lower(F.lit(needle)))


def _clip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{COMBINING}]+", "")


def _matches(df: DataFrame, column: str, needle: str) -> DataFrame:
    if not needle:
        return df.filter(F.lit(False))
    return df.filter(_position(F.col(column), needle) > 0)


def search_blocks(locations: DataFrame, term: str) -> DataFrame:
    """One row per block that contains the term, with ``before + match + after`` around it."""
    needle = _needle(term)
    content, size = F.col("content"), F.lit(len(needle))
    at = _position(content, needle)
    start = F.greatest(at - BEFORE, F.lit(1))
    return _matches(locations, "content", needle).select(
        "document_id",
        "document_name",
        "page_number",
        F.col("ord").alias("block_order"),
        _clip(F.substring(content, start, at - start)).alias("before"),
        F.substring(content, at, size).alias("match"),
        _clip(F.substring(content, at + size, F.lit(AFTER))).alias("after"),
        F.lit(False).alias("matched_in_title"),
    )


def title_hits(docs: DataFrame, body_hits: DataFrame, term: str) -> DataFrame:
    """Documents whose name matches and whose blocks do not."""
    needle = _needle(term)
    name, size = F.col("name"), F.lit(len(needle))
    at = _position(name, needle)
    named = _matches(docs.select(F.col("uuid").alias("document_id"), "name"), "name", needle)
    covered = body_hits.select("document_id").distinct()
    return named.join(covered, "document_id", "left_anti").select(
        "document_id",
        F.col("name").alias("document_name"),
        F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("int").alias("block_order"),
        F.substring(name, F.lit(1), at - 1).alias("before"),
        F.substring(name, at, size).alias("match"),
        F.substring(name, at + size, F.length(name)).alias("after"),
        F.lit(True).alias("matched_in_title"),
    )


def search(
    blocks: DataFrame, docs: DataFrame, pages: DataFrame, term: str, max_hits: int | None = MAX_HITS
) -> DataFrame:
    """Body hits followed by title hits.

    The term is tested on the blocks before anything is joined, and the bound is applied
    to the exact result in a total order, so it never hides a better hit.
    """
    hits = search_blocks(block_locations(_matches(blocks, "content", _needle(term)), docs, pages), term)
    every = hits.unionByName(title_hits(docs, hits, term))
    if max_hits is None:
        return every
    return every.orderBy("matched_in_title", "document_id", "block_order").limit(max_hits)


def hits_by_document(hits: DataFrame) -> DataFrame:
    return hits.groupBy("document_id").agg(F.count(F.lit(1)).alias("hits"))


def documents_hit(hits: DataFrame) -> DataFrame:
    return hits.agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("hits"))
