"""Typed scans of the library tables and the split of nested documents into them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import lookup
from ..functions.text import page_id_of
from ..schemas import PAGE_SOURCE_TYPE, TABLES


def read_library(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """Scan one stored table with its fixed schema, so no inference pass runs."""
    return spark.read.schema(TABLES[table]).parquet(os.path.join(directory, table))


def write_library(frames: dict[str, DataFrame], directory: str, mode: str = "append") -> None:
    for table, frame in frames.items():
        frame.write.mode(mode).parquet(os.path.join(directory, table))


def _field(frame: DataFrame, name: str) -> Column:
    return F.col(name) if name in frame.columns else F.lit(None)


def conform(frame: DataFrame, table: str) -> DataFrame:
    """The columns of a stored table in its order and types; those the input lacks are null, others go."""
    columns = [c.split() for c in TABLES[table].split(",")]
    return frame.select(*[_field(frame, name).cast(kind).alias(name) for name, kind in columns])


def _exploded(nested: DataFrame, column: str) -> DataFrame:
    return nested.select(F.col("uuid").alias("_document"), F.explode(column).alias("_row")).select("_document", "_row.*").withColumn(
        "document_id", F.col("_document")
    )


def persist_documents(nested: DataFrame) -> dict[str, DataFrame]:
    """Documents, pages, blocks and images from one nested row per document.

    Every table has all the columns of its schema.  Blocks and images keep the id, geometry,
    confidence and metadata they bring; a block without an id is named after its document and
    place, and its page follows from its page number where it has one.  Page rows are derived
    from the pages the blocks name.  A document is one input row, so its distinct pages are
    found inside that row and nothing is shuffled.
    """
    numbers = F.array_sort(
        F.array_distinct(F.filter(F.transform("blocks", lambda b: b["page_number"]), lambda n: n.isNotNull()))
    )
    pages = nested.select("uuid", "source", F.explode(numbers).alias("page_number")).select(
        page_id_of("uuid", "page_number").alias("uuid"),
        F.col("uuid").alias("document_id"),
        "page_number",
        lookup(PAGE_SOURCE_TYPE, F.col("source")).alias("source_type"),
    )
    blocks = _exploded(nested, "blocks")
    named = F.concat_ws("-b", "document_id", F.col("ord").cast("string"))
    blocks = blocks.withColumns({
        "uuid": F.coalesce(_field(blocks, "uuid"), named),
        "page_id": F.coalesce(page_id_of("document_id", "page_number"), _field(blocks, "page_id")),
    })
    frames = {
        "documents": nested.drop("blocks", "images"), "document_pages": pages,
        "document_blocks": blocks, "document_images": _exploded(nested, "images"),
    }
    return {table: conform(frame, table) for table, frame in frames.items()}
