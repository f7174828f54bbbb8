"""Text exports and the report about them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim, trim_right
from ..operators.library import PART_BUDGET
from ..operators.ordered import parts, slice_of
from .ranges import opened, read_at

PACK_BUCKETS = 64


def _final_newline(c: Column) -> Column:
    body = trim_right(c)
    return F.when(body == "", body).otherwise(F.concat(body, F.lit("\n")))


def _quoted(c: Column | str) -> Column:
    """A JSON string literal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), "(?s)^\\{\"v\":|\\}$", "")


def render_txt(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.lit(0).cast("bigint").alias("part"), _final_newline(F.col("text")).alias("content"))


def render_markdown(docs: DataFrame) -> DataFrame:
    page = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), trim("text"))
    return docs.select("document_id", F.lit(0).cast("bigint").alias("part"), _final_newline(page).alias("content"))


def render_json(docs: DataFrame, sentences: DataFrame, exported_at: str | None = None, budget: int = PART_BUDGET) -> DataFrame:
    """Indented JSON.  A document with very many sentences continues in further parts,
    whose concatenation is the file."""
    item = F.concat(
        F.lit("\n    {\n      \"index\": "), F.col("idx").cast("string"),
        F.lit(",\n      \"text\": "), _quoted("text"),
        F.coalesce(F.concat(F.lit(",\n      \"durationMs\": "), F.col("duration_ms").cast("string")), F.lit("")),
        F.lit("\n    }"),
    )
    items = sentences.select("document_id", "idx", item.alias("item"))
    sized = parts(items, ["document_id"], ["idx"], [slice_of("idx")], F.length("item"), budget)
    body = sized.groupBy("document_id", "part").agg(
        F.expr("listagg(item, ',') within group (order by idx)").alias("body"),
        F.count(F.lit(1)).alias("n"),
    )
    counts = body.groupBy("document_id").agg(F.sum("n").alias("total"), F.max("part").alias("last"))
    stamp = F.lit(f"\n  \"exportedAt\": \"{exported_at}\"," if exported_at else "")
    head = F.concat(
        F.lit("{\n  \"title\": "), _quoted("title"), F.lit(","), stamp,
        F.lit("\n  \"text\": "), _quoted(trim("text")),
        F.lit(",\n  \"sentenceCount\": "), F.coalesce("total", F.lit(0)).cast("string"),
        F.lit(",\n  \"sentences\": ["),
    )
    part = F.coalesce("part", F.lit(0))
    first, last = part == 0, part == F.coalesce("last", F.lit(0))
    return (
        docs.select("document_id", "title", "text")
        .join(counts, "document_id", "left")
        .join(body, "document_id", "left")
        .select(
            "document_id",
            part.alias("part"),
            F.concat(
                F.when(first, head).otherwise(F.lit(",")),
                F.coalesce("body", F.lit("")),
                F.when(last, F.when(F.col("total") > 0, F.lit("\n  ]\n}\n")).otherwise(F.lit("]\n}\n")))
                .otherwise(F.lit("")),
            ).alias("content"),
        )
    )


def render_exports(docs: DataFrame, sentences: DataFrame, fmt: str) -> DataFrame:
    """``(document_id, part, content)`` in one of the formats txt, md and json."""
    if fmt == "txt":
        return render_txt(docs)
    if fmt == "md":
        return render_markdown(docs)
    return render_json(docs, sentences)


def write_exports(rendered: dict[str, DataFrame], directory: str) -> None:
    """One text file per document under ``format=.../document_id=...``.

    The writer ends every row with a line feed, so the one a part already has is dropped;
    between the parts of a JSON file the extra line feed is white space.
    """
    for fmt, frame in rendered.items():
        rows = frame.select(
            "document_id", "part", F.lit(fmt).alias("format"), F.regexp_replace("content", "\\n\\z", "").alias("value")
        )
        placed = rows.repartition("document_id").sortWithinPartitions("document_id", "part").drop("part")
        placed.write.mode("append").partitionBy("format", "document_id").text(directory)


def write_packed(rendered: dict[str, DataFrame], directory: str, buckets: int = PACK_BUCKETS) -> None:
    """Documents of all formats in at most ``buckets`` text files, and an index of where each lies.

    A document goes to the bucket of its hash, under ``files/bucket=...``; its parts follow each other, each ended
    by a line feed that is not part of it.  ``index`` has ``document_id, format, part, file, offset, length`` in bytes.
    Buckets are of even size for any number of documents; take about one for each 128 MB of text.
    """
    rows = reduce(DataFrame.unionByName, [f.select("document_id", "part", F.lit(fmt).alias("format"), "content") for fmt, f in rendered.items()])
    placed = rows.select("*", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int").alias("bucket")).repartition(buckets, "bucket")
    order = Window.partitionBy("bucket").orderBy("format", "document_id", "part")
    size = F.octet_length("content").cast("bigint")
    laid = placed.select("*", size.alias("length"), (F.sum(size + 1).over(order) - size - 1).alias("offset"))
    # The writer keeps this order, as it begins with the column the folders are named after.
    in_order = laid.sortWithinPartitions("bucket", "format", "document_id", "part")
    in_order.select(F.col("content").alias("value"), "bucket").write.partitionBy("bucket").text(f"{directory}/files")
    spark = rows.sparkSession
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{directory}/files")
    files = listed.select(F.col("path").alias("file"), F.regexp_extract("path", "/bucket=([0-9]+)/", 1).cast("int").alias("bucket"))
    laid.drop("content").join(files, "bucket").select("document_id", "format", "part", "file", "offset", "length").write.parquet(f"{directory}/index")


def read_packed(index: DataFrame) -> DataFrame:
    """``document_id, format, part, content`` of rows of an index; only their bytes are read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = []
                for path, offset, length in zip(*(part.column(i).to_pylist() for i in (3, 4, 5))):
                    with opened(path) as file:
                        texts.append(read_at(file, offset, length).decode())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(texts, pa.string())], names=["document_id", "format", "part", "content"])

    key = index.schema["document_id"].dataType.simpleString()
    return index.select("document_id", "format", "part", "file", "offset", "length").mapInArrow(
        fetch, f"document_id {key}, format string, part bigint, content string")


def export_outcome(artifacts: DataFrame) -> DataFrame:
    """Written and failed artifacts per document."""
    written, failed = F.count_if(F.col("failure").isNull()), F.count_if(F.col("failure").isNotNull())
    counted = artifacts.groupBy("document_id").agg(
        written.alias("written"),
        failed.alias("failed"),
        F.sum(F.when(F.col("failure").isNull(), F.col("bytes")).otherwise(F.lit(0))).alias("total_bytes"),
    )
    return counted.withColumn(
        "outcome",
        F.when((F.col("failed") == 0) & (F.col("written") > 0), "complete")
        .when((F.col("written") == 0) & (F.col("failed") > 0), "total_failure")
        .otherwise("partial"),
    )
