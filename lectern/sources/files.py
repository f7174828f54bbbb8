"""File sets: listing, content validation, dispatch by kind and storage accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import KINDS, extension_of, lookup, retryable
from ..functions.text import bind, has_text, trim
from .epub import epub_to_blocks
from .plain import decode_text, markdown_to_blocks, text_to_blocks

MAX_BYTES = 200 * 1024 * 1024
HEAD_BYTES = 512
MAX_CONTROL_SHARE = 0.02


def read_files(spark: SparkSession, directory: str, pattern: str | None = None, most: int = MAX_BYTES) -> DataFrame:
    """Files with their bytes; of files over ``most`` bytes all but the bytes, which are null.

    The bound on ``length`` reaches the reader, so no byte of a larger file is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(directory)
    large = files.where(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= most).unionByName(large)


def scan_files(spark: SparkSession, directory: str, pattern: str | None = None) -> DataFrame:
    """Path, size and SHA-256 of every file; the digest of files that no row can hold (2 GiB) is null."""
    return digests(read_files(spark, directory, pattern, (1 << 31) - 1024)).select("path", "length", "sha256")


def digests(files: DataFrame) -> DataFrame:
    """Files with the SHA-256 of their bytes in place of them."""
    return files.withColumn("sha256", F.sha2("content", 256)).drop("content")


def _le(head: Column, offset: int, size: int) -> Column:
    """A little-endian unsigned integer at a 0-based offset."""
    digits = [F.hex(F.substring(head, offset + i + 1, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def _sniffed(head: Column) -> Column:
    """The kind that the first bytes prove, null when they prove none."""
    digits = F.hex(head)
    name_size, extra_size = _le(head, 26, 2), _le(head, 28, 2)
    stored = F.substring(head, F.lit(31) + name_size + extra_size, _le(head, 18, 4).cast("int")).cast("string")
    is_epub = (
        (F.length(head) >= 30)
        & (name_size == 8)
        & (F.substring(head, 31, 8) == F.encode(F.lit("mimetype"), "UTF-8"))
        & (trim(stored) == "application/epub+zip")
    )
    return (
        F.when(digits.startswith("25504446"), "pdf")
        .when(digits.startswith("89504E470D0A1A0A"), "imagePng")
        .when(digits.startswith("FFD8FF"), "imageJpeg")
        .when(digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250"), "imageWebp")
        .when(digits.startswith("504B0304") & is_epub, "epub")
    )


def _readable(head: Column) -> Column:
    """Text without NUL bytes and with few control characters."""
    raw = F.decode(head, "ISO-8859-1")
    control = F.regexp_count(raw, F.lit("[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]"))
    size = F.length(F.make_valid_utf8(head.cast("string")))
    return (F.instr(raw, "\0") == 0) & (control < size * MAX_CONTROL_SHARE)


def validate_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Add extension, kind, MIME type, accepted and the reason of a rejection.

    Only the first bytes are looked at, so the content column is read but never copied.
    """
    textual = F.col("extension").isin("txt", "md")
    claimed = lookup({k: v[0] for k, v in KINDS.items()}, F.col("extension"))
    probe = bind(
        F.substring("content", 1, HEAD_BYTES),
        lambda head: F.struct(
            _sniffed(head).alias("kind"), _readable(head).alias("readable"), (F.length(head) == 0).alias("empty")
        ),
    )
    probed = files.withColumn("extension", extension_of(name)).withColumn("_probe", probe)
    sniffed = F.col("_probe.kind")
    reason = (
        F.when(F.col("length") > MAX_BYTES, "too_large")
        .when(F.col("_probe.empty"), "unreadable")
        .when(sniffed.isNull() & ~textual, "mismatch")
        .when(sniffed.isNull() & ~F.col("_probe.readable"), "not_text")
        .when(sniffed.isNotNull() & ~sniffed.eqNullSafe(claimed), "renamed")
    )
    kind = F.when(F.col("reason").isNull(), F.coalesce(sniffed, claimed))
    return (
        probed.withColumn("reason", reason)
        .withColumn("kind", kind)
        .withColumn("mime_type", lookup({v[0]: v[2] for v in KINDS.values()}, F.col("kind")))
        .withColumn("accepted", F.col("reason").isNull())
        .drop("_probe")
    )


def ingest(files: DataFrame, id: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Blocks of every readable file, and one typed failure row for every other file."""
    checked = validate_files(files)
    of = lambda kind: checked.filter(F.col("accepted") & (F.col("kind") == kind))
    decoded = lambda kind: of(kind).select(id, decode_text("content").alias("text"))
    text, markdown, epub = decoded("text"), decoded("markdown"), epub_to_blocks(of("epub"), id)

    columns = [id, "ord", "type", "level", "content", "metadata"]
    blocks = (
        text_to_blocks(text.filter("text is not null"), id).select(columns)
        .unionByName(markdown_to_blocks(markdown.filter("text is not null"), id).select(columns))
        .unionByName(epub.filter("failure is null").select(columns))
    )

    def reject(df: DataFrame, failure: str, detail: Column) -> DataFrame:
        return df.select(id, F.lit(failure).alias("failure"), detail.alias("detail"))

    both = text.unionByName(markdown)
    images = F.col("accepted") & F.col("kind").startswith("image")
    rejects = (
        reject(checked.filter(~F.col("accepted")), "validation", F.col("reason"))
        .unionByName(reject(of("pdf"), "unsupported_format", F.lit("pdf")))
        .unionByName(reject(checked.filter(images), "model_unavailable", F.lit("ocr")))
        .unionByName(reject(both.filter("text is null"), "validation", F.lit("utf16")))
        .unionByName(reject(both.filter(F.col("text").isNotNull() & ~has_text("text")), "validation", F.lit("no_text")))
        .unionByName(reject(epub.filter("failure is not null"), "validation", F.col("failure")))
    )
    return blocks, rejects.withColumn("retryable", retryable("failure"))


def storage_usage(files: DataFrame) -> DataFrame:
    """Bytes and files per storage area."""
    return files.groupBy("area").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def expired_temp(files: DataFrame, now: Column, max_age_seconds: int = 86_400) -> DataFrame:
    """Temporary files last changed before the cutoff."""
    age = F.unix_seconds(now) - F.unix_seconds("modified")
    return files.filter((F.col("area") == "temp") & (age > max_age_seconds))
