"""File kinds: extension, source and MIME columns, and the failure taxonomy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> (kind, document source, MIME type).
KINDS = {
    "pdf": ("pdf", "pdf", "application/pdf"),
    "txt": ("text", "textFile", "text/plain"),
    "md": ("markdown", "markdown", "text/markdown"),
    "epub": ("epub", "epub", "application/epub+zip"),
    "jpg": ("imageJpeg", "image", "image/jpeg"),
    "jpeg": ("imageJpeg", "image", "image/jpeg"),
    "png": ("imagePng", "image", "image/png"),
    "webp": ("imageWebp", "image", "image/webp"),
}
UNKNOWN_MIME = "application/octet-stream"

# Failure class -> retryable by default.
FAILURES = {
    "validation": False,
    "unsupported_format": False,
    "encrypted_document": False,
    "cancelled": False,
    "storage": True,
    "model_unavailable": False,
    "corrupt_model": True,
    "permission": False,
    "processing": True,
    "not_found": False,
    "unexpected": True,
}


def lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def extension_of(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(name, "(?s)\\.([^.]+)\\z", 1))


def file_type_columns(df, name: str = "name"):
    """Add extension, kind, document source and MIME type from the file name."""
    ext = extension_of(name)
    return df.select(
        "*",
        ext.alias("extension"),
        lookup({k: v[0] for k, v in KINDS.items()}, ext).alias("kind"),
        lookup({k: v[1] for k, v in KINDS.items()}, ext).alias("document_source"),
        F.coalesce(lookup({k: v[2] for k, v in KINDS.items()}, ext), F.lit(UNKNOWN_MIME)).alias("mime_type"),
    )


def retryable(failure: Column | str) -> Column:
    """Whether a failure class is worth retrying; unknown classes count as unexpected."""
    failure = F.col(failure) if isinstance(failure, str) else failure
    known = lookup(FAILURES, failure)
    return F.when(failure.isNotNull(), F.coalesce(known, F.lit(FAILURES["unexpected"])))
