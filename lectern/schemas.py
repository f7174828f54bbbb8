"""Schemas of the library tables (fixed values: column names and defaults)."""

from __future__ import annotations


TABLES = {
    "documents": (
        "uuid string, name string, source string, mime_type string, original_file_name string,"
        " file_size bigint, file_path string, status string, extracted_text string,"
        " is_favorite boolean, category string, created_at timestamp, updated_at timestamp,"
        " last_opened_at timestamp, failure_message string, metadata string"
    ),
    "document_pages": (
        "uuid string, document_id string, page_number int, source_type string,"
        " image_path string, width int, height int"
    ),
    "document_blocks": (
        "uuid string, document_id string, page_id string, type string, level int,"
        " content string, ord int, left double, top double, width double, height double,"
        " confidence double, metadata string"
    ),
    "document_images": (
        "uuid string, document_id string, page_id string, page_number int, source_type string,"
        " file_path string, format string, width int, height int, file_size bigint"
    ),
    "tts_audio": (
        "text_hash string, voice_id string, speed double, format string, file_path string,"
        " duration_ms bigint, sample_rate int, channels int, last_accessed_at timestamp"
    ),
    "reading_progress": (
        "document_id string, page_number int, block_id string, sentence_index int,"
        " position_ms bigint, updated_at timestamp"
    ),
    "settings": ("key string, value string, updated_at timestamp"),
    "models": (
        "uuid string, engine_id string, checkpoint_name string, version string, license string,"
        " size_bytes bigint, is_installed boolean, is_active boolean, checksum string,"
        " installed_at timestamp"
    ),
    "processing_jobs": (
        "uuid string, type string, document_id string, status string, progress int,"
        " error_message string, payload string, created_at timestamp, updated_at timestamp"
    ),
}

# Allowed values of the enumerated columns and the value unknown names fall back to.
ENUMS = {
    "document_status": (("queued", "extracting", "ocr", "ready", "failed"), "ready"),
    "document_source": (
        ("typedText", "camera", "image", "pdf", "textFile", "markdown", "epub"),
        "typedText",
    ),
    "block_type": (
        ("title", "heading", "paragraph", "image", "table", "list", "footnote", "unknown"),
        "unknown",
    ),
    "speech_format": (("wav", "mp3"), "wav"),
}

PAGE_SOURCE_TYPE = {
    "camera": "camera",
    "image": "imported",
    "pdf": "pdf",
    "epub": "epub",
    "typedText": "text",
    "textFile": "text",
    "markdown": "text",
}
