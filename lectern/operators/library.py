"""Library views: filters, lookups, sorts, counts and joins over the stored tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import decode_json
from ..functions.text import has_text
from .ordered import parts, positions, slice_of

LOW_CONFIDENCE = 0.85
PAGE_SIZE = 50
IN_PROGRESS = ("queued", "extracting", "ocr")
LOG_LEVELS = ("debug", "info", "warning", "error")
SORT_KEYS = {
    "name": "name",
    "createdAt": "created_at",
    "updatedAt": "updated_at",
    "fileSize": "file_size",
    "lastOpenedAt": "last_opened_at",
}
# A row of output never carries more than about this many characters or bytes.
PART_BUDGET = 8 * 1024 * 1024


# -- filters and projections ---------------------------------------------------------


def filter_library(
    docs: DataFrame,
    query: str | None = None,
    status: str | None = None,
    source: str | None = None,
    favorite: bool | None = None,
    category: str | None = None,
) -> DataFrame:
    """Every argument left empty is ignored; the query is a literal, case-insensitive substring."""
    if status is not None:
        docs = docs.filter(F.col("status") == status)
    if source is not None:
        docs = docs.filter(F.col("source") == source)
    if favorite is not None:
        docs = docs.filter(F.col("is_favorite") == favorite)
    if category:
        docs = docs.filter(F.col("category") == category)
    if query:
        needle = F.lower(F.lit(query))
        docs = docs.filter(
            F.contains(F.lower("name"), needle) | F.contains(F.lower("extracted_text"), needle)
        )
    return docs


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def pending_jobs(jobs: DataFrame) -> DataFrame:
    return sorted_by(jobs.filter(F.col("status").isin(*IN_PROGRESS)), PENDING)


def history(docs: DataFrame) -> DataFrame:
    return sorted_by(docs.filter(F.col("last_opened_at").isNotNull()), HISTORY)


def favorites(docs: DataFrame) -> DataFrame:
    return sorted_by(docs.filter("is_favorite"), FAVORITES)


def low_confidence(df: DataFrame) -> DataFrame:
    return df.filter(F.col("confidence") < LOW_CONFIDENCE)


def speakable(blocks: DataFrame) -> DataFrame:
    skipped = F.coalesce(decode_json("metadata")["skip_in_read_aloud"] == "true", F.lit(False))
    return blocks.filter((F.col("type") != "footnote") & ~skipped)


def outline(blocks: DataFrame) -> DataFrame:
    return sorted_by(blocks.filter(F.col("type").isin("title", "heading")), OUTLINE)


def job_views(jobs: DataFrame) -> DataFrame:
    status = F.col("status")
    return jobs.select(
        "*",
        status.isin("queued", "running").alias("is_active"),
        status.isin("succeeded", "failed", "cancelled").alias("is_terminal"),
        (status == "failed").alias("is_failed"),
        ((status == "failed") & F.coalesce("retryable", F.lit(False))).alias("is_retryable"),
    )


def filter_logs(logs: DataFrame, level: str) -> DataFrame:
    return logs.filter(F.col("level").isin(*LOG_LEVELS[LOG_LEVELS.index(level):]))


def with_doc_flags(docs: DataFrame) -> DataFrame:
    raw = decode_json("metadata")["ocr_low_confidence_blocks"]
    count = F.coalesce(F.when(raw.rlike("^-?[0-9]+$"), raw.try_cast("bigint")), F.lit(0))
    return docs.select(
        "*",
        has_text("extracted_text").alias("has_text"),
        F.col("status").isin(*IN_PROGRESS).alias("is_processing"),
        count.alias("low_confidence_count"),
        (count > 0).alias("needs_ocr_review"),
    )


# -- sorts, pages and limits ---------------------------------------------------------

# An order is a list of (column, ascending); nulls come first where it rises and last where it falls.
Order = list[tuple[str, bool]]
PENDING: Order = [("created_at", True), ("uuid", True)]
HISTORY: Order = [("last_opened_at", False), ("uuid", True)]
FAVORITES: Order = [("updated_at", False), ("uuid", True)]
OUTLINE: Order = [("document_id", True), ("ord", True)]
NATURAL: dict[str, Order] = {
    "pages": [("document_id", True), ("page_number", True), ("uuid", True)],
    "blocks": [("document_id", True), ("ord", True), ("uuid", True)],
    "images": [("document_id", True), ("page_number", True), ("uuid", True)],
}


def library_order(key: str = "updatedAt", ascending: bool = False) -> Order:
    """One of the five library orders; the id breaks ties so that pages are stable."""
    return [(SORT_KEYS[key], ascending), ("uuid", True)]


def sorted_by(df: DataFrame, order: Order) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order])


def sort_library(docs: DataFrame, key: str = "updatedAt", ascending: bool = False) -> DataFrame:
    return sorted_by(docs, library_order(key, ascending))


def page(ordered: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of an already totally ordered frame, by its number: every page before it is gathered too."""
    return ordered.offset(number * size).limit(size)


def _beyond(column: str, ascending: bool, value, inclusive: bool = False) -> Column:
    """Rows whose value comes after ``value`` in one column of an order (or is equal to it)."""
    own = F.col(column)
    if value is None:  # nulls come first where the order rises and last where it falls
        return F.lit(True) if ascending and inclusive else own.isNotNull() if ascending else own.isNull() & F.lit(inclusive)
    if ascending:
        return own >= value if inclusive else own > value
    return (own <= value if inclusive else own < value) | own.isNull()


def after(order: Order, cursor: tuple) -> Column:
    """Rows behind the cursor, the values of the order's columns in the last row seen.

    The bound on the first column stands alone as well, so that a scan can skip by it.
    """
    behind, equal = F.lit(False), F.lit(True)
    for (column, ascending), value in zip(order, cursor, strict=True):
        behind = behind | (equal & _beyond(column, ascending, value))
        equal = equal & F.col(column).eqNullSafe(F.lit(value))
    return _beyond(*order[0], cursor[0], inclusive=True) & behind


def page_after(df: DataFrame, order: Order, cursor: tuple | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """The page behind a cursor, or the first one.

    The filter reaches the scan and the page is a top-k of what is behind it, so the depth of a page
    costs nothing.  The order has to be total: its last column tells rows apart.
    """
    return sorted_by(df if cursor is None else df.filter(after(order, cursor)), order).limit(size)


def last_key(page: DataFrame, order: Order) -> tuple | None:
    """The cursor behind a page: the key of its last row, null for an empty page."""
    row = sorted_by(page.select(*[c for c, _ in order]), [(c, not up) for c, up in order]).first()
    return None if row is None else tuple(row)


def pages(df: DataFrame, order: Order, size: int = PAGE_SIZE) -> Iterator[DataFrame]:
    """Page after page from the first to the last; only a cursor of one row passes through the driver."""
    cursor = None
    while True:
        found = page_after(df, order, cursor, size)
        cursor = last_key(found, order)
        if cursor is None:
            return
        yield found


def numbered_pages(df: DataFrame, order: Order, size: int = PAGE_SIZE, name: str = "page") -> DataFrame:
    """The rows of all pages at once, each with the number of its page: what ``pages`` finds one by one.

    A page begins behind the last key of the one before, so its first place follows from the places in the
    order, except where rows of one key lie across the end of a page: those behind it are passed over, as they are not behind
    the cursor.  Only such keys of several rows go through the driver, one by one; a total order has none.
    """
    spark, keys = df.sparkSession, [c for c, _ in order]
    placed = positions(df, order, "_place")
    ties = placed.groupBy(*keys).agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("first", "n")
    runs, start, number = [], 0, 0  # runs of pages without a row passed over: first place, end, number of the first page
    for first, n in ties.orderBy("first").toLocalIterator():
        full = (first - start) // size + 1
        end = start + full * size
        if end < first + n:
            runs.append((start, end, number))
            start, number = first + n, number + full
    total = placed.count()
    if start < total:
        runs.append((start, total, number))
    starts = spark.createDataFrame(runs, "begin long, stop long, number long").select(
        "stop", "number", "begin", F.posexplode(F.sequence("begin", F.col("stop") - 1, F.lit(size))).alias("_nth", "_from")
    ).select(
        (F.col("number") + F.col("_nth")).cast("int").alias(name), "_from", F.least(F.col("_from") + size, "stop").alias("_to")
    )
    # A page meets at most two cells of its size.
    cell = lambda at: F.floor(at / F.lit(size))
    starts = starts.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col("_from")), cell(F.col("_to") - 1)))))
    inside = (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))
    return placed.withColumn("_cell", cell(F.col("_place"))).join(starts, "_cell").filter(inside).select(*df.columns, name)


def natural_order(df: DataFrame, kind: str) -> DataFrame:
    return sorted_by(df, NATURAL[kind])


def log_tail(logs: DataFrame, n: int = 200) -> DataFrame:
    return logs.orderBy(F.col("at").desc(), F.col("seq").desc()).limit(n)


# -- counts --------------------------------------------------------------------------


def library_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("uuid").alias("document_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("storage_bytes"),
    )


def filtered_count(docs: DataFrame, **filters) -> DataFrame:
    return filter_library(docs, **filters).agg(F.count(F.lit(1)).alias("document_count"))


def categories(docs: DataFrame) -> DataFrame:
    return docs.filter(has_text("category")).select("category").distinct().orderBy("category")


def cache_count(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("text_hash").alias("cached"))


def job_summary(jobs: DataFrame) -> DataFrame:
    active = F.count_if(F.col("status").isin("queued", "running"))
    return jobs.agg(
        active.alias("active"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        (active > 0).alias("busy"),
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """Pages with a text layer and pages that need recognition, with the wording of the report."""
    counted = pages.groupBy("document_id").agg(
        F.count_if("has_text_layer").alias("text_pages"),
        F.count_if(~F.col("has_text_layer")).alias("ocr_pages"),
    )
    return counted.select(
        "*",
        F.concat_ws(
            " · ",
            F.when(F.col("text_pages") > 0, F.concat(F.col("text_pages").cast("string"), F.lit(" trang có text"))),
            F.when(F.col("ocr_pages") > 0, F.concat(F.col("ocr_pages").cast("string"), F.lit(" trang chạy OCR"))),
        ).alias("summary"),
    )


def dominant_language(blocks: DataFrame) -> DataFrame:
    """``vi-VN`` where Vietnamese was seen at all, else the first language seen."""
    return blocks.groupBy("document_id").agg(
        F.when(F.max(F.col("lang") == "vi"), "vi-VN").otherwise(F.min_by("lang", "ord")).alias("language")
    )


# -- joins and assembly --------------------------------------------------------------


def block_locations(blocks: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with the name of their document and the number of their page."""
    names = docs.select(F.col("uuid").alias("document_id"), F.col("name").alias("document_name"))
    numbers = pages.select(F.col("uuid").alias("page_id"), "page_number")
    return (
        blocks.select("document_id", "page_id", "ord", "content")
        .join(names, "document_id")
        .join(numbers, "page_id", "left")
        .select("document_id", "document_name", "page_number", "ord", "content")
    )


def _bundles(df: DataFrame, fields: list[str], name: str, budget: int) -> DataFrame:
    sized = parts(df, ["document_id"], ["ord"], [slice_of("ord")], F.coalesce(F.length("body"), F.lit(0)) + 64, budget)
    return sized.groupBy("document_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("ord", *fields))).alias(name)
    )


def assemble(docs: DataFrame, blocks: DataFrame, images: DataFrame, budget: int = PART_BUDGET) -> DataFrame:
    """Documents with their ordered blocks and images nested.

    A document whose blocks outgrow one row continues in rows with the next ``part``.
    """
    block_parts = _bundles(
        blocks.select("document_id", "ord", "type", F.col("content").alias("body")), ["type", "body"],
        "blocks", budget,
    )
    image_parts = _bundles(
        images.select("document_id", "ord", F.col("file_path").alias("body")), ["body"], "images", budget
    )
    nested = block_parts.join(image_parts, ["document_id", "part"], "full")
    return (
        docs.select(F.col("uuid").alias("document_id"), "name")
        .join(nested, "document_id", "left")
        .select(
            "document_id", "name", F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce("blocks", F.array()).alias("blocks"),
            F.coalesce("images", F.array()).alias("images"),
        )
    )


def document_text(pieces: DataFrame, budget: int = PART_BUDGET) -> DataFrame:
    """Ordered pieces joined by a blank line, blank pieces left out.

    Parts of one document, joined by the same separator, are its whole text.
    """
    full = pieces.filter(has_text("content"))
    sized = parts(full, ["document_id"], ["ord"], [slice_of("ord")], F.length("content") + 2, budget)
    return sized.groupBy("document_id", "part").agg(
        F.expr("listagg(content, '\n\n') within group (order by ord)").alias("text")
    )


def orphans(children: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose document is gone."""
    return children.join(docs.select(F.col("uuid").alias("document_id")), "document_id", "left_anti")


def resume_card(positions: DataFrame, docs: DataFrame) -> DataFrame:
    """The newest position with its document, only when that document has text."""
    newest = latest_position(positions)
    readable = docs.filter(has_text("extracted_text")).select(F.col("uuid").alias("document_id"), "name")
    return newest.join(readable, "document_id")


def latest_position(positions: DataFrame, per_document: bool = False) -> DataFrame:
    row = F.struct(*positions.columns)
    newest = F.max_by(row, F.struct("updated_at", "document_id")).alias("row")
    grouped = positions.groupBy("document_id") if per_document else positions.groupBy()
    return grouped.agg(newest).filter("row is not null").select("row.*")


def pages_from_blocks(blocks: DataFrame) -> DataFrame:
    """The page rows a document's blocks imply."""
    from ..functions.text import page_id_of

    return (
        blocks.filter(F.col("page_number").isNotNull())
        .select("document_id", "page_number")
        .distinct()
        .select(page_id_of("document_id", "page_number").alias("uuid"), "document_id", "page_number")
    )
