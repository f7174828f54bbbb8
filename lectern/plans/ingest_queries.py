"""Ingest, export and file audits over files that Spark derives from the given tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions.files import FAILURES, retryable
from ..operators import layout, maintenance
from ..operators import sentences as N
from ..operators.ordered import shared_folder
from ..operators.speech import little_endian, wav_header
from ..sources import exports, files
from ..sources.epub import epub_to_blocks
from ..sources.html import frames, html_plain_text, html_to_blocks
from ..sources.library import persist_documents, read_library, write_library
from ..sources.voices import read_voices
from ..sources.wav import wav_inventory
from . import oracle_text as O
from ..streaming import streams
from .base import _both, query
from .text_queries import MARKDOWN_BLOCKS, markdown_files


# -- derived files -------------------------------------------------------------------


_CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
_PACKAGE = (
    '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book {0}</dc:title></metadata><manifest>'
    '<item id="c1" href="one.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="two.xhtml#x" media-type="application/xhtml+xml"/>'
    '<item id="css" href="a.css" media-type="text/css"/></manifest><spine><itemref idref="c2"/><itemref idref="c1" linear="no"/>'
    '<itemref idref="css"/><itemref idref="c1"/></spine></package>'
)


def _container(key, chapters: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("mimetype", "application/epub+zip")
        archive.writestr("META-INF/container.xml", _CONTAINER)
        archive.writestr("OEBPS/book.opf", _PACKAGE.format(key))
        for name, page in chapters.items():
            archive.writestr(f"OEBPS/{name}", page)
    return data.getvalue()


_MARKDOWN, _BOOK = "doc_id % 12 = 10", "doc_id % 24 = 16"


def text_books(docs):
    """A book per document, a paragraph per line."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = ("".join(f"<p>{escape(line)}</p>" for line in text.split("\n")) for text in batch["text"].fillna(""))
            out = (
                (key, _container(key, {"one.xhtml": f"<html><body>{page}</body></html>", "two.xhtml": "<html><body></body></html>"}))
                for key, page in zip(batch["doc_id"], pages)
            )
            yield from frames(out, ["document_id", "content"])

    return docs.select("doc_id", "text").mapInPandas(pack, "document_id bigint, content binary")


def file_set(lib):
    """One file per document: every accepted kind, disguised files, damaged books and binary noise."""
    text = F.encode("text", "UTF-8")
    prefixed = lambda digits: F.concat(F.unhex(F.lit(digits)), text)
    kind = (F.col("doc_id") % 12).cast("int")
    stored = F.concat(
        F.unhex(F.lit("504B0304140000000000000000000000000014000000140000000800")), little_endian(F.lit(0), 2),
        F.encode(F.lit("mimetypeapplication/epub+zip"), "UTF-8"), text,
    )
    utf16 = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    content = (
        F.when(kind == 0, prefixed("255044462D312E37")).when(kind == 1, prefixed("89504E470D0A1A0A"))
        .when(kind == 2, prefixed("FFD8FFE0")).when(kind == 3, prefixed("524946460000000057454250"))
        .when(kind == 4, stored).when(kind == 5, prefixed("25504446")).when(kind == 6, prefixed("000102"))
        .when(kind == 7, F.lit(b"")).when(kind == 8, utf16).when(kind == 9, F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8"))
        .otherwise(text)
    )
    names = ["a.pdf", "b.png", "c.JPG", "d.webp", "e.epub", "f.txt", "g.txt", "h.md", "i.txt", "j.txt", "k.md", "l.png"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), kind + 1)
    made = ["document_id", "name", "content"]
    plain = lib.wide("documents").where(f"not ({_MARKDOWN} or {_BOOK})").select(
        F.col("doc_id").alias("document_id"), name.alias("name"), content.alias("content"),
    )
    marked = markdown_files(lib).where(_MARKDOWN).select(
        F.col("doc_id").alias("document_id"), F.lit("k.md").alias("name"), F.encode("text", "UTF-8").alias("content"),
    )
    bound = text_books(lib.wide("documents").where(_BOOK)).withColumn("name", F.lit("e.epub"))
    files = plain.unionByName(marked).unionByName(bound.select(made))
    return files.withColumn("length", F.length("content").cast("bigint"))


@query(
    "a2_validate_files",
    """select document_id, case k when 0 then 'pdf' when 1 then 'imagePng' when 2 then 'imageJpeg' when 3 then 'imageWebp' when 4 then 'epub' when 9 then 'text' when 10 then 'markdown' end as kind,
       case k when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'image/jpeg' when 3 then 'image/webp' when 4 then 'application/epub+zip' when 9 then 'text/plain' when 10 then 'text/markdown' end as mime_type,
       k in (0, 1, 2, 3, 4, 9, 10) as accepted, case k when 5 then 'renamed' when 6 then 'not_text' when 7 then 'unreadable' when 8 then 'not_text' when 11 then 'mismatch' end as reason
       from (select doc_id as document_id, cast(doc_id % 12 as int) as k from {documents})""",
)
def a2(lib):
    return files.validate_files(file_set(lib)).select("document_id", "kind", "mime_type", "accepted", "reason")


_LINE = O.trim(O.rx("line", "[ \\t\\r\\f\\v]+", " "))


@query(
    "k1_ingest_blocks",
    f"""select doc_id as document_id, unnest(range(len(ps))) as ord, 'paragraph' as type, cast(0 as int) as level, unnest(ps) as content, '{{{{}}}}' as metadata from (select doc_id,
        list_filter(list_transform(string_split_regex(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[{O.H}]+(\\n|$)', '\\1', 'g'), '\\n{{{{2,}}}}'),
        lambda p: {O.trim('p')}), lambda p: p <> '') as ps from {{documents}} where doc_id % 12 = 9)
        union all select doc_id, ord, type, level, content, metadata from ({MARKDOWN_BLOCKS}) where {_MARKDOWN}
        union all select doc_id, 0, 'title', 1, 'Book ' || doc_id, '{{{{}}}}' from {{documents}} where {_BOOK}
        union all select doc_id, row_number() over (partition by doc_id order by pos), 'paragraph', 0, content, '{{{{}}}}'
          from (select doc_id, pos, {_LINE} as content from (select doc_id, pos, content as line from {{lib_lines}} where {_BOOK})) where content <> ''""",
)
def k1(lib):
    blocks, _ = files.ingest(file_set(lib))
    return blocks.select("document_id", F.col("ord").cast("bigint").alias("ord"), "type", "level", "content", "metadata")


@query(
    "k1_ingest_rejects",
    """select document_id, case when k = 0 then 'unsupported_format' when k in (1, 2, 3) then 'model_unavailable' else 'validation' end as failure,
       case k when 0 then 'pdf' when 4 then 'damaged' when 5 then 'renamed' when 6 then 'not_text' when 7 then 'unreadable' when 8 then 'not_text' when 11 then 'mismatch' else 'ocr' end as detail, false as retryable
       from (select doc_id as document_id, cast(doc_id % 12 as int) as k from {documents} where doc_id % 24 <> 16) where k not in (9, 10)""",
)
def k1_rejects(lib):
    return files.ingest(file_set(lib))[1]


@query(
    "k2_failures",
    "select event_id, event_type as failure, " + " ".join(["case cast(event_id % 12 as int)"] + [f"when {i} then {str(v).lower()}" for i, v in enumerate(FAILURES.values())] + ["else true end as retryable from {events}"]),
)
def k2(lib):
    names = F.element_at(F.array(*[F.lit(n) for n in (*FAILURES, "no such class")]), (F.col("event_id") % 12).cast("int") + 1)
    return lib["events"].select("event_id", F.col("event_type").alias("failure"), retryable(names).alias("retryable"))


# -- markup --------------------------------------------------------------------------


@query("a5_html_blocks")
def a5(lib):
    return html_to_blocks(lib.wide("pages"))


@query(
    "a5_html_headings",
    f"""select page_id, 1 as level, {O.trim(O.rx("replace(replace(replace(replace(h, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34))", '[ \\t\\r\\f\\v]+', ' '))} as content
        from (select page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) as h from {{pages}})""",
)
def a5_headings(lib):
    return html_to_blocks(lib.wide("pages")).filter("type = 'heading'").select("page_id", "level", "content")


@query("a5_html_plain_text")
def a5_text(lib):
    return html_plain_text(lib.wide("pages"))


def books(lib):
    """A container per web page: a chapter with the page and a chapter of plain paragraphs."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = (
                (key, _container(key, {
                    "one.xhtml": html,
                    "two.xhtml": f"<html><body><p>First of {key}</p><p> second\n\n\npart </p></body></html>",
                }))
                for key, html in zip(batch["page_id"], batch["html"])
            )
            yield from frames(out, ["document_id", "content"])

    return lib.wide("pages").select("page_id", "html").mapInPandas(pack, "document_id bigint, content binary")


@query("a6_epub_blocks")
def a6(lib):
    return epub_to_blocks(books(lib))


@query(
    "a6_epub_front_matter",
    """select page_id as document_id, o.i as ord, o.t as type, cast(case when o.i = 0 then 1 else 0 end as int) as level,
       case o.i when 0 then 'Book ' || page_id when 1 then 'First of ' || page_id else 'second' || chr(10) || 'part' end as content
       from {pages}, (values (0, 'title'), (1, 'paragraph'), (2, 'paragraph')) o(i, t)""",
)
def a6_front(lib):
    return epub_to_blocks(books(lib)).filter("ord < 3").select("document_id", "ord", "type", "level", "content")


# -- catalogue and nested documents --------------------------------------------------


@query(
    "a7_read_voices",
    """select label, cast(row_number() over (partition by label, vec_id // 50 order by vec_id) - 1 as int) as pos, 'v' || vec_id as id, case when vec_id % 3 = 0 then 'nữ' end as gender,
       cast(vec_id % 5 as int) as frames, 2 as codebooks, len(embedding) as dimensions, cast(vec_id % 5 * (vec_id % 7) as bigint) as code_sum
       from {embeddings} qualify vec_id % 5 > 0""",
)
def a7(lib):
    # A catalogue is one JSON object, here of at most fifty presets of one label.
    codes = F.transform(F.sequence(F.lit(1), (F.col("vec_id") % 5).cast("int")), lambda _: F.array(F.col("vec_id") % 7, F.lit(0).cast("bigint")))
    codes = F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<array<bigint>>")).otherwise(codes)
    entry = F.concat(
        F.lit('"v'), F.col("vec_id").cast("string"), F.lit('":'),
        F.to_json(F.struct(F.when(F.col("vec_id") % 3 == 0, "nữ").alias("gender"), codes.alias("codes"), F.col("embedding").alias("speaker_emb"))),
    )
    catalogues = lib["embeddings"].select("label", "vec_id", entry.alias("entry")).groupBy("label", F.floor(F.col("vec_id") / 50).alias("shelf")).agg(
        F.concat(F.lit('{"default_voice":"v0","presets":{'), F.expr("listagg(entry, ',') within group (order by vec_id)"), F.lit("}}")).alias("json")
    )
    voices = read_voices(catalogues)
    return voices.select(
        "label", "pos", "id", "gender", "frames", "codebooks", F.size("embedding").cast("bigint").alias("dimensions"),
        F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("code_sum"),
    )


_both("full_docs", """
select uuid, name, source, 'text/plain' as mime_type, uuid || '.txt' as original_file_name, cast(file_size as bigint) as file_size, 'files/' || uuid as file_path,
  status, extracted_text, is_favorite, category, created_at, updated_at, last_opened_at, failure_message, metadata from {lib_docs}""")
_both("full_blocks", """
select document_id, case when ord % 3 = 0 then null else 'own-' || uuid end as uuid, case when page_number is null then 'loose' else page_id end as page_id,
  page_number, type, level, content, ord, case when ord % 4 = 2 then null else (ord % 10) / cast(20 as double) end as left,
  (ord % 40) / cast(40 as double) as top, cast(0.5 as double) as width, cast(0.02 as double) as height, confidence, metadata from {lib_blocks}""")
_both("full_images", """
select document_id, uuid, case when page_number is null then null else document_id || '-p' || cast(page_number as string) end as page_id, page_number,
  'imported' as source_type, file_path, 'png' as format, cast(file_size % 997 as int) as width, cast(file_size % 499 as int) as height, cast(file_size as bigint) as file_size from {lib_images}""")


def stored_library(lib, *tables):
    """Tables of the library, split from nested documents, written to the shared folder and scanned again.

    The nesting is bounded by a document here, which is what the operator takes as one row.
    """
    times = ["created_at", "updated_at", "last_opened_at"]
    docs = lib["full_docs"].withColumns({c: F.timestamp_seconds(c) for c in times})
    nested = lambda frame, name: frame.groupBy(F.col("document_id").alias("uuid")).agg(
        F.collect_list(F.struct(*[c for c in frame.columns if c != "document_id"])).alias(name)
    )
    rows = docs.join(nested(lib.wide("full_blocks"), "blocks"), "uuid", "left").join(nested(lib["full_images"], "images"), "uuid", "left")
    directory = f"{shared_folder(lib.spark)}/library-{uuid.uuid4().hex}"
    write_library({t: f for t, f in persist_documents(rows).items() if t in tables}, directory)
    return [read_library(lib.spark, directory, t) for t in tables]


@query("a1_library_scan", "select * from {full_docs}")
def a1(lib):
    docs = stored_library(lib, "documents")[0]
    return docs.withColumns({c: F.unix_seconds(c) for c in ("created_at", "updated_at", "last_opened_at")})


@query(
    "a8_persist_blocks",
    """select coalesce(uuid, document_id || '-b' || ord) as uuid, document_id, case when page_number is null then page_id else document_id || '-p' || page_number end as page_id,
       type, level, content, ord, b."left" as "left", top, width, height, confidence, metadata from {full_blocks} b""",
)
def a8_blocks(lib):
    return stored_library(lib, "document_blocks")[0]


@query(
    "a8_persist_pages",
    """select distinct b.document_id || '-p' || b.page_number as uuid, b.document_id, b.page_number,
       case d.source when 'image' then 'imported' when 'camera' then 'camera' when 'pdf' then 'pdf' when 'epub' then 'epub' else 'text' end as source_type,
       cast(null as varchar) as image_path, cast(null as int) as width, cast(null as int) as height
       from {full_blocks} b join {lib_docs} d on d.uuid = b.document_id where b.page_number is not null""",
)
def a8_pages(lib):
    return stored_library(lib, "document_pages")[0]


@query("a8_persist_images", "select uuid, document_id, page_id, page_number, source_type, file_path, format, width, height, file_size from {full_images} where not starts_with(document_id, 'gone')")
def a8_images(lib):
    return stored_library(lib, "document_images")[0]


@query(
    "a8_persist_documents",
    """select 'documents' as table_name, count(*) as n from {lib_docs} union all select 'document_blocks', count(*) from {lib_blocks}
       union all select 'document_pages', count(*) from {lib_pages} union all select 'document_images', count(*) from {lib_images} where not starts_with(document_id, 'gone')""",
)
def a8(lib):
    names = ("documents", "document_blocks", "document_pages", "document_images")
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in zip(names, stored_library(lib, *names))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "a12_scan_files",
    """select doc_id as document_id, cast(strlen(text) as bigint) as length, sha256(text) as sha256 from {documents}""",
)
def a12(lib):
    """Size and digest of one file per document."""
    found = lib.wide("documents").select(F.col("doc_id").alias("document_id"), F.encode("text", "UTF-8").alias("content"))
    return files.digests(found.withColumn("length", F.length("content").cast("bigint"))).select("document_id", "length", "sha256")


@query(
    "j8_arrivals",
    """select document_id, "name", accepted, reason from (select doc_id as document_id, cast(doc_id % 12 as int) as k,
         ['a.pdf', 'b.png', 'c.JPG', 'd.webp', 'e.epub', 'f.txt', 'g.txt', 'h.md', 'i.txt', 'j.txt', 'k.md', 'l.png'][cast(doc_id % 12 as int) + 1] as name,
         k in (0, 1, 2, 3, 4, 9, 10) as accepted, case k when 5 then 'renamed' when 6 then 'not_text' when 7 then 'unreadable' when 8 then 'not_text' when 11 then 'mismatch' end as reason from {documents})""",
)
def j8(lib):
    """The batch twin of watching a folder: every file that arrived, named from its path and validated."""
    arrived = file_set(lib).withColumn("path", F.concat(F.lit("file:/in/"), "document_id", F.lit("/"), "name")).drop("name")
    return streams.arrivals(arrived).select("document_id", "name", "accepted", "reason")


# -- exports -------------------------------------------------------------------------


def _titled(lib):
    return lib.wide("documents").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit('Tài liệu "'), F.col("doc_id").cast("string"), F.lit('"')).alias("title"), "text"
    )


@query("a9_export_txt", f"select doc_id as document_id, cast(0 as bigint) as part, case when t = '' then '' else t || chr(10) end as content from (select doc_id, regexp_replace(text, '[{O.T}]+$', '') as t from {{documents}})")
def a9_txt(lib):
    return exports.render_exports(_titled(lib), None, "txt")


@query("a9_export_md", f"select doc_id as document_id, cast(0 as bigint) as part, regexp_replace('# Tài liệu \"' || doc_id || '\"' || chr(10) || chr(10) || {O.trim('text')}, '[{O.T}]+$', '') || chr(10) as content from {{documents}}")
def a9_md(lib):
    return exports.render_exports(_titled(lib), None, "md")


_ITEM = """chr(10) || '    {{' || chr(10) || '      "index": ' || idx || ',' || chr(10) || '      "text": ' || to_json(text)::varchar
  || case when idx % 3 = 0 then ',' || chr(10) || '      "durationMs": ' || length(text) else '' end || chr(10) || '    }}'"""


@query(
    "a9_export_json",
    f"""select d.doc_id as document_id, cast(0 as bigint) as part, '{{{{' || chr(10) || '  "title": ' || to_json('Tài liệu "' || d.doc_id || '"')::varchar || ',' || chr(10) || '  "text": ' || to_json({O.trim('d.text')})::varchar
        || ',' || chr(10) || '  "sentenceCount": ' || coalesce(s.n, 0) || ',' || chr(10) || '  "sentences": [' || coalesce(s.items || chr(10) || '  ]', ']') || chr(10) || '}}}}' || chr(10) as content
        from {{documents}} d left join (select doc_id, count(*) as n, string_agg({_ITEM}, ',' order by idx) as items from ({O.sentence_rows()}) group by 1) s using (doc_id)""",
)
def a9_json(lib):
    docs = _titled(lib)
    rows = N.sentences(docs).withColumn("duration_ms", F.when(F.col("idx") % 3 == 0, F.length("text")))
    return exports.render_exports(docs, rows, "json")


@query(
    "a10_export_outcome",
    """select l_orderkey as document_id, count(*) filter (where l_returnflag <> 'R') as written, count(*) filter (where l_returnflag = 'R') as failed,
       cast(sum(case when l_returnflag <> 'R' then l_quantity else 0 end) as bigint) as total_bytes,
       case when count(*) filter (where l_returnflag = 'R') = 0 then 'complete' when count(*) filter (where l_returnflag <> 'R') = 0 then 'total_failure' else 'partial' end as outcome
       from {lineitem} group by 1""",
)
def a10(lib):
    artifacts = lib["lineitem"].select(
        F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "R", "storage").alias("failure"),
        F.col("l_quantity").cast("bigint").alias("bytes"),
    )
    return exports.export_outcome(artifacts)


# -- audio files ---------------------------------------------------------------------


def recordings(lib):
    """A WAV file per event: plain, with extra chunks, truncated, compressed and not WAV at all."""
    n = (F.length("event_type") * 100 + F.col("event_id") % 97 * 2).cast("bigint")
    samples = F.encode(F.repeat(F.lit("ab"), (n / 2).cast("int")), "UTF-8")
    kind = (F.col("event_id") % 8).cast("int")
    fmt = F.when(kind == 3, 7).otherwise(1)
    head = wav_header(n, fmt, F.lit(1), F.lit(24000), F.lit(16))
    chunk = F.concat(F.encode(F.lit("LIST"), "UTF-8"), little_endian(F.lit(3), 4), F.unhex(F.lit("61626300")))
    content = (
        F.when(kind == 1, F.concat(F.substring(head, 1, 12), chunk, F.substring(head, 13, 32), samples))
        .when(kind == 2, F.concat(head, F.substring(samples, 1, 50)))
        .when(kind == 4, F.concat(head, samples, chunk, chunk))
        .when(kind == 5, F.encode(F.repeat(F.lit("RIFX"), 20), "UTF-8"))
        .when(kind == 6, F.substring(head, 1, 40))
        .otherwise(F.concat(head, samples))
    )
    return lib.wide("events").select("event_id", content.alias("content"))


@query(
    "a11_wav_inventory",
    """with e as (select event_id, cast(event_id % 8 as int) as k, cast(length(event_type) * 100 + event_id % 97 * 2 as bigint) as n from {events})
       select event_id, case when k in (2, 5, 6) then null else n end as data_bytes, case when k in (2, 5, 6) then null when k = 3 then 7 else 1 end as audio_format,
       case when k in (2, 3, 5, 6) then null else cast(round(n * 1000 / 48000) as bigint) end as duration_ms,
       case k when 2 then 'truncated' when 3 then 'compressed' when 5 then 'not_wav' when 6 then 'too_short' end as reason from e""",
)
def a11(lib):
    return wav_inventory(recordings(lib), "event_id").select("event_id", "data_bytes", "audio_format", "duration_ms", "reason")


# -- storage and audits --------------------------------------------------------------

_both("lib_files", """
select file_path as path, file_size as length, uuid, case when page_number is null then 'temp' when page_number % 2 = 0 then 'documents' else 'audio' end as area
from {lib_images}""")


@query(
    "d12_cleanup_report",
    """select count(*) as deleted_files, cast(coalesce(sum(f.length), 0) as bigint) as freed_bytes from {lib_images} i join {lib_files} f on f.path = i.file_path
       where f.area <> 'temp' and not exists (select 1 from {lib_docs} d where d.uuid = i.document_id)""",
)
def d12(lib):
    from ..operators.library import orphans

    present = lib["lib_files"].filter("area != 'temp'")
    return maintenance.cleanup_report(orphans(lib["lib_images"], lib["lib_docs"]), present)


@query("d17_storage_usage", "select area, count(*) as files, cast(sum(length) as bigint) as bytes from {lib_files} group by area")
def d17(lib):
    return files.storage_usage(lib["lib_files"])


@query(
    "d17_expired_temp",
    "select event_id, cast(round(value * 100) as bigint) as length from {events} where event_type = 'view' and ts < timestamp '2024-01-20 00:00:00'",
)
def d17_expired(lib):
    rows = lib["events"].select(
        "event_id", F.col("ts").cast("timestamp").alias("modified"), F.round(F.col("value") * 100).cast("bigint").alias("length"),
        F.when(F.col("event_type") == "view", "temp").otherwise("audio").alias("area"),
    )
    now = F.to_timestamp(F.lit("2024-01-20 23:59:59"))
    return files.expired_temp(rows, now, 86_399).select("event_id", "length")


_both("lib_manifest", """
select 'c' || cast(p_partkey % 97 as string) as component, 'm/' || cast(p_partkey as string) as path, p_partkey as pos, p_partkey * 10 as size_bytes,
  'h' || cast(p_partkey as string) as sha256, case when p_partkey % 11 = 3 then 'android' when p_partkey % 11 = 4 then 'linux' else '' end as platform
from {part}""")
_both("lib_present", """
select path, case when pos % 89 = 5 then 1 else size_bytes end as length, case when pos % 53 = 7 then 'x' else sha256 end as sha256
from {lib_manifest} where pos % 97 <> 12 and not (pos % 61 = 9)
union all select path || '.part', 3, '' from {lib_manifest} where pos = 109""")

_FAULTS = """(select m.*, p.length, case when p.length is null then 'missing' when p.length <> m.size_bytes then 'size' when p.sha256 <> m.sha256 then 'digest' end as fault,
  exists (select 1 from {lib_present} q where q.path = m.path || '.part') as partial
  from {lib_manifest} m left join {lib_present} p on p.path = m.path where m.platform in ('', 'linux'))"""


def _manifest(lib):
    platforms = F.when(F.col("platform") == "", F.array().cast("array<string>")).otherwise(F.array("platform"))
    return lib["lib_manifest"].withColumn("platforms", platforms)


@query(
    "c13_audit_manifest",
    f"""select component, count(*) as files, count(*) filter (where length = size_bytes) as present,
        case when count(*) filter (where length = size_bytes) = 0 and not bool_or(partial) then 'notInstalled' when count(fault) > 0 then 'corrupt' else 'installed' end as state,
        arg_min(path, pos) filter (where fault is not null) as bad_path, arg_min(fault, pos) filter (where fault is not null) as fault from {_FAULTS} group by component""",
)
def c13(lib):
    return maintenance.audit_manifest(_manifest(lib), lib["lib_present"], "linux")


@query("d13_model_sizes", f"select component, cast(sum(size_bytes) as bigint) as total_bytes, cast(coalesce(sum(length), 0) as bigint) as installed_bytes from {_FAULTS} group by component")
def d13(lib):
    return maintenance.model_sizes(_manifest(lib), lib["lib_present"], "linux")


@query(
    "e3_renumber_blocks",
    "select document_id, page, page_ord, row_number() over (partition by document_id order by page, page_ord) - 1 as ord from (select cast(l_suppkey as varchar) as document_id, l_linenumber as page, l_orderkey * 100000 + l_partkey as page_ord from {lineitem})",
)
def e3(lib):
    rows = lib["lineitem"].select(
        F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("page"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("ord"),
    )
    return layout.renumber_blocks(rows)


@query(
    "e3_renumber_pages",
    "select document_id, page, row_number() over (partition by document_id order by page) - 1 as page_index from (select document_id, page_number as page from {lib_pages} where page_number % 4 <> 2)",
)
def e3_pages(lib):
    return layout.renumber_pages(lib["lib_pages"].filter("page_number % 4 != 2").select("document_id", F.col("page_number").alias("page")))
