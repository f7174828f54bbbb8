"""Text expressions and sentence operators over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, files, labels
from ..functions import text as X
from ..operators import sentences as N
from ..operators.layout import cell_count, is_list_line, list_text, table_text
from ..sources.plain import markdown_to_blocks, text_to_blocks
from . import oracle_text as O
from .base import _both, query

# Documents with numbers, prices and grouped thousands woven in, so that every reading
# rule is met at scale.
_both("numbered_docs", """
select doc_id, lang, source,
  replace(replace(text, '. ', '. ' || cast(doc_id * 7919 as string) || '% of ' || cast(doc_id % 900 as string) || '.' ||
    substr(cast(1000 + doc_id % 1000 as string), 2, 3) || ' VND and ' || cast(doc_id as string) || ',' || cast(doc_id % 97 as string) || '; '),
    ', ', ', ' || cast(doc_id * doc_id * 104729 as string) || ' ₫' || chr(10)) as text
from {documents}""")

# Documents with blank lines, carriage returns, abbreviations, addresses and initials.
_both("spaced_docs", """
select doc_id, lang, source, case when doc_id % 2 = 1 then replace(body, chr(10), chr(13) || chr(10)) else body end as text
from (select doc_id, lang, source,
  replace(replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(9) || chr(10) || '  '), ' the ', ' Dr. X. see www.a.vn/b.c. mail a.b@c.vn 3.14 v.v. '),
    ' de ', ' TS. Lê (etc.) “ok!” ') as body from {documents})""")

_SENTENCES = O.sentence_rows()


@query(
    "sentence_counts_by_language",
    f"""select lang, source, count(*) as sentences, cast(sum(length(text)) as bigint) as chars, count(distinct doc_id) as documents
        from ({O.sentence_rows(extra=', lang, source')}) group by lang, source""",
)
def sentence_counts(lib):
    """The flagship: documents to sentences to counts, with one shuffle of partial sums."""
    cut = N.sentences(lib.wide("documents").withColumn("k", F.struct("lang", "source")), "k")
    return cut.groupBy("k.lang", "k.source").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("idx") == 0).alias("documents"),
    )


@query("h3_normalize_whitespace", f"select doc_id, {O.whitespace('text')} as text from {{spaced_docs}}")
def h3(lib):
    return lib.wide("spaced_docs").select("doc_id", X.normalize_whitespace("text").alias("text"))


@query("h4_expand_units", f"select doc_id, {O.units('text')} as text from {{numbered_docs}}")
def h4(lib):
    return lib.wide("numbered_docs").select("doc_id", X.expand_units("text").alias("text"))


@query("h5_ungroup_thousands", f"select doc_id, {O.ungroup('text')} as text from {{numbered_docs}}")
def h5(lib):
    return lib.wide("numbered_docs").select("doc_id", X.ungroup_thousands("text").alias("text"))


@query("h6_read_number", f"select o_orderkey, {O.numbers('s')} as words from (select o_orderkey, cast(cast(round(o_totalprice * 100) as bigint) * o_orderkey as varchar) || ' / ' || cast(o_custkey as varchar) as s from {{orders}})")
def h6(lib):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.col("o_orderkey")
    return lib["orders"].select(
        "o_orderkey",
        X.read_numbers(F.concat(cents.cast("string"), F.lit(" / "), F.col("o_custkey").cast("string"))).alias("words"),
    )


@query("h7_normalize_speech", f"select doc_id, {O.speech('text')} as text from {{numbered_docs}}")
def h7(lib):
    return lib.wide("numbered_docs").select("doc_id", X.normalize_speech("text").alias("text"))


@query(
    "h8_paragraphs",
    f"select doc_id, unnest(range(len(ps))) as paragraph, unnest(ps) as text from (select doc_id, {O.paragraphs('text')} as ps from {{spaced_docs}})",
)
def h8(lib):
    return N.paragraphs(lib.wide("spaced_docs"), "doc_id").select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "text")


@query("h9_sentences", f"select doc_id, idx, paragraph, position, text from ({O.sentence_rows(table='{spaced_docs}')})")
def h9(lib):
    return N.sentences(lib.wide("spaced_docs"), "doc_id").select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("idx", "paragraph", "position")], "text"
    )


@query(
    "c12_speech_sentences",
    f"""with spoken as ({O.sentence_rows(text=O.speech('text'), table='{numbered_docs}')}),
        shown as ({O.sentence_rows(table='{numbered_docs}')}),
        ns as (select doc_id, paragraph, count(*) as n from spoken group by all), nr as (select doc_id, paragraph, count(*) as n from shown group by all)
        select s.doc_id, s.idx, s.paragraph, s.text, case when ns.n = nr.n then r.text end as display_text
        from spoken s join ns using (doc_id, paragraph) left join nr using (doc_id, paragraph)
        left join shown r on r.doc_id = s.doc_id and r.paragraph = s.paragraph and r.position = s.position""",
)
def c12(lib):
    return N.speech_sentences(lib.wide("numbered_docs"), "doc_id").select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("paragraph").cast("bigint").alias("paragraph"),
        "text", "display_text",
    )


@query(
    "c12_pair_stored_tables",
    """with s as (select document_id, cast(ord // 3 as bigint) as paragraph, cast(ord % 3 as bigint) as position, content from {lib_turns}),
       r as (select * from s where not (paragraph % 4 = 1 and position = 2)),
       ns as (select document_id, paragraph, count(*) as n from s group by all), nr as (select document_id, paragraph, count(*) as n from r group by all)
       select s.document_id, s.paragraph, s.position, case when ns.n = nr.n then '> ' || r.content end as display_text
       from s join ns using (document_id, paragraph) left join nr using (document_id, paragraph)
       left join r using (document_id, paragraph, position)""",
)
def c12_tables(lib):
    spoken = lib["lib_turns"].select(
        "document_id", F.floor(F.col("ord") / 3).alias("paragraph"), (F.col("ord") % 3).cast("bigint").alias("position"),
        F.col("content").alias("text"),
    )
    raw = spoken.filter("not (paragraph % 4 = 1 and position = 2)").withColumn("text", F.concat(F.lit("> "), "text"))
    return N.pair_display(raw, spoken).select("document_id", "paragraph", "position", "display_text")


@query(
    "e2_number_sentences",
    """select document_id, paragraph, position, row_number() over (partition by document_id order by paragraph, position) - 1 as idx
       from (select cast(doc_id as varchar) as document_id, pos // 4 as paragraph, pos % 4 as position from {lib_lines})""",
)
def e2(lib):
    rows = lib["lib_lines"].select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.floor(F.col("pos") / 4).alias("paragraph"), (F.col("pos") % 4).cast("bigint").alias("position"),
    )
    return N.number_sentences(rows)


@query("d8_sentence_stats", f"select doc_id, count(*) as sentences, max(paragraph) + 1 as paragraphs from ({O.sentence_rows(table='{spaced_docs}')}) group by doc_id")
def d8(lib):
    stats = N.sentence_stats(N.sentences(lib.wide("spaced_docs"), "doc_id"), "doc_id")
    return stats.select("doc_id", "sentences", F.col("paragraphs").cast("bigint").alias("paragraphs"))


@query("d8_paragraph_stats", f"select doc_id, paragraph, count(*) as sentences from ({O.sentence_rows(table='{spaced_docs}')}) group by doc_id, paragraph")
def d8_paragraphs(lib):
    stats = N.paragraph_stats(N.sentences(lib.wide("spaced_docs"), "doc_id"), "doc_id")
    return stats.select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "sentences")


@query(
    "c14_block_to_sentence",
    f"""with s as ({O.sentence_rows(text='body', table="(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as body from {documents})")}),
        n as (select doc_id, count(*) as n_blocks from {{lib_lines}} group by 1), p as (select doc_id, max(paragraph) + 1 as n_par from s group by 1),
        f as (select doc_id, paragraph, min(idx) as first_idx from s group by 1, 2)
        select b.doc_id, b.pos as block_order, case when n.n_blocks = p.n_par then f.first_idx end as sentence_index
        from {{lib_lines}} b join n using (doc_id) left join p using (doc_id) left join f on f.doc_id = b.doc_id and f.paragraph = b.pos""",
)
def c14(lib):
    blocks = lib["lib_lines"].select("doc_id", F.col("pos").alias("block_order"))
    body = lib.wide("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = N.block_to_sentence(blocks, blocks, N.sentences(body, "doc_id"), "doc_id")
    return found.select(
        "doc_id", F.col("block_order").cast("bigint").alias("block_order"), F.col("sentence_index").cast("bigint").alias("sentence_index")
    )


# -- ingest of text ------------------------------------------------------------------


@query(
    "a3_text_blocks",
    f"""select doc_id, unnest(range(len(ps))) as ord, unnest(ps) as content from (select doc_id,
        list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[{O.H}]+(\\n|$)', '\\1', 'g'), '\\n{{2,}}'),
        lambda p: {O.trim('p')}), lambda p: p <> '') as ps from {{spaced_docs}})""",
)
def a3(lib):
    return text_to_blocks(lib.wide("spaced_docs"), "doc_id").select("doc_id", F.col("ord").cast("bigint").alias("ord"), "content")


# Markdown with every construct, one per line class, built from the lines of a document.
_MD = """case when pos % 29 in (11, 14) then '```' when pos % 29 = 12 then '  ' || content when pos % 13 = 4 then ''
  when pos % 11 = 2 then repeat('#', cast(pos % 6 as int) + 1) || ' ' || content when pos % 11 = 5 then '- ' || content
  when pos % 11 = 6 then '12) ' || content when pos % 11 = 8 then '> ' || content
  when pos % 23 = 9 then '![' || content || '](img/' || cast(pos as string) || '.png)' else content || '  ' end"""
_both("markdown_lines", f"""
select doc_id, pos, {_MD} as line from (select doc_id, pos, replace(replace(content, ']', ''), '[', '') as content from {{lib_lines}})""")

_PROSE = "not fenced and not fence"


MARKDOWN_BLOCKS = f"""with l as (select doc_id, pos, line, starts_with(line, '```') as fence from {{markdown_lines}}),
    k as (select *, (sum(cast(fence as int)) over w) % 2 = 1 as fenced, sum(cast(fence as int)) over w as section,
            max(sum_fence) over (partition by doc_id) as fences from (select *, sum(cast(fence as int)) over (partition by doc_id) as sum_fence from l)
          window w as (partition by doc_id order by pos)),
    c as (select *, regexp_replace(line, '[{O.H}]+$', '') as t from k),
    g as (select *, case when fence then 'fence' when fenced then 'code' when regexp_matches(t, '^#{{1,6}}[{O.H}]+[^\\n]') then 'heading'
            when t = '' then 'blank' when regexp_matches(t, '^[{O.H}]*([-*+]|[0-9]{{1,3}}[.)])[{O.H}]+') then 'list'
            when starts_with(t, '> ') then 'quote' when regexp_full_match(t, '[{O.H}]*!\\[[^\\]]*\\]\\([^)]+\\)') then 'image' else 'text' end as kind from c),
    r as (select *, sum(case when kind = 'text' and before = 'text' then 0 when kind = 'code' and before = 'code' then 0 else 1 end) over (partition by doc_id order by pos) as run
          from (select *, lag(kind) over (partition by doc_id order by pos) as before from g)),
    b as (select doc_id, run, min(pos) as pos, any_value(kind) as kind, min(section) as section, max(fences) as fences,
            string_agg(case when kind = 'code' then line when kind = 'text' then {O.trim('t')} else t end, chr(10) order by pos) as body
          from r where kind not in ('fence', 'blank') group by doc_id, run),
    o as (select doc_id, pos, case kind when 'heading' then 'heading' when 'list' then 'list' when 'image' then 'image' else 'paragraph' end as type,
            cast(case when kind = 'heading' then least(length(regexp_extract(body, '^#+')), 3) else 0 end as int) as level,
            case kind when 'heading' then {O.trim("regexp_replace(body, '^#+', '')")} when 'list' then '• ' || {O.trim(f"regexp_replace(body, '^[{O.H}]*([-*+]|[0-9]{{1,3}}[.)])[{O.H}]+', '')")}
              when 'quote' then {O.trim('substr(body, 3)')} when 'image' then regexp_extract(body, '!\\[([^\\]]*)\\]', 1) when 'code' then {O.trim('body')} else replace(body, chr(10), ' ') end as content,
            case when kind = 'quote' then '{{"quote":true}}' when kind = 'code' and section < fences then '{{"preformatted":true}}'
              when kind = 'image' then '{{"src":"' || regexp_extract(body, '\\(([^)]+)\\)[{O.H}]*$', 1) || '"}}' else '{{}}' end as metadata from b)
    select doc_id, row_number() over (partition by doc_id order by pos) - 1 as ord, type, level, content, metadata from o where content <> '' or type = 'image'"""


def markdown_files(lib):
    return lib.wide("markdown_lines").groupBy("doc_id").agg(F.expr("listagg(line, '\n') within group (order by pos)").alias("text"))


@query("a4_markdown_blocks", MARKDOWN_BLOCKS)
def a4(lib):
    return markdown_to_blocks(markdown_files(lib), "doc_id").withColumn("ord", F.col("ord").cast("bigint"))


# -- names, keys and labels ----------------------------------------------------------


@query(
    "h10_title_from_text",
    f"""select doc_id, case when not {O.has_text('text')} then 'Văn bản' when len(w) <= 8 then array_to_string(w, ' ')
        else array_to_string(w[1:8], ' ') || '…' end as title
        from (select doc_id, text, string_split({O.trim(O.rx('text', f'[{O.W}]+', ' '))}, ' ') as w from {{documents}})""",
)
def h10(lib):
    return lib.wide("documents").select("doc_id", X.title_from_text("text").alias("title"))


@query(
    "h11_slug",
    f"""select uuid, substr(case when s = '' then 'van-ban' else s end, 1, 60) || '.txt' as slug from (select uuid,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({O.trim('name')}), '[\\\\/:*?"<>|\\x00-\\x1F]', '', 'g'), '[{O.W}]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^[.\\-]+|[.\\-]+$', '', 'g') as s from {{lib_docs}})""",
)
def h11(lib):
    return lib["lib_docs"].select("uuid", X.slug("name", "txt").alias("slug"))


@query(
    "h12_display_name",
    f"""select uuid, case when {O.has_text('title')} and length({O.trim('title')}) <= 100 then {O.trim('title')}
        else substr(regexp_replace(file, '\\.[^.]*$', ''), 1, 100) end as display
        from (select uuid, case when doc_id % 9 = 0 then ' ' else name end as title, case when doc_id % 3 = 0 then 'scan.' || uuid else name end || '.' || source as file from {{lib_docs}})""",
)
def h12(lib):
    named = lib["lib_docs"].select(
        "uuid", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("name")).alias("title"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("scan."), "uuid")).otherwise(F.col("name")), F.lit("."), "source").alias("file"),
    )
    return named.select("uuid", X.display_name("file", "title").alias("display"))


@query(
    "h13_file_types",
    """select page_id, ext as extension, case ext when 'pdf' then 'pdf' when 'epub' then 'epub' when 'jpeg' then 'image' when 'md' then 'markdown' end as document_source,
       case ext when 'pdf' then 'application/pdf' when 'epub' then 'application/epub+zip' when 'jpeg' then 'image/jpeg' when 'md' then 'text/markdown' else 'application/octet-stream' end as mime_type
       from (select page_id, ['pdf', 'epub', 'jpeg', 'md', 'exe', ''][cast(page_id % 6 as int) + 1] as ext from {pages})""",
)
def h13(lib):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".epub", ".Jpeg", ".md", ".exe", "")]), (F.col("page_id") % 6).cast("int") + 1)
    named = lib["pages"].select("page_id", F.concat(F.lit("v1.2/book"), ext).alias("name"))
    named = named.withColumn("name", F.when(F.col("page_id") % 6 == 5, F.lit("noext")).otherwise(F.col("name")))
    return files.file_type_columns(named).select("page_id", "extension", "document_source", "mime_type")


@query("h14_cache_key", """select uuid, sha256('null|1.25|wav|' || extracted_text) as plain_hash, sha256('Ngọc|0.50|mp3|' || name) as voice_hash from {lib_docs}""")
def h14(lib):
    none = F.lit(None).cast("string")
    return lib["lib_docs"].select(
        "uuid",
        X.cache_hash("extracted_text", none, F.lit(1.25), F.lit("wav")).alias("plain_hash"),
        X.cache_hash("name", F.lit("Ngọc"), F.lit(0.5), F.lit("mp3")).alias("voice_hash"),
    )


@query(
    "h15_speech_options",
    """select event_id, case when event_id % 4 = 1 then 'v' || event_type end as voice_id,
       case when event_id % 4 in (0, 1) then least(greatest(value, 0.5), 2.0) when event_id % 4 = 2 then cast(1.0 as double) end as speed,
       case when event_id % 4 in (0, 1) then cast(1.0 as double) when event_id % 4 = 2 then 0.25 end as volume from {events}""",
)
def h15(lib):
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"speed":'), F.col("value").cast("string"), F.lit(',"extra":[1]}')))
    raw = raw.when(
        F.col("event_id") % 4 == 1,
        F.concat(F.lit('{"voiceId":"v'), "event_type", F.lit('","volume":7,"speed":'), F.col("value").cast("string"), F.lit("}")),
    ).when(F.col("event_id") % 4 == 2, F.lit('{"voiceId":"","volume":0.25,"speed":"fast"}')).otherwise(F.lit("[1, 2"))
    return lib["events"].select("event_id", coerce.parse_options(raw).alias("o")).select("event_id", "o.*")


@query(
    "h16_text_digest",
    """select doc_id, 'len=' || length(t) || ' lines=' || (length(t) - length(replace(t, chr(10), '')) + 1) || ' hash=' ||
       format('{:x}', list_reduce(list_prepend(2166136261, list_transform(string_split(t, ''), lambda c: cast(ord(c) as bigint))),
         lambda h, u: ((xor(h, u) * 16777619) & 4294967295))) as digest
       from (select doc_id, text as t from {documents})""",
)
def h16(lib):
    return lib.wide("documents").select("doc_id", X.text_digest("text").alias("digest"))


@query(
    "h17_labels",
    """select o_orderkey,
       case when ms // 3600000 > 0 then format('{}:{:02d}:{:02d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60)
         else format('{}:{:02d}', ms // 60000 % 60, ms // 1000 % 60) end as duration,
       case when b < 1024 then b || ' B' when b < 1048576 then format('{}.{}', (b * 20 + 1024) // 2048 // 10, (b * 20 + 1024) // 2048 % 10) || ' KB'
         else format('{}.{}', (b * 20 + 1048576) // 2097152 // 10, (b * 20 + 1048576) // 2097152 % 10) || ' MB' end as size,
       case when b >= 1000000000 then format('{}.{}', (b * 20 + 1000000000) // 2000000000 // 10, (b * 20 + 1000000000) // 2000000000 % 10) || ' GB'
         when b >= 1000000 then (b * 2 + 1000000) // 2000000 || ' MB' when b >= 1000 then (b * 2 + 1000) // 2000 || ' KB' else b || ' B' end as model_size,
       case when age // 86400 > 0 then age // 86400 || ' ngày trước' when age // 3600 > 0 then age // 3600 || ' giờ trước'
         when age // 60 > 0 then age // 60 || ' phút trước' else 'Vừa xong' end as age,
       case cast(o_orderkey % 3 as int) when 0 then '1.0×' when 1 then '1.25×' else '0.5×' end as speed
       from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as ms, cast(round(o_totalprice) as bigint) * o_orderkey as b,
         date_diff('second', o_orderdate, timestamp '2002-01-01 00:00:00') % (o_orderkey * 40 + 1) as age from {orders})""".replace("{:02d}", "{{:02d}}").replace("{}", "{{}}"),
)
def h17(lib):
    rows = lib["orders"].select(
        "o_orderkey",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("ms"),
        (F.round("o_totalprice").cast("bigint") * F.col("o_orderkey")).alias("b"),
        (F.expr("timestampdiff(second, o_orderdate, timestamp_ntz '2002-01-01 00:00:00')") % (F.col("o_orderkey") * 40 + 1)).alias("age"),
    )
    now = F.timestamp_seconds(F.lit(1_000_000_000))
    speed = F.element_at(F.array(F.lit(1.0), F.lit(1.25), F.lit(0.5)), (F.col("o_orderkey") % 3).cast("int") + 1)
    return rows.select(
        "o_orderkey", labels.duration_label("ms").alias("duration"), labels.bytes_label("b").alias("size"),
        labels.model_bytes_label("b").alias("model_size"),
        labels.age_label(F.timestamp_seconds(F.lit(1_000_000_000) - F.col("age")), now).alias("age"),
        labels.speed_label(speed).alias("speed"),
    )


@query(
    "h17_error_label",
    "select doc_id, case when length(f) > 200 then substr(f, 1, 200) || '…' else f end as label from (select doc_id, string_split(text, chr(10))[1] as f from {documents})",
)
def h17_error(lib):
    return lib.wide("documents").select("doc_id", labels.error_label("text").alias("label"))


@query(
    "h19_list_and_table_text",
    f"""select doc_id, pos, len(regexp_extract_all(t, '[{O.W}]{{3,}}')) + 1 as cells,
        array_to_string(list_filter(list_transform(string_split_regex(t, '[{O.W}]{{3,}}'), lambda c: {O.trim('c')}), lambda c: c <> ''), ' | ') as row_text,
        regexp_matches(t, '(?i)^[{O.W}]*([-–—•*·]|\\(?[0-9]{{1,3}}[.)]|[a-z][.)]|[IVXLC]{{1,4}}[.)])[{O.W}]+') as listed,
        {O.trim(f"regexp_replace(t, '(?i)^[{O.W}]*([-–—•*·]|\\(?[0-9]{{1,3}}[.)]|[a-z][.)]|[IVXLC]{{1,4}}[.)])[{O.W}]+', '')")} as item
        from (select doc_id, pos, case cast(pos % 4 as int) when 0 then replace(content, ', ', '    ') when 1 then '(12) ' || content when 2 then ' iv. ' || content else content end as t from {{lib_lines}})""",
)
def h19(lib):
    c = F.col("content")
    t = (
        F.when(F.col("pos") % 4 == 0, F.replace(c, F.lit(", "), F.lit("    ")))
        .when(F.col("pos") % 4 == 1, F.concat(F.lit("(12) "), c)).when(F.col("pos") % 4 == 2, F.concat(F.lit(" iv. "), c)).otherwise(c)
    )
    rows = lib["lib_lines"].select("doc_id", F.col("pos").cast("bigint").alias("pos"), t.alias("t"))
    return rows.select(
        "doc_id", "pos", cell_count("t").cast("bigint").alias("cells"), table_text("t").alias("row_text"),
        is_list_line("t").alias("listed"), list_text("t").alias("item"),
    )


@query("h20_repeat_key", f"select page_id, {O.trim(O.rx(O.rx('lower(url)', '[0-9]+', '#'), f'[{O.W}]+', ' '))} as key from {{pages}}")
def h20(lib):
    return lib["pages"].select("page_id", X.repeat_key("url").alias("key"))
