"""Speech preparation over whole documents and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import cache_hash
from ..operators import sentences as N
from ..operators import speech as P
from . import oracle_text as O
from .base import SHARED, _both, duck, query

# Measurements derived from position and text, in SQL both engines accept.
_MEASURES = [
    "cast(doc_id as string) as document_id", "cast(idx as bigint) as idx", "cast(paragraph as bigint) as paragraph", "text",
    "case when (doc_id * 31 + idx * 7) % 5 = 0 then null else length(text) * 60 end as duration_ms",
    "case when (doc_id + idx) % 11 = 0 then null else (doc_id * 13 + idx * 17) % 900 end as synthesis_ms",
    "case cast((doc_id + idx) % 7 as int) when 0 then 'idle' when 1 then 'queued' when 2 then 'synthesizing'"
    " when 3 then 'ready' when 4 then 'playing' when 5 then 'played' else 'failed' end as status",
]
MEASURED = f"(select {', '.join(_MEASURES)} from ({O.sentence_rows()}))"


def measured(lib):
    return N.sentences(lib.wide("documents"), "doc_id").selectExpr(*_MEASURES)


_both("lib_cursors", """
select cast(user_id as string) as document_id, cast(max(event_id % 40) as int) as sentence_index from {events} group by user_id""")


# -- cache ---------------------------------------------------------------------------

_KEY = "sha256('null|1.00|wav|' || text)"
_CACHED = f"""(select distinct text, {_KEY} as text_hash, 'audio/' || substr({_KEY}, 1, 12) || '.wav' as file_path, cast(length(text) * 61 as bigint) as cached_ms
  from (select text from ({O.sentence_rows(key='item_id', table='{benchmark}')})
        union all select text from ({O.sentence_rows(table='(select * from {documents} where lang = ' + chr(39) + 'fr' + chr(39) + ')')})))"""


def cache(lib):
    texts = N.sentences(lib["benchmark"], "item_id").select("text").unionByName(
        N.sentences(lib.wide("documents").filter("lang = 'fr'"), "doc_id").select("text")
    )
    key = cache_hash("text", F.lit(None).cast("string"), F.lit(1.0), F.lit("wav"))
    return texts.distinct().select(
        "text", key.alias("text_hash"), F.concat(F.lit("audio/"), F.substring(key, 1, 12), F.lit(".wav")).alias("file_path"),
        (F.length("text") * 61).cast("bigint").alias("duration_ms"), F.lit("").alias("voice_id"),
        F.lit(1.0).alias("speed"), F.lit("wav").alias("format"),
    )


@query(
    "c4_cache_lookup",
    f"""select s.document_id, s.idx, c.file_path, c.cached_ms, c.file_path is not null as cache_hit
        from (select *, {_KEY} as h from {MEASURED}) s left join {_CACHED} c on c.text_hash = s.h""",
)
def c4(lib):
    found = P.cache_lookup(measured(lib), cache(lib), None, 1.0, strict=True)
    return found.select("document_id", "idx", "file_path", "cached_ms", "cache_hit")


@query(
    "c5_missing_audio",
    f"""select {_KEY} as text_hash, text, count(*) as occurrences from {MEASURED} where {_KEY} not in (select text_hash from {_CACHED}) group by text""",
)
def c5(lib):
    return P.missing_audio(measured(lib), cache(lib), None, 1.0).select("text_hash", "text", "occurrences")


@query("c6_stale_cache", f"select text_hash from {_CACHED} where not (length(text) % 3 = 1)")
def c6(lib):
    files = cache(lib).filter(F.length("text") % 3 == 1).select(F.col("file_path").alias("path"))
    return P.stale_cache(cache(lib), files).select("text_hash")


@query("d25_cache_count", f"select count(text_hash) as cached from {_CACHED}")
def d25(lib):
    from ..operators.library import cache_count

    return cache_count(cache(lib))


@query(
    "e6_evict",
    """with last as (select cast(l_partkey as varchar) as key, max(l_orderkey * 10 + l_linenumber) as seq from {lineitem} group by 1)
       select key, seq from last where key not in (select key from last order by seq desc, key desc limit 256)""",
)
def e6(lib):
    # Saves are ordered by the order that made them; the key settles equal orders.
    saves = lib["lineitem"].select(
        F.col("l_partkey").cast("string").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("saved_at"),
        F.col("l_partkey").cast("string").alias("seq"),
    )
    return P.evict(saves).select("key", F.col("saved_at").alias("seq"))


# -- voices and options --------------------------------------------------------------

_both("lib_voices", """
select 'V' || cast(s_suppkey as string) as id, s_suppkey as pos,
  'Giọng' || cast(s_suppkey % 10 as string) as alias1, 'tên' || cast(s_suppkey as string) as alias2 from {supplier}""")
_both("lib_requests", """
select c_custkey, case cast(c_custkey % 6 as int) when 0 then 'V' || cast(c_custkey % 90 + 1 as string) when 1 then 'Giọng' || cast(c_custkey % 13 as string)
  when 2 then 'GIỌNG' || cast(c_custkey % 13 as string) when 3 then '' when 4 then null else 'nobody' end as requested from {customer}""")

_NAMES = "(select id, pos, unnest([id, alias1, alias2]) as name from {lib_voices})"


@query(
    "c10_resolve_voice",
    f"""select c_custkey, coalesce(e.v, f.v, (select arg_min(id, pos) from {_NAMES} where name = 'TÊN7'), (select arg_min(id, pos) from {_NAMES} where lower(name) = lower('TÊN7')),
        (select arg_min(id, pos) from {{lib_voices}})) as voice_id from {{lib_requests}} r
        left join (select name, arg_min(id, pos) as v from {_NAMES} group by 1) e on e.name = r.requested and r.requested <> ''
        left join (select lower(name) as name, arg_min(id, pos) as v from {_NAMES} group by 1) f on f.name = lower(r.requested) and r.requested <> ''""",
)
def c10(lib):
    voices = lib["lib_voices"].select("id", "pos", F.array("alias1", "alias2").alias("aliases"))
    return P.resolve_voice(lib["lib_requests"], voices, "TÊN7").select("c_custkey", "voice_id")


_OWN = """select 'tts_options:' || uuid as key, case when doc_id % 9 = 0 then '{{"voiceId":"v' || lang || '","speed":3,"volume":0.5}}'
  when doc_id % 9 = 3 then 'broken' else '{{"speed":0.75}}' end as value from {lib_docs} where doc_id % 3 = 0"""
_DEFAULTS = """ union all select 'default_voice_id', 'vd' from {region} where r_regionkey = 0 union all select 'default_speed', '1.5' from {region} where r_regionkey = 0
  union all select 'default_format', 'mp3' from {region} where r_regionkey = 0"""
_both("lib_settings", _OWN + _DEFAULTS)
_both("lib_settings_composer", _OWN + _DEFAULTS + """ union all select 'tts_options:composer', '{{"voiceId":"vc","volume":-1}}' from {region} where r_regionkey = 0""")


def _options(voice, speed, volume, fmt):
    return f"""select uuid as document_id, case when doc_id % 9 = 0 then 'v' || lang when doc_id % 9 = 6 then null else {voice} end as voice_id,
      cast(case when doc_id % 9 = 0 then 2.0 when doc_id % 9 = 6 then 0.75 else {speed} end as double) as speed,
      cast(case when doc_id % 9 = 0 then 0.5 when doc_id % 9 = 6 then 1.0 else {volume} end as double) as volume,
      case when doc_id % 9 in (0, 6) then 'wav' else '{fmt}' end as format from {{lib_docs}}"""


@query("c11_resolve_options", _options("'vc'", 1.0, 0.0, "wav"))
def c11(lib):
    return P.resolve_options(lib["lib_docs"], lib["lib_settings_composer"])


@query("c11_resolve_default_options", _options("'vd'", 1.5, 1.0, "mp3"))
def c11_defaults(lib):
    return P.resolve_options(lib["lib_docs"], lib["lib_settings"])


# -- positions and statistics --------------------------------------------------------


@query(
    "e1_elapsed",
    f"""select document_id, idx, coalesce(cast(sum(coalesce(duration_ms, 0)) over (partition by document_id order by idx rows between unbounded preceding and 1 preceding) as bigint), 0) as elapsed_ms
        from {MEASURED}""",
)
def e1(lib):
    return P.elapsed(measured(lib)).select("document_id", "idx", "elapsed_ms")


@query(
    "e1_elapsed_of_events",
    """select cast(user_id as varchar) as document_id, event_id as idx,
       coalesce(cast(sum(cast(round(value * 100) as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as bigint), 0) as elapsed_ms from {events}""",
)
def e1_events(lib):
    rows = lib["events"].select(
        F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("idx"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"),
    )
    return P.elapsed(rows).select("document_id", "idx", "elapsed_ms")


@query(
    "e4_remaining",
    f"""select c.document_id, c.sentence_index, greatest(t.n - c.sentence_index - 1, 0) as remaining from {{lib_cursors}} c
        join (select document_id, count(*) as n from {MEASURED} group by 1) t using (document_id)""",
)
def e4(lib):
    return P.remaining(measured(lib), lib["lib_cursors"])


@query(
    "e5_look_ahead",
    f"""select c.document_id, s.idx, s.text from {{lib_cursors}} c join {MEASURED} s on s.document_id = c.document_id and s.idx between c.sentence_index and c.sentence_index + 2
        where s.idx = c.sentence_index or s.status not in ('ready', 'played')""",
)
def e5(lib):
    return P.look_ahead(measured(lib), lib["lib_cursors"]).select("document_id", F.col("idx").cast("bigint").alias("idx"), "text")


@query(
    "d9_audio_stats",
    f"""select document_id, cast(sum(coalesce(duration_ms, 0)) as bigint) as known_ms, max(synthesis_ms) as slowest_ms, bool_or(status = 'ready') as has_audio
        from {MEASURED} group by document_id""",
)
def d9(lib):
    return P.audio_stats(measured(lib)).select("document_id", "known_ms", "slowest_ms", "has_audio")


@query(
    "d10_progress",
    f"""select document_id, count(*) as total, count(*) filter (where status in ('ready', 'played', 'playing', 'failed')) as completed, count(*) filter (where status = 'failed') as failed,
        count(*) filter (where status in ('ready', 'played', 'playing', 'failed')) / count(*) as fraction,
        count(*) filter (where status in ('ready', 'played', 'playing', 'failed')) * 100 // count(*) as percent from {MEASURED} group by document_id""",
)
def d10(lib):
    return P.progress(measured(lib))


_both("placed_blocks", "select * from {lib_blocks} where not (ord = 2 and length(document_id) % 2 = 0)")
_PARAS = f"""(select document_id, cast(max(paragraph) as int) as last from (select cast('d' || doc_id as varchar) as document_id, paragraph
  from ({O.sentence_rows(text='body', table="(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as body from {documents})")})) group by 1)"""


@query(
    "c9_place_images",
    f"""with b as (select document_id, page_number, row_number() over (partition by document_id order by ord) - 1 as p from {{placed_blocks}}),
        n as (select document_id, count(*) as n from b group by 1), l as (select document_id, page_number, max(p) as p from b group by 1, 2)
        select i.uuid, cast(case when coalesce(n.n, 0) = coalesce(e.last, -1) + 1 then coalesce(l.p, e.last, -1) else coalesce(e.last, -1) end as bigint) as after_paragraph
        from {{lib_images}} i left join n using (document_id) left join {_PARAS} e using (document_id)
        left join l on l.document_id = i.document_id and l.page_number is not distinct from i.page_number""",
)
def c9(lib):
    body = lib.wide("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    placed = P.place_images(lib["lib_images"], lib.wide("placed_blocks"), N.sentences(body))
    return placed.select("uuid", F.col("after_paragraph").cast("bigint").alias("after_paragraph"))


# -- cost ----------------------------------------------------------------------------

SHARED["lib_phrases"] = (
    "select doc_id, posexplode(split(text, '[.!?\\n]+')) as (pos, phrase) from {documents}",
    """select doc_id, unnest(range(len(l))) as pos, unnest(l) as phrase from
         (select doc_id, string_split_regex(text, '[.!?\\n]+') as l from {documents})""",
)
# Every phrase of every document; those without words are bare cues.
_both("lib_phonemes", """
select doc_id, pos, case when trim(phrase) = '' then '<|emotion_2|>' when (doc_id + pos) % 11 = 1 then '<|emotion_1|> ' || phrase
  when doc_id % 2 = 0 then '<en>' || replace(lower(phrase), 'a', 'ˈaː') || '</en>' else lower(phrase) end as phonemes
from {lib_phrases}""")


@query(
    "h24_speech_cost",
    f"""with a as (select doc_id, pos, phonemes, regexp_replace(phonemes, '<\\|emotion_[0-9]+\\|>|</?en>', '', 'g') as plain from {{lib_phonemes}}),
        b as (select *, len(regexp_extract_all(regexp_replace(plain, '[ːˈˌ0-9]', '', 'g'), '[{P.IPA_VOWELS}]+')) as syllables,
          contains(phonemes, '<|emotion_') and not regexp_matches(plain, '\\p{{L}}') as cue_only, length(plain) as n from a),
        c as (select *, case when cue_only then least(24 + 2 * n, 13)
          when not contains(phonemes, '<|emotion_') and greatest(syllables, 1) <= 4 and n <= 24 * greatest(syllables, 1) then least(24 + 2 * n, 13 + 5 * (greatest(syllables, 1) - 1))
          else 24 + 2 * n end as frame_cap from b),
        d as (select *, case when cue_only then frame_cap / 12.5::double * 4.5::double else syllables::double end as expected from c)
        select doc_id, cast(pos as bigint) as pos, syllables, cue_only, frame_cap,
          least(greatest(cast(round(case when expected < 1 then 1 else expected / 4.5::double end * 25 * 1000) as bigint) + 30000, 60000), 480000) as budget_ms from d""",
)
def h24(lib):
    cost = P.speech_cost(lib.wide("lib_phonemes"))
    return cost.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("syllables").cast("bigint").alias("syllables"), "cue_only",
        F.col("frame_cap").cast("bigint").alias("frame_cap"), "budget_ms",
    )


# -- audio ---------------------------------------------------------------------------

_both("lib_clips", """
select cast(user_id as string) as document_id, event_id as idx, case when event_id % 50 = 7 then null else length(event_type) * 2 + event_id % 5 * 2 end as data_bytes,
  case when user_id % 7 = 3 and event_id % 4 = 0 then 48000 else 24000 end as sample_rate,
  case when user_id % 5 = 2 and event_id % 3 = 0 then 2 else 1 end as channels, 16 as bits, 1 as audio_format,
  repeat(event_type, cast(event_id % 3 as int) + 2) as data
from {events}""")


@query(
    "d14_audio_compatibility",
    """select document_id, arg_min(sample_rate, idx) as sample_rate, arg_min(channels, idx) as channels, arg_min(bits, idx) as bits, arg_min(audio_format, idx) as audio_format,
       count(distinct sample_rate) = 1 and count(distinct channels) = 1 as compatible,
       case when count(distinct sample_rate) > 1 then 'sample_rate' when count(distinct channels) > 1 then 'channels' end as differs_in from {lib_clips} group by 1""",
)
def d14(lib):
    return P.audio_compatibility(lib["lib_clips"])


def _planned(lib):
    sentences = lib["lib_clips"].select("document_id", "idx")
    return P.merge_plan(sentences, lib["lib_clips"].filter("data_bytes is not null"))


@query(
    "d15_merge_plan",
    """select document_id, idx, data_bytes, 44 + coalesce(cast(sum(coalesce(data_bytes, 0)) over (partition by document_id order by idx rows between unbounded preceding and 1 preceding) as bigint), 0) as "offset"
       from {lib_clips}""",
)
def d15(lib):
    return _planned(lib)


@query(
    "d15_merge_totals",
    """select document_id, count(*) filter (where data_bytes is null) as without_audio, count(data_bytes) as with_audio, cast(sum(data_bytes) + 44 as bigint) as total_bytes,
       case when count(*) filter (where data_bytes is null) > 0 then 'incomplete' when count(distinct sample_rate) > 1 or count(distinct channels) > 1 then 'mixed_formats' end as refused
       from {lib_clips} group by 1""",
)
def d15_totals(lib):
    return P.merge_totals(_planned(lib), P.audio_compatibility(lib["lib_clips"]))


@query("d15_estimated_size", "select event_id, 44 + cast(round(cast(round(value * 1000) as bigint) * 48000 / 1000) as bigint) as estimate from {events}")
def d15_estimate(lib):
    return lib["events"].select("event_id", P.estimate_bytes(F.round(F.col("value") * 1000).cast("bigint")).alias("estimate"))


def _le(n: str, size: int) -> str:
    parts = ", ".join(f"({n}) >> {8 * i} & 255" for i in range(size))
    return f"upper(format('{'{:02x}' * size}', {parts}))".replace("{", "{{").replace("}", "}}")


_RATE, _CH, _TOTAL = "arg_min(sample_rate, idx)", "arg_min(channels, idx)", "cast(sum(length(data)) as bigint)"


@query(
    "d16_merge_audio",
    f"""select document_id, cast(0 as bigint) as part, '52494646' || {_le(f'{_TOTAL} + 36', 4)} || '57415645666D742010000000' || '0100' || {_le(_CH, 2)} || {_le(_RATE, 4)}
        || {_le(f'{_RATE} * {_CH} * 2', 4)} || {_le(f'{_CH} * 2', 2)} || '1000' || '64617461' || {_le(_TOTAL, 4)} as header, string_agg(data, '' order by idx) as body
        from {{lib_clips}} group by document_id""",
)
def d16(lib):
    clips = lib["lib_clips"].withColumn("data", F.encode("data", "UTF-8"))
    merged = P.merge_audio(clips)
    return merged.select(
        "document_id", "part", F.hex(F.substring("bytes", 1, 44)).alias("header"),
        F.substring("bytes", 45, 2**31 - 1).cast("string").alias("body"),
    )
