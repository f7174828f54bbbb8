"""Table maintenance and the batch twins of the streaming folds."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators.library import filter_library, sort_library
from ..operators.ordered import shared_folder
from ..streaming import jobs, playback, streams
from .base import _both, query

# Changes from events: each sets some columns of a document and leaves others absent.
_both("lib_changes", """
select 'd' || cast((user_id * 7) % 1300 as string) as uuid, event_id as seq, event_id as updated_at, event_type,
  case event_type when 'view' then 'ready' when 'error' then 'failed' else 'ocr' end as status,
  case when event_id % 5 = 0 then null else 'c' || cast(event_id % 7 as string) end as category
from {events}""")

_BASE = "(select uuid, status, category from {lib_docs})"
_NEW = """(select uuid, max(event_id_status) as ss, arg_max(status, event_id_status) as status, max(event_id_category) as sc, arg_max_null(category, event_id_category) as category
  from (select *, case when event_type <> 'click' then seq end as event_id_status, case when event_type in ('click', 'signup') then seq end as event_id_category from {lib_changes}) group by uuid)"""


def _changes(lib):
    written = F.when(F.col("event_type") == "click", F.array(F.lit("category"))).when(
        F.col("event_type") == "signup", F.array(F.lit("status"), F.lit("category"))
    ).otherwise(F.array(F.lit("status")))
    return lib["lib_changes"].withColumn("written", written)


def _table(lib):
    return lib["lib_docs"].select("uuid", "status", "category")


_MERGED = "case when n.ss is not null then n.status else b.status end as status, case when n.sc is not null then n.category else b.category end as category"


@query("i1_upsert", f"select coalesce(b.uuid, n.uuid) as uuid, {_MERGED} from {_BASE} b full join {_NEW} n on n.uuid = b.uuid")
def i1(lib):
    return M.upsert(_table(lib), _changes(lib), "uuid", ["updated_at", "seq"])


@query("i2_patch", f"select b.uuid, {_MERGED} from {_BASE} b left join {_NEW} n on n.uuid = b.uuid")
def i2(lib):
    return M.patch(_table(lib), _changes(lib), "uuid", ["updated_at", "seq"])


def _stored(lib):
    return M.Partitioned.create(lib["lib_docs"].select("uuid", "status", "category"), f"{shared_folder(lib.spark)}/documents-{uuid4().hex}", "uuid", 64)


@query("i1_upsert_stored", f"select coalesce(b.uuid, n.uuid) as uuid, {_MERGED} from {_BASE} b full join {_NEW} n on n.uuid = b.uuid")
def i1_stored(lib):
    """The upsert as a rewrite of the folders that the changes fall in."""
    table = _stored(lib)
    table.upsert(_changes(lib), ["updated_at", "seq"])
    return table.read()


@query("i2_patch_stored", f"select b.uuid, {_MERGED} from {_BASE} b left join {_NEW} n on n.uuid = b.uuid")
def i2_stored(lib):
    table = _stored(lib)
    table.patch(_changes(lib), ["updated_at", "seq"])
    return table.read()


@query("i3_delete_stored", "select uuid, status, category from {lib_docs} where uuid not in (select 'd' || doc_id from {labels} where toxic = 1)")
def i3_stored(lib):
    table = _stored(lib)
    table.delete(lib["labels"].filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("uuid")))
    return table.read()


@query(
    "i3_cascade_delete",
    """select 'blocks' as table_name, count(*) as n from {lib_blocks} where document_id not in (select 'd' || doc_id from {labels} where toxic = 1)
       union all select 'pages', count(*) from {lib_pages} where document_id not in (select 'd' || doc_id from {labels} where toxic = 1)
       union all select 'images', count(*) from {lib_images} where document_id not in (select 'd' || doc_id from {labels} where toxic = 1)
       union all select 'documents', count(*) from {lib_docs} where uuid not in (select 'd' || doc_id from {labels} where toxic = 1)""",
)
def i3(lib):
    gone = lib["labels"].filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"))
    tables = {
        "blocks": (lib["lib_blocks"], "document_id"), "pages": (lib["lib_pages"], "document_id"),
        "images": (lib["lib_images"], "document_id"), "documents": (lib["lib_docs"], "uuid"),
    }
    counts = [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, t in M.cascade_delete(tables, gone).items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "i4_set_exclusive",
    """select p_partkey, p_partkey % 50 as grp, case when p_partkey % 50 < 40 then p_partkey = c.m else p_partkey % 3 = 0 end as is_active
       from {part} left join (select p_partkey % 50 as g, max(p_partkey) as m from {part} group by 1) c on c.g = p_partkey % 50""",
)
def i4(lib):
    rows = lib["part"].select("p_partkey", (F.col("p_partkey") % 50).alias("grp"), (F.col("p_partkey") % 3 == 0).alias("is_active"))
    choices = rows.filter("grp < 40").groupBy("grp").agg(F.max("p_partkey").alias("p_partkey"))
    return M.set_exclusive(rows, choices, "grp", "p_partkey", "is_active")


@query(
    "i5_retain_jobs",
    "select uuid from {lib_jobs} where not (status in ('completed', 'failed') and updated_at < timestamp '1998-01-01 00:00:00' - interval 7 day)",
)
def i5(lib):
    old = lib["lib_jobs"].withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return M.retain_jobs(old, F.to_timestamp(F.lit("1998-01-01 00:00:00"))).select("uuid")


@query("i5_retain_audio", "select event_id from {events} where not (ts < timestamp '2024-02-10 00:00:00' - interval 30 day)")
def i5_audio(lib):
    cache = lib["events"].select("event_id", F.col("ts").cast("timestamp").alias("last_accessed_at"))
    return M.retain_audio(cache, F.to_timestamp(F.lit("2024-02-10 00:00:00"))).select("event_id")


# -- batch twins of the streams ------------------------------------------------------


@query(
    "j1_live_library",
    f"select uuid, status, category from (select coalesce(b.uuid, n.uuid) as uuid, {_MERGED} from {_BASE} b full join {_NEW} n on n.uuid = b.uuid) where status = 'ready'",
)
def j1(lib):
    current = M.upsert(_table(lib).withColumn("updated_at", F.lit(0).cast("bigint")), _changes(lib), "uuid", ["updated_at", "seq"])
    return sort_library(filter_library(current, status="ready")).select("uuid", "status", "category")


@query(
    "j2_debounce",
    """with t as (select *, lead(ts) over (partition by user_id order by ts) as next from {events} where event_type <> 'purchase')
       select event_id as value, user_id from t where next is null or next - ts >= interval 3 hour union all select event_id, user_id from {events} where event_type = 'purchase'""",
)
def j2(lib):
    events = lib["events"].select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("value"), (F.col("event_type") == "purchase").alias("committed")
    )
    return streams.debounce(events, "user_id", 3 * 3600, 86_400).select("user_id", "value")


@query(
    "j3_track_positions",
    "select document_id, max(seq) as seq, arg_max(sentence_index, seq) as sentence_index, arg_max(position_ms, seq) as position_ms from {lib_positions} group by 1",
)
def j3(lib):
    return streams.track_positions(lib["lib_positions"]).select("document_id", "seq", "sentence_index", "position_ms")


@query("j4_running_max", "select event_type, max(v) as slowest from (select event_type, value - 100 as v from {events}) where v > 0 group by 1")
def j4(lib):
    return streams.running_max(lib["events"].select("event_type", (F.col("value") - 100).alias("v")), "event_type", "v")


_both("lib_job_events", """
select cast(floor(event_id / 12) as bigint) as job_id, event_id as seq,
  case when event_id % 12 = 0 then 'enqueue' when event_id % 97 = 5 then 'dismiss' when event_id % 97 = 6 then 'enqueue' when event_id % 23 = 7 then 'cancel'
    else case event_type when 'view' then 'report' when 'click' then 'start' when 'signup' then 'retry' when 'purchase' then 'succeed' else 'fail' end end as action,
  value / 50 - 0.5 as progress, case when event_id % 3 = 0 then 'step ' || cast(event_id % 4 as string) end as stage,
  case when event_id % 2 = 0 then 'storage' else 'processing' end as failure
from {events}""")

_FOLD = """with g as (select *, max(case when action = 'dismiss' then seq end) over (partition by job_id) as gone from {lib_job_events}),
  h as (select *, min(case when action = 'enqueue' then seq end) over (partition by job_id) as born from g where gone is null or seq > gone),
  e as (select * from h where seq >= born),
  c as (select *, last_value(case when action <> 'report' then action end ignore nulls) over (partition by job_id order by seq rows between unbounded preceding and 1 preceding) as before from e where action <> 'dismiss'),
  r as (select *, action = 'report' and before in ('enqueue', 'start', 'retry') as reported from c),
  k as (select *, case when reported then least(greatest(progress, 0), 1) when action = 'succeed' then 1 when action in ('enqueue', 'retry') then 0 end as p,
      case when action in ('enqueue', 'start', 'report') then coalesce(stage, case action when 'enqueue' then 'Đang chờ' end)
        else case action when 'retry' then 'Đang chờ' when 'succeed' then 'Xong' when 'fail' then 'Thất bại' when 'cancel' then 'Đã hủy' end end as label from r where reported or action <> 'report')
  select job_id, case when coalesce(max(seq) filter (where reported) > max(seq) filter (where not reported), false) then 'running'
      else case arg_max(action, seq) filter (where not reported) when 'enqueue' then 'queued' when 'retry' then 'queued' when 'start' then 'running' when 'succeed' then 'succeeded' when 'fail' then 'failed' else 'cancelled' end end as status,
    cast(arg_max(p, seq) filter (where p is not null) as double) as progress, arg_max(label, seq) filter (where label is not null) as stage,
    arg_max_null(case when action = 'fail' then failure end, seq) filter (where action in ('enqueue', 'fail', 'cancel', 'retry')) as failure, max(seq) as last_seq
  from k group by job_id"""


@query("j5_fold_jobs", _FOLD)
def j5(lib):
    return jobs.fold_jobs(lib["lib_job_events"])


@query("j5_unfinished_jobs", f"select job_id, status from ({_FOLD}) where status in ('queued', 'running')")
def j5_unfinished(lib):
    return jobs.clear_finished(jobs.fold_jobs(lib["lib_job_events"])).select("job_id", "status")


_both("lib_results", """
select cast(user_id as string) as document_id, event_id as idx,
  case when event_id % 613 = 11 then 'model_missing' when event_type = 'error' then 'failed' else 'ok' end as outcome from {events}""")


@query(
    "j6_progress",
    """with s as (select document_id, min(idx) as stop from {lib_results} where outcome = 'model_missing' group by 1)
       select document_id, count(*) filter (where outcome <> 'model_missing') as completed, count(*) filter (where outcome <> 'ok') as failed, bool_or(outcome = 'model_missing') as stopped
       from {lib_results} r left join s using (document_id) where stop is null or idx <= stop group by 1""",
)
def j6(lib):
    return streams.progress(lib["lib_results"])


_both("lib_playback", """
select cast(user_id % 40 as string) as document_id, event_id as seq, (event_id * 13) % 60 as idx,
  case when event_id % 71 = 3 then 'invalidate' else case event_type when 'view' then 'play' when 'click' then 'save' when 'signup' then 'played' when 'purchase' then 'retry' else 'fail' end end as action
from {events}""")


@query(
    "j7_fold_playback",
    """with o as (select document_id, idx, max(seq) as seq, arg_max(action, seq) as action from {lib_playback} where action <> 'invalidate' group by 1, 2),
       p as (select document_id, max(seq) as playing from {lib_playback} where action = 'play' group by 1),
       r as (select o.document_id, o.idx, max(i.seq) as reset_at from o join {lib_playback} i on i.document_id = o.document_id and i.action = 'invalidate' and i.idx <= o.idx group by 1, 2)
       select o.document_id, o.idx, case when r.reset_at > o.seq then 'idle' when o.action = 'play' and o.seq < p.playing then 'played'
         else case o.action when 'play' then 'playing' when 'save' then 'ready' when 'played' then 'played' when 'retry' then 'idle' else 'failed' end end as status
       from o left join p using (document_id) left join r using (document_id, idx)""",
)
def j7(lib):
    return playback.fold_playback(lib["lib_playback"])
