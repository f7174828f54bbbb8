"""Streaming results equal their batch twins."""

import glob
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lectern.streaming import jobs, playback, streams

JOB_SCHEMA = "job_id bigint, seq bigint, action string, progress double, stage string, failure string"


def as_stream(spark, rows, schema, files=3):
    """The rows as a file stream in ``files`` ordered micro-batches."""
    directory = tempfile.mkdtemp(prefix="lectern-stream-")
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame([r for r in rows[i * size:(i + 1) * size] if r], schema).coalesce(1).write.mode("append").parquet(directory)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(directory)


def run(spark, frame, name, mode):
    query = (
        frame.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="lectern-check-")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def job_rows(n=240):
    rng = random.Random(5)
    actions = ["start", "report", "report", "succeed", "fail", "cancel", "retry", "report", "dismiss"]
    rows = []
    for seq in range(n):
        action = "enqueue" if seq < 12 else rng.choices(actions, weights=[3, 5, 5, 2, 2, 1, 3, 5, 0.2])[0]
        rows.append((seq % 12, seq, action, rng.uniform(-0.5, 1.5), rng.choice([None, "bước"]), "storage"))
    return rows


def brute_jobs(rows):
    state = {}
    for job, seq, action, progress, stage, failure in sorted(rows, key=lambda r: r[1]):
        row = state.get(job)
        if action == "enqueue":
            state[job] = ["queued", 0.0, stage or "Đang chờ", None]
        if row is None:
            continue
        if action == "dismiss":
            state[job] = None
        elif action == "report" and row[0] in ("queued", "running"):
            row[:3] = ["running", min(max(progress, 0.0), 1.0), stage or row[2]]
        elif action == "start":
            row[0], row[2] = "running", stage or row[2]
        elif action == "succeed":
            row[:3] = ["succeeded", 1.0, "Xong"]
        elif action == "fail":
            row[0], row[2], row[3] = "failed", "Thất bại", failure
        elif action == "cancel":
            row[0], row[2], row[3] = "cancelled", "Đã hủy", None
        elif action == "retry":
            row[:] = ["queued", 0.0, "Đang chờ", None]
    return {k: tuple(v) for k, v in state.items() if v}


def timed_stream(spark, rows, schema, seed, wait_rows, step_ms=1000, files=3):
    """The rows with a time for each number, in any order within ``wait_rows`` of their place, and one far later event of another key.

    The stream ends with the watermark behind that event, so that all others are released.
    """
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, wait_rows)) if wait_rows else rows
    last = max(r[1] for r in rows) + 10_000
    key = type(rows[0][0])(-1)
    none = [None] * (len(rows[0]) - 3)
    order = [*order, *[None] * (-len(order) % files)]  # the later events stand in files of their own
    order += [x for i in (0, 1) for x in ((key, last + 10_000 * i, "none", *none), *[None] * (len(order) // files - 1))]
    frame = as_stream(spark, order, schema, files + 2)
    return frame.withColumn("at", F.timestamp_millis(F.col("seq") * step_ms + 1)), last * step_ms


JOB_VALUES = ("status", "progress", "stage", "failure")


@pytest.mark.parametrize("wait_rows,seed", [(0, 1), (60, 2)])
def test_job_fold(spark, wait_rows, seed):
    rows = job_rows()
    want = brute_jobs(rows)
    batch = jobs.fold_jobs(spark.createDataFrame(rows, JOB_SCHEMA)).collect()
    assert {r.job_id: tuple(r[c] for c in JOB_VALUES) for r in batch} == want

    stream, _ = timed_stream(spark, rows, JOB_SCHEMA, seed, wait_rows)
    table = run(spark, jobs.fold_jobs_stream(stream, wait="100 seconds"), f"job_rows_{seed}", "update")
    live = jobs.live_jobs(table).collect()
    assert {r.job_id: tuple(r[c] for c in JOB_VALUES) for r in live} == want
    assert {r.job_id: r.last_seq for r in live} == {r.job_id: r.last_seq for r in batch}


def test_jobs_expire_in_a_stream_as_in_the_batch(spark):
    rng = random.Random(6)
    rows, seq = [], 0
    for seq in range(90):
        # Gaps of three seconds and more end a job; job 7 is abandoned for good.
        job = 7 if seq < 6 else rng.choice([1, 1, 1, 2, 2, 3])
        rows.append((job, seq, rng.choice(["enqueue", "start", "report", "fail"]) if seq % 3 else "enqueue", 0.5, None, "storage"))
    keep = 3000
    state, met = {}, {}
    for row in rows:
        if row[0] in met and (row[1] - met[row[0]]) * 1000 > keep:
            state.pop(row[0], None)
        met[row[0]] = row[1]
        state[row[0]] = [*state.get(row[0], []), row]
    want = {k: v for own in state.values() for k, v in brute_jobs(own).items()}
    frame = spark.createDataFrame(rows, JOB_SCHEMA).withColumn("at", F.timestamp_millis(F.col("seq") * 1000))
    batch = {r.job_id: tuple(r[c] for c in JOB_VALUES) for r in jobs.fold_jobs(frame, keep).collect()}
    assert batch == want and 7 in batch

    def upto(ms):
        return {r.job_id: tuple(r[c] for c in JOB_VALUES) for r in jobs.fold_jobs(frame, keep, until=f"1970-01-01 00:0{ms // 60000}:{ms // 1000 % 60:02d}").collect()}

    assert 7 not in upto(88_000) and set(upto(88_000)) == {k for k, at in met.items() if at + 3 > 88 and k in want}
    stream, _ = timed_stream(spark, rows, JOB_SCHEMA, 3, 20)
    table = run(spark, jobs.fold_jobs_stream(stream, wait="40 seconds", keep_ms=keep), "expired_rows", "update")
    assert jobs.live_jobs(table).collect() == []  # the stream ended long after every job's time
    last = {}
    for r in table.collect():
        if r.status != "dismissed":
            last[r.job_id] = max(last.get(r.job_id, (-1,)), (r.last_seq, *(r[c] for c in JOB_VALUES)), key=lambda x: x[0])
    assert {k: last[k][1:] for k in want} == want
    assert {r.job_id for r in table.filter("status = 'dismissed'").collect()} == set(last)


def test_dismissed_job_is_removed_and_may_come_again(spark):
    rows = [(1, 0, "enqueue", None, "a", None), (2, 1, "enqueue", None, "b", None), (1, 2, "dismiss", None, None, None),
            (3, 3, "dismiss", None, None, None), (2, 4, "dismiss", None, None, None), (2, 5, "enqueue", None, "c", None)]
    stream, _ = timed_stream(spark, rows, JOB_SCHEMA, 4, 0)
    table = run(spark, jobs.fold_jobs_stream(stream), "dismissed_rows", "update")
    assert {(r.job_id, r.status, r.last_seq) for r in table.collect()} == {
        (1, "queued", 0), (1, "dismissed", 2), (2, "queued", 1), (2, "dismissed", 4), (2, "queued", 5)}
    assert [tuple(r) for r in jobs.live_jobs(table).collect()] == [(2, "queued", 0.0, "c", None, 5)]
    assert [tuple(r)[:4] for r in jobs.fold_jobs(spark.createDataFrame(rows, JOB_SCHEMA)).collect()] == [(2, "queued", 0.0, "c")]


PLAY_SCHEMA = "document_id string, seq bigint, action string, idx bigint"


def brute_playback(rows):
    want = {}
    for doc, _, action, idx in sorted(rows, key=lambda r: r[1]):
        own = want.setdefault(doc, {})
        if action == "invalidate":
            own.update({i: "idle" for i in own if i >= idx})
            continue
        if action == "play":
            own.update({i: "played" for i, s in own.items() if s == "playing" and i != idx})
        own[idx] = playback.STATUS[action]
    return {(d, i): s for d, own in want.items() for i, s in own.items()}


def playback_rows():
    rng = random.Random(9)
    actions = ["play", "play", "save", "played", "fail", "retry", "invalidate"]
    return [("d%d" % rng.randrange(3), seq, rng.choice(actions), rng.randrange(12)) for seq in range(150)]


def test_playback_fold(spark):
    rows = playback_rows()
    flat = brute_playback(rows)
    batch = playback.fold_playback(spark.createDataFrame(rows, PLAY_SCHEMA)).collect()
    assert {(r.document_id, r.idx): r.status for r in batch} == flat

    stream, _ = timed_stream(spark, rows, PLAY_SCHEMA, 5, 50)
    out = run(spark, playback.fold_playback_stream(stream, wait="80 seconds"), "playback_rows", "update")
    last = {}
    for r in out.collect():  # the memory sink keeps rows in the order they came
        last[r.document_id, r.idx] = r.status
    assert last == flat


def test_playback_expires_in_a_stream_as_in_the_batch(spark):
    rows = [r if r[0] != "d1" or r[1] < 40 or r[1] > 90 else ("d0", *r[1:]) for r in playback_rows()]
    keep, kept, met = 20_000, {}, {}
    for r in rows:
        if r[0] in met and (r[1] - met[r[0]]) * 1000 > keep:
            kept[r[0]] = []
        met[r[0]] = r[1]
        kept.setdefault(r[0], []).append(r)
    assert len(kept["d1"]) < sum(r[0] == "d1" for r in rows)
    want = brute_playback([r for own in kept.values() for r in own])
    frame = spark.createDataFrame(rows, PLAY_SCHEMA).withColumn("at", F.timestamp_millis(F.col("seq") * 1000))
    assert {(r.document_id, r.idx): r.status for r in playback.fold_playback(frame, keep).collect()} == want
    assert playback.fold_playback(frame, keep, until="1970-01-01 01:00:00").count() == 0
    stream, _ = timed_stream(spark, rows, PLAY_SCHEMA, 6, 30)
    out = run(spark, playback.fold_playback_stream(stream, wait="60 seconds", keep_ms=keep), "forgotten_rows", "update").collect()
    last, before = {}, {}
    for r in out:
        if r.status == playback.FORGOTTEN:
            before[r.document_id, r.idx] = last.pop((r.document_id, r.idx))
        else:
            last[r.document_id, r.idx] = r.status
    assert last == {} and {k: before[k] for k in want} == want


def test_progress(spark):
    schema = "document_id string, idx bigint, outcome string"
    rows = [("a", i, "failed" if i == 2 else "model_missing" if i in (5, 7) else "ok") for i in range(9)]
    rows += [("b", i, "ok") for i in range(4)]
    want = {"a": (5, 2, True), "b": (4, 0, False)}
    batch = streams.progress(spark.createDataFrame(rows, schema)).collect()
    assert {r.document_id: (r.completed, r.failed, r.stopped) for r in batch} == want
    table = run(spark, streams.progress_stream(as_stream(spark, rows, schema, 2)), "progress_rows", "update")
    last = table.groupBy("document_id").agg(F.max(F.struct("completed", "failed", "stopped")).alias("r")).collect()
    assert {r.document_id: tuple(r.r) for r in last} == want


def test_progress_takes_rows_in_any_order(spark):
    schema = "document_id string, idx bigint, outcome string"
    late = [("a", i, "model_missing" if i == 7 else "ok") for i in (8, 7, 6, 4)]
    early = [("a", 5, "model_missing"), ("a", 0, "ok"), ("a", 1, "failed"), ("a", 6, "failed")]
    batch = streams.progress(spark.createDataFrame(late + early, schema)).collect()
    assert [tuple(r) for r in batch] == [("a", 3, 2, True)]
    table = run(spark, streams.progress_stream(as_stream(spark, late + early, schema, 2)), "unordered_rows", "update")
    rows = {tuple(r) for r in table.collect()}
    assert len(rows) == 2 and ("a", 3, 2, True) in rows


@pytest.mark.parametrize("fn,name", [(streams.track_positions, "positions"), (lambda d: streams.running_max(d, "document_id", "position_ms"), "slowest")])
def test_update_mode_aggregates(spark, fn, name):
    schema = "document_id string, updated_at bigint, seq bigint, position_ms bigint"
    rows = [("d%d" % (i % 3), i, i, (i * 37) % 50 - 10) for i in range(40)]
    want = sorted(map(tuple, fn(spark.createDataFrame(rows, schema)).collect()))
    got = run(spark, fn(as_stream(spark, rows, schema)), name, "update").collect()
    assert set(want) <= set(map(tuple, got))


def test_debounce(spark):
    schema = "user_id bigint, ts timestamp, value string, committed boolean"
    base = [(1, 0.0, "m", False), (1, 0.1, "má", False), (1, 0.2, "máy", False), (1, 1.0, "máy h", False),
            (1, 1.05, "máy học", True), (2, 0.5, "x", False)]
    rows = spark.createDataFrame([(u, float(t), v, c) for u, t, v, c in base], "user_id bigint, t double, value string, committed boolean")
    events = rows.select("user_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("ts"), "value", "committed")
    want = {(1, "máy"), (1, "máy h"), (1, "máy học"), (2, "x")}
    assert {(r.user_id, r.value) for r in streams.debounce(events, "user_id", 0.25).collect()} == want
    # A late event of another user moves the watermark past every burst.
    late = spark.createDataFrame([(9, 3600.0, "late", False)], "user_id bigint, t double, value string, committed boolean").select(
        "user_id", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("ts"), "value", "committed"
    )
    directory = tempfile.mkdtemp(prefix="lectern-stream-")
    events.coalesce(1).write.mode("append").parquet(directory)
    late.coalesce(1).write.mode("append").parquet(directory)
    stream = spark.readStream.schema(schema).parquet(directory)
    out = run(spark, streams.debounce_stream(stream, "user_id", "250 milliseconds"), "bursts", "append")
    assert {(r.user_id, r.value) for r in out.collect()} >= want


def test_live_library(spark):
    base = spark.createDataFrame([("a", "queued", 1), ("b", "ready", 2)], "uuid string, status string, updated_at bigint")
    schema = "uuid string, status string, updated_at bigint, seq bigint, written array<string>"
    both = ["status", "updated_at"]
    rows = [("a", "ready", 5, 1, both), ("c", "ready", 6, 2, both), ("b", "failed", 7, 3, both), ("b", "x", 8, 4, ["updated_at"])]
    live = streams.LiveLibrary(spark, base, tempfile.mkdtemp(prefix="lectern-live-"))
    query = live.start(as_stream(spark, rows, schema, 2), tempfile.mkdtemp(prefix="lectern-check-")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r.uuid, r.updated_at) for r in live.view(schema, status="ready").collect()] == [("c", 6), ("a", 5)]
    want = {("a", "ready", 5), ("b", "failed", 8), ("c", "ready", 6)}
    assert {tuple(r) for r in live.current(schema).collect()} == want
    before = live.version()
    old = live.view(schema, status="ready")
    assert {tuple(r) for r in live.compact(schema).collect()} == want
    assert live.version() == streams.Version(before.batch, before.batch)
    # A view built before reads on, and can be built again.
    assert [(r.uuid, r.updated_at) for r in old.collect()] == [("c", 6), ("a", 5)]
    assert {tuple(r) for r in live.current(schema, before).collect()} == want
    live.compact(schema, keep_ms=0)
    assert not glob.glob(f"{live.directory}/log/batch=*")
    assert {tuple(r) for r in live.current(schema).collect()} == want
    live.absorb(spark.createDataFrame([("c", "queued", 9, 5, both)], schema), 2)
    want = want - {("c", "ready", 6)} | {("c", "queued", 9)}
    again = streams.LiveLibrary(spark, base, live.directory)  # another driver finds the base
    assert {tuple(r) for r in again.current(schema).collect()} == want
    newer = again.version()
    assert {tuple(r) for r in again.compact(schema).collect()} == want
    assert len(glob.glob(f"{live.directory}/base-*")) == 2 and {tuple(r) for r in again.current(schema, newer).collect()} == want
    assert {tuple(r) for r in again.compact(schema, keep_ms=0).collect()} == want
    assert len(glob.glob(f"{live.directory}/base-*")) == 1 and not glob.glob(f"{live.directory}/log/batch=*")
    for gone in (before, newer):
        with pytest.raises(ValueError):
            again.current(schema, gone)


def test_watch_files(spark):
    directory = tempfile.mkdtemp(prefix="lectern-files-")
    open(f"{directory}/a.txt", "w").write("xin chào")
    open(f"{directory}/b.png", "w").write("not an image")
    out = run(spark, streams.watch_files(spark, directory).select("name", "accepted", "reason"), "arrivals", "append")
    assert {tuple(r) for r in out.collect()} == {("a.txt", True, None), ("b.png", False, "mismatch")}
