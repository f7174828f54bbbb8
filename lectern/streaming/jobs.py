"""The job state machine as a batch fold and as a keyed streaming fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running, slice_of
from .timed import WAIT, TimedFold, timed

# Actions, the status they lead to and the stage wording.
STATUS = {"enqueue": "queued", "start": "running", "retry": "queued",
          "succeed": "succeeded", "fail": "failed", "cancel": "cancelled"}
STAGE = {"enqueue": "Đang chờ", "retry": "Đang chờ", "succeed": "Xong", "fail": "Thất bại", "cancel": "Đã hủy"}
DISMISSED = "dismissed"
OPENING = ("enqueue", "start", "retry")

EVENTS = "job_id, seq, at, action, progress, stage, failure"
OUTPUT = "job_id {key}, status string, progress double, stage string, failure string, last_seq bigint"


def fold_jobs(events: DataFrame, keep_ms: int | None = None, until=None) -> DataFrame:
    """The final row of every job that was not dismissed.

    ``events`` is ``(job_id, seq, action, progress, stage, failure)``.  A job lives from an enqueue to its
    dismissal.  A progress report counts only while its job is active; everything else is the latest
    value of some kind, and an enqueue sets them all, so the fold is one carried value and one aggregate.

    With ``keep_ms`` events have a time ``at`` that grows with ``seq``, and a job without an event for
    longer than that is forgotten: later events count as those of an unknown job.  ``until`` is the time up to which is
    looked.
    """
    action, seq = F.col("action"), F.col("seq")
    lost = F.lit(False)
    if keep_ms:
        events = running(
            events, ["job_id"], ["seq"], [slice_of("seq")], {"_met": ("last", F.unix_millis("at"))}
        ).withColumn("_lost", F.coalesce(F.unix_millis("at") - F.col("_met") > keep_ms, F.lit(False)))
        lost = F.col("_lost")
    turn = F.when(action == "enqueue", "enqueue").when((action == "dismiss") | lost, "dismiss")
    carried = running(
        events, ["job_id"], ["seq"], [slice_of("seq")],
        {"_before": ("last", F.when(action.isin(*STATUS), action)), "_turn": ("last", turn)},
    )
    alive = F.coalesce(turn, F.col("_turn")) == "enqueue"
    reported = (action == "report") & F.col("_before").isin(*OPENING)
    counted = carried.select(
        "*", turn.alias("_own_turn"), (F.coalesce(alive, F.lit(False)) & (reported | action.isin(*STATUS))).alias("_counts"),
    ).withColumn("_reported", F.col("_counts") & reported).withColumn("_moves", F.col("_counts") & action.isin(*STATUS))
    at_when = lambda condition: F.when(F.col("_counts") & condition, seq)
    progress = (
        F.when(F.col("_reported"), F.least(F.greatest("progress", F.lit(0.0)), F.lit(1.0)))
        .when(action == "succeed", 1.0)
        .when(action.isin("enqueue", "retry"), 0.0)
    )
    fixed = F.create_map(*[F.lit(x) for kv in STAGE.items() for x in kv])
    stage = F.when(action.isin("enqueue", "start", "report"), F.coalesce("stage", F.try_element_at(fixed, action))).otherwise(
        F.try_element_at(fixed, action)
    )
    folded = (
        counted.withColumn("_progress", progress).withColumn("_stage", stage)
        .groupBy("job_id")
        .agg(
            F.max_by("_own_turn", F.when(F.col("_own_turn").isNotNull(), seq)).alias("_turn"),
            *([F.max(F.unix_millis("at")).alias("_met")] if keep_ms else []),
            F.max_by("action", at_when(F.col("_moves"))).alias("_last"),
            F.coalesce(F.max(at_when(F.col("_reported"))) > F.max(at_when(F.col("_moves"))), F.lit(False)).alias("_moving"),
            F.max_by("_progress", at_when(F.col("_progress").isNotNull())).alias("progress"),
            F.max_by("_stage", at_when(F.col("_stage").isNotNull())).alias("stage"),
            F.max_by(
                F.struct(F.when(action == "fail", F.col("failure")).alias("failure")),
                at_when(action.isin("enqueue", "fail", "cancel", "retry")),
            )["failure"].alias("failure"),
            F.max(at_when(F.lit(True))).alias("last_seq"),
        )
        .filter(F.col("_turn") == "enqueue")
    )
    if keep_ms and until is not None:
        folded = folded.filter(F.col("_met") + keep_ms > F.unix_millis(F.lit(until).cast("timestamp")))
    return folded.select(
        "job_id",
        F.when(F.col("_moving"), "running")
        .otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("_last")))
        .alias("status"),
        "progress", "stage", "failure", F.col("last_seq").cast("bigint").alias("last_seq"),
    )


def clear_finished(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin("queued", "running"))


class JobFold(TimedFold):
    """Keeps the current row of one job and applies its events in order."""

    SCHEMA = "status string, progress double, stage string, failure string, last_seq bigint"
    FIELDS = "seq bigint, action string, progress double, stage string, failure string"
    ROW = ["job_id", "status", "progress", "stage", "failure", "last_seq"]

    def open(self) -> None:
        self.job = self.handle.getValueState("job", self.SCHEMA)

    @staticmethod
    def step(job, event):
        seq, action, progress, stage, failure = event
        seq = int(seq)
        if job is None:
            return ("queued", 0.0, stage or STAGE["enqueue"], None, seq) if action == "enqueue" else None
        status, done, label, reason, _ = job
        if action == "dismiss":
            return None
        if action == "report":
            if status not in ("queued", "running"):
                return job
            return ("running", min(max(float(progress), 0.0), 1.0), stage or label, reason, seq)
        if action not in STATUS:
            return job
        if action in ("enqueue", "retry"):
            done, reason = 0.0, None
        elif action == "succeed":
            done = 1.0
        elif action in ("fail", "cancel"):
            reason = failure if action == "fail" else None
        label = (stage if action in ("start", "enqueue") else None) or STAGE.get(action, label)
        return (STATUS[action], done, label, reason, seq)

    def apply(self, event: tuple) -> list[tuple]:
        before = tuple(self.job.get()) if self.job.exists() else None
        job = self.step(before, event)
        if job is not None:
            self.job.update(job)
            return [job]
        if before is None:
            return []
        self.job.clear()
        return [(DISMISSED, None, None, None, int(event[0]))]

    def live(self) -> bool:
        return self.job.exists()

    def finish(self) -> list[tuple]:
        if not self.job.exists():
            return []
        last = int(self.job.get()[4])
        self.job.clear()
        return [(DISMISSED, None, None, None, last)]


def fold_jobs_stream(events: DataFrame, at: str = "at", wait: str = WAIT, keep_ms: int | None = None) -> DataFrame:
    """The streaming twin: the new row of every job that the watermark has brought events to.

    ``at`` is the time of an event and grows with ``seq``; events may arrive in any order within ``wait``.
    A dismissed job gives one row of the status ``dismissed`` and no other values; ``live_jobs``
    takes such jobs out of the rows a sink has kept.
    State holds the events the watermark has not passed and one row per live job.  A dismissed job frees it
    at once; one without events for ``keep_ms`` gives a dismissed row and is forgotten.
    """
    key = events.schema["job_id"].dataType.simpleString()
    return timed(events, "job_id", at, JobFold(keep_ms), wait, OUTPUT.format(key=key))


def live_jobs(emitted: DataFrame) -> DataFrame:
    """The latest row of every job among the rows a stream gave, without dismissed jobs."""
    fields = ["last_seq", *[c for c in emitted.columns if c not in ("job_id", "last_seq")]]
    # An abandoned job ends with the number of its last event.
    latest = emitted.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("last_seq", F.col("status") == DISMISSED)).alias("row"))
    return latest.select("job_id", "row.*").where(F.col("status") != DISMISSED).select(emitted.columns)
