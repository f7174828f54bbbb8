"""Playback status of sentences as a batch fold and as a keyed streaming fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running, slice_of
from .timed import WAIT, TimedFold, timed

# Actions on one sentence and the status they set.
STATUS = {"play": "playing", "played": "played", "save": "ready", "fail": "failed", "retry": "idle"}


FORGOTTEN = "forgotten"


def fold_playback(events: DataFrame, keep_ms: int | None = None, until=None) -> DataFrame:
    """Status of every touched sentence.

    ``events`` is ``(document_id, seq, action, idx)``.  A sentence shows its own latest
    action unless a later invalidation started at or before it; of all ``play`` actions of a
    document only the latest still plays.

    With ``keep_ms`` events have a time ``at`` that grows with ``seq``, and a document without an event for
    longer than that is forgotten; ``until`` is the time up to which is looked.
    """
    if keep_ms:
        met = running(events, ["document_id"], ["seq"], [slice_of("seq")], {"_met": ("last", F.unix_millis("at"))})
        lost = F.when(F.unix_millis("at") - F.col("_met") > keep_ms, F.col("seq"))
        kept = met.groupBy("document_id").agg(F.max(lost).alias("_from"), F.max(F.unix_millis("at")).alias("_last"))
        if until is not None:
            kept = kept.filter(F.col("_last") + keep_ms > F.unix_millis(F.lit(until).cast("timestamp")))
        events = events.join(kept, "document_id").filter(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
    own = events.filter(F.col("action").isin(*STATUS)).groupBy("document_id", "idx").agg(
        F.max(F.struct("seq", "action")).alias("own")
    )
    resets = events.filter(F.col("action") == "invalidate").groupBy("document_id", "idx").agg(
        F.max("seq").alias("_reset")
    )
    # The latest reset that reaches a sentence is a running maximum over the index.
    both = own.join(resets, ["document_id", "idx"], "full")
    reached = running(
        both, ["document_id"], ["idx"], [slice_of("idx")], {"_reset_at": ("max", F.col("_reset"))}, inclusive=True
    ).filter("own is not null")
    last_play = events.filter(F.col("action") == "play").groupBy("document_id").agg(F.max("seq").alias("_playing"))
    status = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col("own.action"))
    return reached.join(last_play, "document_id", "left").select(
        "document_id", "idx",
        F.when(F.col("_reset_at") > F.col("own.seq"), "idle")
        .when((F.col("own.action") == "play") & (F.col("own.seq") < F.col("_playing")), "played")
        .otherwise(status)
        .alias("status"),
    )


class PlaybackFold(TimedFold):
    """Sentence statuses of one document in a map keyed by sentence index."""

    FIELDS = "seq bigint, action string, idx bigint"
    ROW = ["document_id", "idx", "status"]
    by_row = True

    def open(self) -> None:
        self.status = self.handle.getMapState("status", "idx bigint", "status string")
        self.playing = self.handle.getValueState("playing", "idx bigint")

    def _set(self, idx: int, status: str) -> tuple:
        self.status.updateValue((idx,), (status,))
        return idx, status

    def apply(self, event: tuple) -> list[tuple]:
        _, action, idx = event
        if idx is None or action not in (*STATUS, "invalidate"):
            return []
        idx = int(idx)
        if action == "invalidate":
            return [self._set(other, "idle") for (other,) in [k for k in self.status.keys() if k[0] >= idx]]
        changed = []
        if action == "play":
            before = self.playing.get()[0] if self.playing.exists() else None
            if before is not None and before != idx and self.status.getValue((before,))[0] == "playing":
                changed.append(self._set(before, "played"))
            self.playing.update((idx,))
        return [*changed, self._set(idx, STATUS[action])]

    def live(self) -> bool:
        return self.status.exists()

    def finish(self) -> list[tuple]:
        gone = [(idx, FORGOTTEN) for (idx,) in self.status.keys()]
        self.status.clear()
        self.playing.clear()
        return gone


def fold_playback_stream(events: DataFrame, at: str = "at", wait: str = WAIT, keep_ms: int | None = None) -> DataFrame:
    """The streaming twin: every status that the watermark has changed.

    ``at`` is the time of an event and grows with ``seq``; events may arrive in any order within ``wait``.  A
    document without events for ``keep_ms`` gives a row of the status ``forgotten`` for each of its sentences and is
    forgotten: its sentences are untouched again.
    """
    key = events.schema["document_id"].dataType.simpleString()
    return timed(events, "document_id", at, PlaybackFold(keep_ms), wait, f"document_id {key}, idx bigint, status string")
