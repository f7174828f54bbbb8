"""Keyed folds in event time: events wait in the state until the watermark has passed them.

Every event of a key is kept under its time and released by a timer of that time, so that events are
applied in the order of time and number whatever order they arrive in, and no trigger's rows are
gathered or sorted: a call holds the events of one key and one millisecond.  A key that has had no event for
the time it is kept is ended by a timer too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WAIT = "10 seconds"


def present(value):
    return None if value is None or value is pd.NA or value != value else value


class TimedFold(StatefulProcessor):
    """Buffers events by time; subclasses say how one is applied and what is left when a key ends.

    ``FIELDS`` is the schema of a buffered event, its number ``seq`` first, and ``ROW`` the names of the rows
    given.  Late events, behind the watermark, never get here: Spark drops them.
    """

    FIELDS = ""
    ROW: list[str] = []
    by_row = False  # whether the first value of a row tells the rows of a key apart

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, place bigint", self.FIELDS)
        self.counts = handle.getMapState("counts", "at bigint", "n bigint")
        self.end = handle.getValueState("end", "at bigint")
        self.open()

    def open(self) -> None:
        """Create the state of the fold itself."""

    def apply(self, event: tuple) -> list[tuple]:
        """Apply one event and return the rows that changed."""
        raise NotImplementedError

    def live(self) -> bool:
        """Whether the key has anything left to keep."""
        raise NotImplementedError

    def finish(self) -> list[tuple]:
        """End the key and return the rows that say so."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in self.FIELDS.split(", ")]
        for frame in rows:
            for at, *values in zip(frame["at_ms"], *(frame[c] for c in names)):
                at = int(at)
                place = self.counts.getValue((at,))[0] if self.counts.containsKey((at,)) else 0
                self.waiting.updateValue((at, place), tuple(present(v) for v in values))
                self.counts.updateValue((at,), (place + 1,))
                if not place:
                    self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        events = []
        if self.counts.containsKey((at,)):
            for place in range(self.counts.getValue((at,))[0]):
                events.append(tuple(self.waiting.getValue((at, place))))
                self.waiting.removeKey((at, place))
            self.counts.removeKey((at,))
        end = self.end.get()[0] if self.keep_ms and self.end.exists() else None
        changed: dict = {}
        if end is not None and (end < at or end == at and not events):
            # Events and ends that fall due together keep their order.
            changed = {("end", i): row for i, row in enumerate(self.finish())}
            self.end.clear()
            end = None
        for event in sorted(events, key=lambda e: e[0]):
            changed.update({row[0] if self.by_row else None: row for row in self.apply(event)})
        if self.keep_ms and events:
            self._put_off(at, end)
        out = list(changed.values())
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.ROW)

    def _put_off(self, at: int, end: int | None) -> None:
        """The end of a key that has met an event comes ``keep_ms`` after it, or with the next trigger if that time has passed."""
        if end is not None and end != at and not self.counts.containsKey((end,)):
            self.handle.deleteTimer(end)
        if self.live():
            self.handle.registerTimer(at + self.keep_ms)
            self.end.update((at + self.keep_ms,))
        elif end is not None:
            self.end.clear()

    def close(self) -> None:
        pass


def timed(events: DataFrame, by: str, at: str, fold: TimedFold, wait: str, output: str) -> DataFrame:
    """The rows a fold gives as the watermark, ``wait`` behind the newest event, goes on."""
    marked = events.withWatermark(at, wait).withColumn("at_ms", F.unix_millis(at))
    return marked.groupBy(by).transformWithStateInPandas(fold, output, "Update", "EventTime")
