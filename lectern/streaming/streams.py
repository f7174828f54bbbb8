"""Streaming jobs on built-in aggregates, each with a batch twin.

Lateness: the debounce watermark is chosen by the caller; positions and maxima need none
because a late row can never replace a newer or larger value.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.library import filter_library, sort_library
from ..operators.maintenance import upsert
from ..operators.ordered import previous
from ..sources.files import validate_files

SEARCH_GAP, POSITION_GAP = "250 milliseconds", "1 second"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


# -- debounce ------------------------------------------------------------------------


def debounce_stream(events: DataFrame, key: str, gap: str = SEARCH_GAP, watermark: str = "10 seconds") -> DataFrame:
    """The last value of every burst; rows flagged ``committed`` pass at once.

    ``events`` is ``(key, ts, value, committed)``.  A burst is a session whose gap is the
    debounce delay; the watermark closes it and frees its state.
    """
    typed = events.filter(~F.col("committed")).withWatermark("ts", watermark)
    bursts = typed.groupBy(key, F.session_window("ts", gap)).agg(
        F.max("ts").alias("at"), F.max_by("value", "ts").alias("value")
    )
    committed = events.filter("committed").select(key, F.col("ts").alias("at"), "value")
    return bursts.select(key, "at", "value").unionByName(committed)


def debounce(events: DataFrame, key: str, gap_seconds: float, slice_seconds: int = 3600) -> DataFrame:
    """The batch twin: rows that no row of the same key follows within the gap."""
    typed = events.filter(~F.col("committed")).withColumn("_micros", -F.unix_micros("ts"))
    slices = [F.floor(F.col("_micros") / F.lit(slice_seconds * 1_000_000))]
    followed = previous(typed, [key], ["_micros"], slices, ["_micros"], "_next")
    wait = F.col("_micros") - F.col("_next._micros")
    last = followed.filter(F.col("_next").isNull() | (wait >= int(gap_seconds * 1_000_000)))
    committed = events.filter("committed")
    return last.select(key, F.col("ts").alias("at"), "value").unionByName(
        committed.select(key, F.col("ts").alias("at"), "value")
    )


# -- latest and largest --------------------------------------------------------------


def track_positions(events: DataFrame) -> DataFrame:
    """The latest position of every document; works on streams (update mode) and on tables."""
    fields = [c for c in events.columns if c != "document_id"]
    return events.groupBy("document_id").agg(
        F.max_by(F.struct(*fields), F.struct("updated_at", "seq")).alias("row")
    ).select("document_id", "row.*")


def running_max(events: DataFrame, by: str, value: str) -> DataFrame:
    """The slowest positive measurement seen so far."""
    return events.filter(F.col(value) > 0).groupBy(by).agg(F.max(value).alias("slowest"))


# -- progress ------------------------------------------------------------------------


def progress(results: DataFrame) -> DataFrame:
    """Completed and failed sentences per document, counted up to a missing model.

    ``results`` is ``(document_id, idx, outcome)`` with outcome ``ok``, ``failed`` or
    ``model_missing``.  The row that reports the missing model counts as failed but not as
    completed, and nothing after it counts.
    """
    stops = results.filter(F.col("outcome") == "model_missing").groupBy("document_id").agg(F.min("idx").alias("_stop"))
    seen = results.join(stops, "document_id", "left").filter(F.col("_stop").isNull() | (F.col("idx") <= F.col("_stop")))
    return seen.groupBy("document_id").agg(
        F.count_if(F.col("outcome") != "model_missing").alias("completed"),
        F.count_if(F.col("outcome") != "ok").alias("failed"),
        F.max(F.col("outcome") == "model_missing").alias("stopped"),
    )


class ProgressFold(StatefulProcessor):
    """Counts of one document up to its smallest missing model, whatever order its rows arrive in.

    The state maps every sentence up to the stop to its outcomes, so a smaller stop that
    arrives later takes back what counted beyond it.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "completed bigint, failed bigint, stop bigint", self.ttl_ms)
        self.seen = handle.getMapState("seen", "idx bigint, outcome string", "n bigint", self.ttl_ms)

    @staticmethod
    def _added(counts: tuple[int, int], outcome: str, n: int) -> tuple[int, int]:
        return counts[0] + n * (outcome != "model_missing"), counts[1] + n * (outcome != "ok")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        completed, failed, stop = self.counts.get() if self.counts.exists() else (0, 0, None)
        counts, first = (completed, failed), stop
        for frame in rows:
            for (idx, outcome), n in frame.groupby(["idx", "outcome"]).size().items():
                if stop is not None and idx > stop:
                    continue
                entry, n = (int(idx), outcome), int(n)
                before = self.seen.getValue(entry)[0] if self.seen.containsKey(entry) else 0
                self.seen.updateValue(entry, (before + n,))
                counts = self._added(counts, outcome, n)
                if outcome == "model_missing":
                    stop = int(idx)
        if stop != first:
            counts = (0, 0)
            for (idx, outcome), (n,) in self.seen.iterator():
                if idx <= stop:
                    counts = self._added(counts, outcome, n)
        self.counts.update((*counts, stop))
        yield pd.DataFrame(
            [(key[0], *counts, stop is not None)], columns=["document_id", "completed", "failed", "stopped"]
        )

    def close(self) -> None:
        pass


def progress_stream(results: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The streaming twin: the counts of every document a trigger touched.

    State holds one entry per sentence up to the stop and stays unless ``ttl_ms`` is given.
    """
    key = results.schema["document_id"].dataType.simpleString()
    return results.groupBy("document_id").transformWithStateInPandas(
        ProgressFold(ttl_ms), f"document_id {key}, completed bigint, failed bigint, stopped boolean", "Update",
        "ProcessingTime" if ttl_ms else "None",
    )


# -- live view and arrivals ----------------------------------------------------------


@dataclass(frozen=True)
class Version:
    """What a view is built on: the base named after the last batch folded into it, and the last batch applied to it."""

    base: int
    batch: int


class LiveLibrary:
    """A library view kept current from a stream of changes.

    Each trigger appends its changes to a log folder named after its batch, so a retried
    batch overwrites itself.  A view is a base with newer log folders applied and is named by its ``Version``.
    ``compact`` folds the log into a new base.  Bases and log folders that a view can still be built on stay for a stated
    time after a newer base has taken over, so views built before a compaction can be read on; then they go.
    """

    KEEP_MS = 24 * 3600 * 1000

    def __init__(self, spark: SparkSession, base: DataFrame, directory: str):
        self.spark, self.given, self.directory = spark, base, directory

    def absorb(self, changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.directory}/log/batch={batch}")

    def start(self, changes: DataFrame, checkpoint: str):
        return changes.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str, prefix: str) -> list[int]:
        """The numbers in the names of folders; only names are listed."""
        files, path = self._path(name)
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())

    def _remove(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def _folds(self) -> list[tuple[int, int]]:
        """``(last batch, time)`` of every base that was written, in order; one row for each compaction."""
        files, path = self._path("folded")
        if not files.exists(path):
            return []
        read = self.spark.read.schema("through bigint, at bigint").parquet(f"{self.directory}/folded")
        return sorted((r["through"], r["at"]) for r in read.collect())

    def version(self) -> Version:
        """The newest base and the newest batch; -1 stands for the given base and for no batch."""
        base = max((through for through, _ in self._folds()), default=-1)
        return Version(base, max([base, *self._numbers("log", "batch=")]))

    def _base(self, through: int) -> DataFrame:
        return self.given if through < 0 else self.spark.read.schema(self.given.schema).parquet(f"{self.directory}/base-{through}")

    def _log(self, log_schema, version: Version) -> DataFrame:
        """Changes of the batches after the base, up to the version's."""
        folders = [f"{self.directory}/log/batch={n}" for n in self._numbers("log", "batch=") if version.base < n <= version.batch]
        if not folders:
            return self.spark.createDataFrame([], log_schema)
        return self.spark.read.schema(log_schema).parquet(*folders)

    def current(self, log_schema, version: Version | None = None) -> DataFrame:
        """The newest rows, or those of a version whose base is still kept."""
        version = version or self.version()
        if version.base < max(self._numbers("", "gone-"), default=-1):
            raise ValueError(f"the base of {version} is gone")
        return upsert(self._base(version.base), self._log(log_schema, version), "uuid", ["updated_at", "seq"])

    def view(
        self, log_schema, key: str = "updatedAt", ascending: bool = False, version: Version | None = None, **filters
    ) -> DataFrame:
        return sort_library(filter_library(self.current(log_schema, version), **filters), key, ascending)

    def compact(self, log_schema, keep_ms: int = KEEP_MS) -> DataFrame:
        """Fold the log into a new base, and drop what no version of the last ``keep_ms`` needs.

        A base is needed until a newer one has been there for that long, and so are the log folders after it.
        """
        version = self.version()
        if version.batch > version.base:
            self.current(log_schema, version).write.mode("overwrite").parquet(f"{self.directory}/base-{version.batch}")
            self.spark.createDataFrame([(version.batch, time.time_ns() // 1_000_000)], "through bigint, at bigint").coalesce(1).write.mode(
                "append").parquet(f"{self.directory}/folded")
        self._drop(time.time_ns() // 1_000_000 - keep_ms)
        return self._base(version.batch)

    def _drop(self, before: int) -> None:
        """Remove the bases, and the log folders only they need, that a newer base replaced by the time ``before``."""
        folds = self._folds()
        oldest = max((through for through, at in folds if at <= before), default=-1)
        if oldest >= 0:  # what is older can't be built any more, also if this ends half-way
            files, path = self._path(f"gone-{oldest}")
            files.mkdirs(path)
        for through in self._numbers("", "base-"):
            if through < oldest:
                self._remove(f"base-{through}")
        for batch in self._numbers("log", "batch="):
            if batch <= oldest:
                self._remove(f"log/batch={batch}")


def arrivals(files: DataFrame) -> DataFrame:
    """Files named from their paths and validated; works on streams and on tables."""
    return validate_files(files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)))


def watch_files(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Newly arrived files, validated."""
    return arrivals(
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger).load(directory)
    )
