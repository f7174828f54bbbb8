"""Table maintenance as rewrites: upserts, patches, deletes, flags, retention and audits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

JOB_DAYS, AUDIO_DAYS = 7, 30


def _latest(changes: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The latest written value of each column per key.

    ``written`` names the columns a change sets, which tells NULL from absent.  The values
    are aggregates, so a key with very many changes is combined before the shuffle.
    """
    at = F.struct(*order)
    return changes.groupBy(key).agg(
        *[
            F.max_by(F.struct(c), F.when(F.array_contains("written", c), at)).alias(f"_new_{c}")
            for c in columns
        ]
    )


def _merged(column: str) -> Column:
    new = F.col(f"_new_{column}")
    return F.when(new.isNotNull(), new[column]).otherwise(F.col(column)).alias(column)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Latest change wins per column; keys that are new are inserted."""
    columns = [c for c in base.columns if c != key]
    return base.join(_latest(changes, key, columns, order), key, "full").select(key, *map(_merged, columns))


def patch(base: DataFrame, patches: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Like ``upsert`` for rows that exist; patches of unknown keys change nothing."""
    columns = [c for c in base.columns if c != key]
    return base.join(_latest(patches, key, columns, order), key, "left").select(key, *map(_merged, columns))


# -- partitioned tables --------------------------------------------------------------

BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


class Partitioned:
    """A stored table in folders by the hash of its key; a rewrite reads and replaces the folders its changes fall in.

    A job that fails leaves the folders as they were, as new files are moved in place when all are written.  Changes of
    one table are written by one job at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> "Partitioned":
        table = cls(df.sparkSession, path, key, df.schema, buckets)
        table._write(df, "errorifexists")
        return table

    def read(self) -> DataFrame:
        return self._stored().select(self.schema.names)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)

    def _write(self, df: DataFrame, mode: str) -> None:
        placed = df.select(*self.schema.names, _bucket(self.key, self.buckets)).repartition("bucket")
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def rewrite(self, change: Callable[[DataFrame], DataFrame], keys: DataFrame) -> list[int]:
        """Apply ``change`` to the rows that share a bucket with ``keys``; returns the buckets that were rewritten.

        ``change`` maps those rows to what is to stay or come, and may only add keys out of ``keys``.
        """
        met = sorted(r[0] for r in keys.select(_bucket(self.key, self.buckets)).distinct().collect())  # at most ``buckets`` numbers
        if not met:
            return []
        rows = change(self._stored().filter(F.col("bucket").isin(met)).select(self.schema.names))
        left = {r[0] for r in rows.select(_bucket(self.key, self.buckets)).distinct().collect()}
        if left:
            self._write(rows, "overwrite")
        for bucket in set(met) - left:  # nothing is written for a bucket without rows, so its folder goes
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return met

    def upsert(self, changes: DataFrame, order: list[str]) -> list[int]:
        return self.rewrite(lambda rows: upsert(rows, changes, self.key, order).select(self.schema.names), changes)

    def patch(self, patches: DataFrame, order: list[str]) -> list[int]:
        return self.rewrite(lambda rows: patch(rows, patches, self.key, order).select(self.schema.names), patches)

    def delete(self, ids: DataFrame) -> list[int]:
        gone = ids.select(F.col(self.key).alias("_gone"))
        return self.rewrite(lambda rows: rows.join(gone, F.col(self.key) == F.col("_gone"), "left_anti"), ids)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, id: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    gone = ids.select(F.col(id).alias("_gone"))
    return {
        name: frame.join(gone, F.col(key) == F.col("_gone"), "left_anti")
        for name, (frame, key) in tables.items()
    }


def set_exclusive(df: DataFrame, choices: DataFrame, group: str, id: str, flag: str) -> DataFrame:
    """Exactly the chosen row of each group carries the flag; other groups stay as they are."""
    chosen = choices.select(group, F.col(id).alias("_chosen"))
    return df.join(chosen, group, "left").select(
        *[
            F.when(F.col("_chosen").isNull(), F.col(flag)).otherwise(F.col(id) == F.col("_chosen")).alias(flag)
            if c == flag
            else F.col(c)
            for c in df.columns
        ]
    )


def retain_jobs(jobs: DataFrame, now: Column, days: int = JOB_DAYS) -> DataFrame:
    """Jobs without the finished ones older than the limit."""
    old = F.col("updated_at") < now - F.make_dt_interval(F.lit(days))
    return jobs.filter(~(F.col("status").isin("completed", "failed") & old))


def retain_audio(cache: DataFrame, now: Column, days: int = AUDIO_DAYS) -> DataFrame:
    return cache.filter(~(F.col("last_accessed_at") < now - F.make_dt_interval(F.lit(days))))


# -- audits --------------------------------------------------------------------------


def cleanup_report(orphan_rows: DataFrame, files: DataFrame) -> DataFrame:
    """How many orphaned files exist and how many bytes they hold."""
    found = orphan_rows.join(files.select(F.col("path").alias("file_path"), "length"), "file_path")
    return found.agg(
        F.count(F.lit(1)).alias("deleted_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("freed_bytes")
    )


def _for_platform(manifest: DataFrame, platform: str) -> DataFrame:
    return manifest.filter((F.size("platforms") == 0) | F.array_contains("platforms", platform))


def audit_manifest(manifest: DataFrame, files: DataFrame, platform: str) -> DataFrame:
    """State of each component and its first bad path."""
    present = files.select("path", "length", F.col("sha256").alias("_digest"))
    partial = files.filter(F.col("path").endswith(".part")).select(
        F.regexp_replace("path", "\\.part\\z", "").alias("path"), F.lit(True).alias("_partial")
    )
    checked = _for_platform(manifest, platform).join(present, "path", "left").join(partial, "path", "left")
    fault = (
        F.when(F.col("length").isNull(), "missing")
        .when(F.col("length") != F.col("size_bytes"), "size")
        .when(F.col("_digest") != F.col("sha256"), "digest")
    )
    grouped = checked.withColumn("fault", fault).groupBy("component").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("length") == F.col("size_bytes")).alias("present"),
        F.coalesce(F.max("_partial"), F.lit(False)).alias("partial"),
        F.min_by(F.struct("path", "fault"), F.when(F.col("fault").isNotNull(), F.col("pos"))).alias("bad"),
    )
    state = (
        F.when((F.col("present") == 0) & ~F.col("partial"), "notInstalled")
        .when(F.col("bad").isNotNull(), "corrupt")
        .otherwise("installed")
    )
    return grouped.select(
        "component", "files", "present", state.alias("state"),
        F.col("bad.path").alias("bad_path"), F.col("bad.fault").alias("fault"),
    )


def model_sizes(manifest: DataFrame, files: DataFrame, platform: str) -> DataFrame:
    joined = _for_platform(manifest, platform).join(files.select("path", "length"), "path", "left")
    return joined.groupBy("component").agg(
        F.sum("size_bytes").alias("total_bytes"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("installed_bytes"),
    )
