"""Session construction and the runtime settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# Settings every operator is written for.  AQE splits hot join partitions, even
# where the split costs one more exchange, and coalesces small ones.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch is several times its size as Python objects, in each worker of an executor.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "lectern", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores one partition per core.

    A large input already has more partitions than cores and is returned as it is, so no
    shuffle is added there; a small file no longer leaves all cores but one idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
