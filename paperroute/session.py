"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle width is left to the cluster: AQE coalesces small
# partitions and splits skewed ones, so only a generous upper bound is needed there.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # of a key that a model repeats the last value counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # groups with small object state (short sets, first values) stay in the hash map longer
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for one machine: tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paperroute")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # on one machine a broadcast side is built by one thread: shuffle anything but small tables
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
    )
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepared(spark: SparkSession) -> SparkSession:
    """The session in use with the settings that the jobs rely on."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stream_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one for streams that keep state.

    State keeps the number of partitions it starts with, so it is set to the cores at hand, and
    arbitrary state needs the RocksDB store.  The caller's own settings stay as they are.
    """
    own = prepared(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return own


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used, but only when driver and tasks share one
    machine; on a cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="paperroute-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
