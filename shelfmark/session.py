"""Session settings and the shared folder for work files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the jobs rely on; all are safe to set on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on a URL that holds a large share of the rows are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A key that a JSON reply repeats keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Pages are wide rows: keep one Arrow batch small, in rows and in bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Stream state lives on disk: it holds every URL ever seen.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Bytes of a file that one task reads, at most. Pages compress well and are parsed at some MB a second, so larger
#: pieces leave cores idle behind the last of a few long tasks; a session that reads smaller ones keeps its own size.
SPLIT_BYTES = 32 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def build(master: str = "local[8]", app: str = "shelfmark", shuffle_partitions: int = 8,
          **extra: str) -> SparkSession:
    """A session for tests and single-node runs; clusters bring their own."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**RUNTIME, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    size = re.fullmatch(r"(\d+)([bkmgt]?)b?", spark.conf.get(_SPLIT).strip().lower())
    if size and int(size[1]) << _UNITS[size[2]] > SPLIT_BYTES:
        spark.conf.set(_SPLIT, str(SPLIT_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Cut lineage through the reliable checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def saved(df, label: str):
    """The rows through a table in the shared folder: computed once, lineage cut, size known to the planner."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
