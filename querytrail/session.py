"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# State that holds several columns and timers, beyond the heap, with changes written per
# micro-batch instead of snapshots.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Settings the library is tuned for. On a cluster pass the size-dependent ones
# (shuffle partitions, memory) through spark-submit; these are plain defaults.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Encoded batches are large rows: keep Arrow transfers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    **STATE_STORE,
}


def build_session(app_name: str = "querytrail", master: str | None = None,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def use_state_store(spark: SparkSession) -> None:
    """Give the session a state store that operators with timers can use, in place of Spark's
    default, which cannot. A streaming query takes it when it first starts and keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name).endswith(".HDFSBackedStateStoreProvider"):
        for key, value in STATE_STORE.items():
            spark.conf.set(key, value)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started.

    The message codec runs in them. Once per application; ``--py-files`` does as well.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="querytrail-"), "querytrail"), "zip", root,
            "querytrail")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


_local_scratch: str | None = None


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    A machine-local folder is used only in local mode, where there is one machine.
    """
    global _local_scratch
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="querytrail-")
        base = _local_scratch
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
