"""Policy decisions on a stream, with rules re-read when a newer version is published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.operators.matching import decide, policy_table
from querytrail.sources.lists import latest_rule_version, read_rule_snapshot
from querytrail.sources.paths import exists, is_complete

_CHOSEN = "version long"


def _version_of(spark: SparkSession, rules_root: str, note: str) -> int:
    """The version that decides an epoch: written down first, so that a repeat takes it again."""
    if is_complete(spark, note):
        return spark.read.schema(_CHOSEN).parquet(note).first()["version"]
    version = latest_rule_version(spark, rules_root)
    if version is None:
        raise ValueError(f"no rule snapshot below {rules_root}")
    (spark.createDataFrame([(version,)], _CHOSEN).coalesce(1)
     .write.mode("overwrite").parquet(note))
    return version


def _policy_of(spark: SparkSession, rules_root: str, version: int, path: str) -> DataFrame:
    """The policy table of a version, worked out once per stream."""
    if not is_complete(spark, path):
        policy_table(*read_rule_snapshot(spark, rules_root, version)).write.mode(
            "overwrite").parquet(path)
    return spark.read.parquet(path)


def write_decisions(events: DataFrame, rules_root: str, path: str, checkpoint: str):
    """Each micro-batch is matched against the newest complete rule snapshot.

    Decisions go to ``decisions/stream=S/epoch=N`` below ``path``: epochs count within the query
    that the checkpoint names, so a query with a new checkpoint writes beside the old one and a
    micro-batch that is done again replaces its own rows. The version of its first attempt is
    kept below ``versions`` and in each row as ``rule_version``, so that a repeat decides alike.
    """
    def write(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("no streaming query runs here")
        part = f"stream={stream}/epoch={epoch}"
        version = _version_of(spark, rules_root, f"{path}/versions/{part}")
        table = _policy_of(spark, rules_root, version,
                           f"{path}/policy/stream={stream}/version={version}")
        # A micro-batch is matched by joins of its rows alone, read once.
        (decide(rows, table, way="lookup")
         .withColumn("rule_version", F.lit(version).cast("long"))
         .write.mode("overwrite").parquet(f"{path}/decisions/{part}"))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions so far, with ``rule_version``, of every stream."""
    base = f"{path}/decisions"
    if not exists(spark, base):
        raise ValueError(f"no decisions below {path}")
    return spark.read.parquet(base).drop("stream", "epoch")
