"""Fact tables as parquet below one root folder.

Facts are additive, so an arriving micro-batch is written as rows of its own under
``<table>/month=yyyy-MM/stream=S/epoch=N`` and rows of one key are added up on reading. A write
costs what the delta costs, whatever the size of the table, and writing an epoch again replaces
it. Epochs count per stream: a query with a new checkpoint is a new stream. A compaction puts the
rows of many epochs into one, of a stream of its own. Day and month tables get one epoch per
rollover, which is about a month, and no other level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytrail.operators.merge import merge_rows
from querytrail.schemas import COUNTERS, COUNTERS_LATENCY, FACT_KEYS
from querytrail.sources.paths import (delete, delete_all, delete_if_empty, exists, is_complete,
                                      subfolders)

LEDGER = "batch_ledger"
COMMITS = "batch_commits"
ROLLOVER_LOG = "rollover_log"
COMPACTION_LOG = "compaction_log"
#: The stream of batches that are merged without a streaming query.
MAIN = "main"
#: The stream whose epochs are compactions: epoch N is committed by log entry N.
COMPACTED = "compacted"
COMPACTION_ENTRY = "stream string, last_epoch long, months array<string>, days array<string>"
_KEY_TYPES = {"hour_timestamp": T.TimestampType(), "date_timestamp": T.DateType()}
_PAIR = ["total_queries", "blocked_queries"]
_VALUES = {"client_category_hourly": _PAIR, "client_top_domains_hourly": _PAIR}


def partitions(table: str) -> list[str]:
    return ["month", "stream", "epoch"] if FACT_KEYS[table][0] == "hour_timestamp" else ["epoch"]


def stored_schema(table: str) -> T.StructType:
    """Columns of a table on disk, partition columns included."""
    fields = [T.StructField(k, _KEY_TYPES.get(k, T.StringType())) for k in FACT_KEYS[table]]
    values = _VALUES.get(table)
    if values is None:
        values = COUNTERS_LATENCY if table.startswith("resolver") else COUNTERS
    fields += [T.StructField(v, T.LongType()) for v in values]
    if table == "client_top_domains_hourly":
        fields += [T.StructField("domain_rank", T.IntegerType()),
                   T.StructField("rank_at", T.TimestampType()),
                   T.StructField("rank_batch", T.StringType())]
    if "month" in partitions(table):
        fields += [T.StructField("month", T.StringType()), T.StructField("stream", T.StringType())]
    return T.StructType([*fields, T.StructField("epoch", T.LongType())])


def write_delta(rows: DataFrame, root: str, table: str, epoch: int, stream: str = MAIN) -> None:
    """Write one epoch of a table, replacing what an earlier attempt left of it.

    Rebalancing by month keeps the file count down where months are small and splits a large
    one over tasks; sorting by the natural key lets row groups be skipped by hour and client.
    """
    levels = partitions(table)
    out = rows.select(*[c for c in stored_schema(table).names if c not in levels])
    if "month" in levels:
        out = out.withColumn("month", F.date_format("hour_timestamp", "yyyy-MM"))
    spread = "month" if "month" in levels else FACT_KEYS[table][-1]
    if "stream" in levels:
        out = out.withColumn("stream", F.lit(stream))
    (out.withColumn("epoch", F.lit(epoch).cast("long"))
     .hint("rebalance", spread)
     .sortWithinPartitions(*levels, *FACT_KEYS[table])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*levels).parquet(f"{root}/{table}"))


@contextmanager
def _smaller_parts(spark: SparkSession) -> Iterator[None]:
    """Let a rebalance split a month into parts of 8 MB, not 64: one task would sort and write
    what many have summed."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(name)
    spark.conf.set(name, "8m")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def side_by_side(spark: SparkSession, writes: list[Callable[[], None]]) -> None:
    """Run the writes of several tables at a time, so that the last tasks of one leave no cores
    idle. Rows that they share should be persisted and filled in before."""
    with _smaller_parts(spark), ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(write)) for write in writes]:
            done.result()


def commit(spark: SparkSession, root: str, epoch: int, stream: str = MAIN) -> None:
    """Make all epochs of the stream up to this one visible. One marker per stream is kept."""
    base = f"{root}/{COMMITS}/stream={stream}"
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{base}/epoch={epoch}")
    for name in subfolders(spark, base):
        if int(name.split("=")[1]) < epoch:
            delete(spark, f"{base}/{name}")


def last_committed(spark: SparkSession, root: str) -> dict[str, int]:
    """The newest committed epoch of each stream; all before it are committed, too."""
    out = {}
    for name in subfolders(spark, f"{root}/{COMMITS}"):
        base = f"{root}/{COMMITS}/{name}"
        done = [int(e.split("=")[1]) for e in subfolders(spark, base)
                if is_complete(spark, f"{base}/{e}")]
        if done:
            out[name.split("=", 1)[1]] = max(done)
    compactions = finished_compactions(spark, root)
    if compactions:
        out[COMPACTED] = compactions[-1]
    return out


def up_to(epochs: dict[str, int]) -> Column:
    """Rows of epochs not newer than the given one of their stream."""
    return reduce(lambda a, b: a | b, [
        (F.col("stream") == stream) & (F.col("epoch") <= epoch)
        for stream, epoch in epochs.items()], F.lit(False))


def _finished(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in subfolders(spark, path)
                  if n.startswith("run=") and is_complete(spark, f"{path}/{n}"))


def finished_rollovers(spark: SparkSession, root: str) -> list[int]:
    """Numbers (yyyyMM) of the rollovers whose log entry is complete, oldest first."""
    return _finished(spark, f"{root}/{ROLLOVER_LOG}")


def finished_compactions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the compactions whose log entry is complete, oldest first."""
    return _finished(spark, f"{root}/{COMPACTION_LOG}")


def compaction_entry(spark: SparkSession, root: str, run: int
                     ) -> tuple[dict[str, int], list[str], list[str]]:
    """What a compaction has taken: the newest epoch of each stream, of which months and days."""
    rows = (spark.read.schema(COMPACTION_ENTRY)
            .parquet(f"{root}/{COMPACTION_LOG}/run={run}").collect())
    return ({r["stream"]: r["last_epoch"] for r in rows},
            rows[0]["months"] if rows else [], rows[0]["days"] if rows else [])


def compacted_rows(spark: SparkSession, root: str) -> Column:
    """Rows that are also in a finished compaction, removed yet or not."""
    out = F.lit(False)
    for run in finished_compactions(spark, root):
        taken, months, _ = compaction_entry(spark, root, run)
        out = out | (F.col("month").isin(months) & up_to(taken))
    return out


def drop_epochs(spark: SparkSession, folder: str, taken: dict[str, int]) -> None:
    """Remove the epochs of a month or day up to the given one of their stream.

    A stream's folder goes only if nothing is left in it, since its query may be writing there.
    """
    gone = []
    for stream, last in taken.items():
        base = f"{folder}/stream={stream}"
        gone += [f"{base}/{e}" for e in subfolders(spark, base)
                 if e.startswith("epoch=") and int(e.split("=")[1]) <= last]
    delete_all(spark, gone)
    for stream in taken:
        delete_if_empty(spark, f"{folder}/stream={stream}")
    delete_if_empty(spark, folder)


def rolled_epochs(spark: SparkSession, root: str, run: int) -> dict[str, int]:
    """What a rollover has read: the newest epoch of each stream."""
    rows = spark.read.parquet(f"{root}/{ROLLOVER_LOG}/run={run}").collect()
    return {r["stream"]: r["last_epoch"] for r in rows}


def read_deltas(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Stored rows as they are, several per key where several epochs touched it.

    Of hourly tables only committed epochs are shown, so all four tables agree while a
    micro-batch is being merged, and no hours that a finished rollover or compaction has taken,
    removed yet or not. Of day and month tables only finished rollovers are shown. Tables filled without a
    ledger or a rollover are shown whole.
    """
    schema, path = stored_schema(table), f"{root}/{table}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    runs = finished_rollovers(spark, root)
    if "month" not in partitions(table):
        if exists(spark, f"{root}/{ROLLOVER_LOG}"):
            rows = rows.filter(F.col("epoch").isin(runs))
        return rows
    if exists(spark, f"{root}/{COMMITS}"):
        rows = rows.filter(up_to(last_committed(spark, root))
                           & ~compacted_rows(spark, root))
    if runs:
        month = f"{runs[-1] // 100:04d}-{runs[-1] % 100:02d}"
        rows = rows.filter((F.col("month") >= month)
                           | ~up_to(rolled_epochs(spark, root, runs[-1])))
    return rows


def read_facts(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table: one row per natural key.

    ``month`` stays a grouping column, so filters on it and on the keys reach the scan.
    """
    keys = FACT_KEYS[table]
    by = [*keys, "month"] if "month" in partitions(table) else keys
    merged = merge_rows(read_deltas(spark, root, table).drop("stream", "epoch"), by)
    if table.startswith("resolver"):
        total = F.col("total_queries")
        merged = merged.withColumn(
            "avg_latency_ms",
            F.when(total > 0, F.col("total_latency_ms") / total).otherwise(F.lit(0.0)))
    return merged.drop("rank_at", "rank_batch")
