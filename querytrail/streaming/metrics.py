"""Minute metrics and ten-minute batches from a stream of events.

Counters are sums, so each micro-batch adds rows of its own to a stored cube and nothing waits
for a watermark: an event counts however late it comes, and the last minutes are there at once.
Minutes, top lists and batches are read from the cube.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.functions.events import is_present
from querytrail.operators.batches import assemble_batches
from querytrail.operators.metrics import TOP_K, event_cube, sum_counters, top_domains
from querytrail.schemas import COUNTERS_LATENCY
from querytrail.sources.codec import encode_batches
from querytrail.sources.facts import commit, last_committed, up_to
from querytrail.sources.messages import write_batch_files, write_nested_files
from querytrail.sources.paths import exists, is_complete, subfolders

_KEYS = ["minute_timestamp", "resolver_id", "client_hash", "category", "domain"]
_SCHEMA = ("minute_timestamp timestamp, resolver_id string, client_hash string, "
           "category string, domain string, "
           + ", ".join(f"{c} long" for c in COUNTERS_LATENCY)
           + ", stream string, epoch long")
_ROWS = "cube"


def write_cube(events: DataFrame, path: str, checkpoint: str):
    """Stream writer of (prepared) events to the cube: one folder per micro-batch, replaced when
    the micro-batch is done again, and shown once it is committed.

    Epochs belong to the query that the checkpoint names. Events have no ledger: a query that
    starts anew, with another checkpoint, on files that an earlier one has read counts them again.
    """
    def add(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("no streaming query runs here")
        (event_cube(rows).select(*_KEYS, *COUNTERS_LATENCY)
         .write.mode("overwrite").parquet(f"{path}/{_ROWS}/stream={stream}/epoch={epoch}"))
        commit(spark, path, epoch, stream)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """The cube's committed rows, several per key where several micro-batches touched it."""
    rows = f"{path}/{_ROWS}"
    if not exists(spark, rows):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(rows).filter(up_to(last_committed(spark, path)))


def resolver_minutes(cube: DataFrame) -> DataFrame:
    return cube.groupBy("minute_timestamp").agg(*sum_counters(COUNTERS_LATENCY))


def client_minutes(cube: DataFrame) -> DataFrame:
    return cube.groupBy("minute_timestamp", "client_hash").agg(*sum_counters(COUNTERS_LATENCY))


def client_top_domains(cube: DataFrame, k: int = TOP_K) -> DataFrame:
    domains = (cube.filter(is_present(F.col("domain")))
               .groupBy("minute_timestamp", "client_hash", "domain")
               .agg(*sum_counters(["total_queries", "blocked_queries"])))
    return top_domains(domains, k)


def _newest(spark: SparkSession, path: str) -> int | None:
    """The newest complete run below the folder: one listing, and a look at the last ones."""
    for n in sorted((int(x.removeprefix("run=")) for x in subfolders(spark, path)
                     if x.startswith("run=")), reverse=True):
        if is_complete(spark, f"{path}/run={n}"):
            return n
    return None


def _taken(spark: SparkSession, path: str, run: int | None) -> dict[str, int]:
    """The newest epoch of each stream that a run and those before it have taken."""
    if run is None:
        return {}
    rows = (spark.read.parquet(f"{path}/taken/run={run}")
            .groupBy("stream").agg(F.max("last_epoch").alias("n")).collect())
    return {r["stream"]: r["n"] for r in rows}


def publish_batches(spark: SparkSession, cube_path: str, path: str, k: int = TOP_K,
                    encoded: bool = True, digits: int = 1) -> str | None:
    """Nest what the cube has received since the last call, as run N of batches: encoded
    messages, or nested rows as they are.

    What a run takes is written down before its batches, so a run that stopped is done again
    with the very same rows. Rows of ten minutes that an earlier run has sent come in a
    correction batch with an id of its own (``-rN``): merging adds them up. Top lists of a
    correction rank its own rows. Returns the folder of the run, or None if nothing is new.
    """
    n = _newest(spark, f"{path}/taken")
    if n is None or is_complete(spark, f"{path}/batches/run={n}"):
        before, n = n, 0 if n is None else n + 1
        last = last_committed(spark, cube_path)
        if last == _taken(spark, path, before):
            return None
        (spark.createDataFrame(list(last.items()), "stream string, last_epoch long")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/taken/run={n}"))
    else:
        before = n - 1 if n else None
    old, now = _taken(spark, path, before), _taken(spark, path, n)
    rows = read_cube(spark, cube_path).filter(up_to(now) & ~up_to(old)).drop("stream", "epoch")
    nested = assemble_batches(rows, k, digits)
    if n:
        nested = nested.withColumn("batch_id", F.concat("batch_id", F.lit(f"-r{n}")))
    out = f"{path}/batches/run={n}"
    if encoded:
        write_batch_files(encode_batches(nested), out, "overwrite")
    else:
        write_nested_files(nested, out, "overwrite")
    return out
