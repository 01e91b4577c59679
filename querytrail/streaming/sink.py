"""Merging batch messages into the hourly tables, exactly once."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querytrail.operators import batches as nest
from querytrail.operators import metrics
from querytrail.operators.merge import merge_aggs
from querytrail.schemas import COUNTERS_LATENCY, DNS_BATCH, FACT_KEYS
from querytrail.sources.codec import bad_batches, decode_batches, good_batches
from querytrail.sources.facts import (COMMITS, LEDGER, MAIN, commit, last_committed, side_by_side,
                                      up_to, write_delta)
from querytrail.sources.paths import exists, make_folder

_DEAD = "dead_letters"
_ONCE = "batches_once"


def _batch_day():
    return F.to_date(F.timestamp_seconds("window_start_timestamp"))


def is_applied(spark: SparkSession, root: str, epoch: int, stream: str = MAIN) -> bool:
    return epoch <= last_committed(spark, root).get(stream, -1)


def unseen_batches(batches: DataFrame, root: str) -> DataFrame:
    """Batches whose id is not in a committed epoch of the ledger, each once.

    Looks at the batches twice, so they should be persisted. The ledger is stored by day and
    only the days present are read: a redelivered batch has its old day.
    """
    spark = batches.sparkSession
    facts = batches.agg(F.count("batch_id").alias("rows"),
                        F.count_distinct("batch_id").alias("ids"),
                        F.min(_batch_day()).alias("lo"), F.max(_batch_day()).alias("hi")).first()
    once = batches if facts["rows"] == facts["ids"] else batches.dropDuplicates(["batch_id"])
    path = f"{root}/{LEDGER}"
    if facts["rows"] == 0 or not exists(spark, path):
        return once
    days = [F.lit(facts[d]).cast("date") for d in ("lo", "hi")]
    day = F.col("batch_day")
    seen = (spark.read.schema("batch_id string, batch_day date, stream string, epoch long")
            .parquet(path)
            .filter((day.between(*days) | day.isNull()) & up_to(last_committed(spark, root)))
            .select("batch_id"))
    return once.join(seen, "batch_id", "left_anti")


def hourly_deltas(batches: DataFrame) -> dict[str, DataFrame]:
    """Hour sums of some batches, one frame per hourly table."""
    hour = F.date_trunc("hour", F.col("minute_timestamp")).alias("hour_timestamp")
    domains = (nest.flatten_domains(batches)
               .withColumn("rank_at", F.col("minute_timestamp"))
               .withColumn("rank_batch", F.col("batch_id"))
               .select(hour, "client_hash", "domain", "total_queries", "blocked_queries",
                       "domain_rank", "rank_at", "rank_batch"))
    keys = FACT_KEYS["client_top_domains_hourly"]
    return {
        "resolver_hourly_stats": nest.flatten_resolvers(batches).groupBy(hour)
        .agg(*metrics.sum_counters(COUNTERS_LATENCY)),
        "client_hourly_stats": metrics.hourly_client(nest.flatten_clients(batches)),
        "client_category_hourly":
            metrics.hourly_client_category(nest.flatten_categories(batches)),
        "client_top_domains_hourly": domains.groupBy(*keys)
        .agg(*merge_aggs(domains.columns, keys)),
    }


def _write_by_day(batches: DataFrame, path: str, epoch: int, stream: str) -> None:
    (batches.withColumns({"stream": F.lit(stream), "epoch": F.lit(epoch).cast("long")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_day", "stream", "epoch").parquet(path))


def _merge_hourly(fresh: DataFrame, epoch: int, root: str, stream: str) -> None:
    side_by_side(fresh.sparkSession, [partial(write_delta, delta, root, table, epoch, stream)
                                      for table, delta in hourly_deltas(fresh).items()])


def _keep_nested(fresh: DataFrame, epoch: int, root: str, stream: str) -> None:
    _write_by_day(fresh.withColumn("batch_day", _batch_day()), f"{root}/{_ONCE}", epoch, stream)


def _apply(batches: DataFrame, epoch: int, root: str, stream: str,
           take: Callable[[DataFrame, int, str, str], None] = _merge_hourly) -> None:
    # From here on readers trust the commits, so a first epoch is not seen half-written.
    spark = batches.sparkSession
    make_folder(spark, f"{root}/{COMMITS}")
    # Each table and the ledger are written from it.
    fresh = unseen_batches(batches, root).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # The ledger goes first: its write fills in what the tables share.
        _write_by_day(fresh.select("batch_id", _batch_day().alias("batch_day")),
                      f"{root}/{LEDGER}", epoch, stream)
        take(fresh, epoch, root, stream)
    finally:
        fresh.unpersist()
    commit(spark, root, epoch, stream)


def apply_batches(batches: DataFrame, epoch: int, root: str, stream: str = MAIN) -> None:
    """Merge one micro-batch of decoded batches.

    The commit is written last: an interrupted epoch is redone in full and replaces what it had
    written, a committed one is skipped. Epochs count within ``stream`` and must come one after
    the other, as a streaming query delivers them; whatever the stream, a batch id in the ledger
    is not merged again. Batches may be late by any amount.
    """
    if is_applied(batches.sparkSession, root, epoch, stream):
        return
    held = batches.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _apply(held, epoch, root, stream)
    finally:
        held.unpersist()


def _no_id():
    return F.trim(F.coalesce(F.col("batch_id"), F.lit(""))) == ""


def _nested_or_error(batches: DataFrame) -> DataFrame:
    """Nested rows in the form of decoded messages: those without a batch id are errors."""
    no_id = _no_id()
    whole = F.struct(*DNS_BATCH.names)
    return batches.select(
        F.col("batch_id").alias("key"),
        F.when(no_id, F.encode(F.to_json(whole), "UTF-8")).alias("value"),
        F.when(no_id, F.lit("no batch id")).alias("error"),
        F.when(~no_id, whole).alias("batch"))


def _set_aside(decoded: DataFrame, epoch: int, root: str, stream: str) -> None:
    bad = bad_batches(decoded)
    # A count reads all parts at once and so fills in what is persisted; isEmpty goes part by part.
    if bad.count():
        bad.write.mode("overwrite").parquet(f"{root}/{_DEAD}/stream={stream}/epoch={epoch}")


def merge_nested(batches: DataFrame, root: str, checkpoint: str):
    """Stream writer from nested batches to the hourly tables, without the codec."""
    return _merge_stream(batches, root, checkpoint, _nested_or_error)


def merge_encoded(messages: DataFrame, root: str, checkpoint: str):
    """Stream writer from encoded messages to the hourly tables.

    What cannot be decoded goes to the dead letters, like what has no batch id.
    """
    return _merge_stream(messages, root, checkpoint, decode_batches)


def keep_once(batches: DataFrame, root: str, checkpoint: str):
    """Stream writer that stores nested batches, each batch id once, for ``read_once``.

    The ledger of the root says what is a repeat, so a batch may be late by any amount and
    nothing is kept in memory; batches without an id go to the dead letters. The root is one of
    its own: what its ledger holds is not merged into hourly tables.
    """
    return _merge_stream(batches, root, checkpoint, _nested_or_error, _keep_nested)


def read_once(spark: SparkSession, root: str) -> DataFrame:
    """The batches that ``keep_once`` has committed."""
    path = f"{root}/{_ONCE}"
    if not exists(spark, path):
        return spark.createDataFrame([], DNS_BATCH)
    stored = "batch_day date, stream string, epoch long"
    rows = spark.read.schema(T.StructType([*DNS_BATCH, *T.StructType.fromDDL(stored)]))
    return rows.parquet(path).filter(up_to(last_committed(spark, root))).select(*DNS_BATCH.names)


def _merge_stream(messages: DataFrame, root: str, checkpoint: str,
                  decode: Callable[[DataFrame], DataFrame],
                  take: Callable[[DataFrame, int, str, str], None] = _merge_hourly):
    """Epochs belong to the query that its checkpoint names: with a new checkpoint they count
    anew, and the ledger of batch ids alone says what is a repeat. Dead letters go to a folder
    and stop nothing.
    """
    def merge(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("no streaming query runs here")
        if is_applied(spark, root, epoch, stream):
            return
        decoded = decode(rows).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _set_aside(decoded, epoch, root, stream)
            _apply(good_batches(decoded), epoch, root, stream, take)
        finally:
            decoded.unpersist()

    return (messages.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint))


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    schema = "key string, value binary, error string, stream string, epoch long"
    path = f"{root}/{_DEAD}"
    return (spark.read.schema(schema).parquet(path) if exists(spark, path)
            else spark.createDataFrame([], schema))


def dedup_stream(batches: DataFrame) -> DataFrame:
    """Drop redelivered batches inside the stream, by batch id alone and at any age.

    There is no watermark, so no batch is too late; the state holds every id that has come. Where
    that grows too large use ``keep_once``. Batches without an id are no repeats of each other
    and all pass: sinks set them aside.
    """
    return (batches.filter(~_no_id()).dropDuplicates(["batch_id"])
            .unionByName(batches.filter(_no_id())))
