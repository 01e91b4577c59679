"""Where batches come from and go to: nested parquet files of the engine's own, and encoded
messages of other makers in Kafka or in files with the same two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querytrail.schemas import DNS_BATCH, ENCODED_BATCH

# Fixed value: the topic the batches travel on.
TOPIC = "dns.analytics.10min"


def kafka_read_options(servers: str, topic: str = TOPIC, **extra: str) -> dict[str, str]:
    """Start from the earliest offset; later starts resume from the query checkpoint."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic,
            "startingOffsets": "earliest", "failOnDataLoss": "true", **extra}


def read_kafka_batches(spark: SparkSession, servers: str, topic: str = TOPIC,
                       stream: bool = True, **extra: str) -> DataFrame:
    """Needs the spark-sql-kafka connector on the class path."""
    reader = spark.readStream if stream else spark.read
    return (reader.format("kafka").options(**kafka_read_options(servers, topic, **extra)).load()
            .selectExpr("cast(key as string) as key", "value"))


def kafka_writer(encoded: DataFrame, servers: str, topic: str = TOPIC, **extra: str):
    """A batch writer keyed by batch id; call ``save()`` on it."""
    return (encoded.write.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).options(**extra))


def read_batch_files(spark: SparkSession, path: str, stream: bool = False,
                     **options: str) -> DataFrame:
    """The same messages landed as parquet, as a table or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ENCODED_BATCH).options(**options).parquet(path)


def write_batch_files(encoded: DataFrame, path: str, mode: str = "append") -> None:
    encoded.write.mode(mode).parquet(path)


def read_nested_files(spark: SparkSession, path: str, stream: bool = False,
                      **options: str) -> DataFrame:
    """Batches as nested rows, as a table or as a stream of new files; no codec, no Python."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(DNS_BATCH).options(**options).parquet(path)


def write_nested_files(batches: DataFrame, path: str, mode: str = "append") -> None:
    batches.write.mode(mode).option("compression", "zstd").parquet(path)
