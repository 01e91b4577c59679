"""Facts laid out for lookups by one key.

Rows are dealt by a hash of the key into parts, which are folders, and sorted by it inside; the
files carry a Bloom filter of the key. A lookup opens the one part that the key can be in, and in
it the row groups whose range and filter admit the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.sources.paths import subfolders

PARTS = 64


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_indexed(rows: DataFrame, path: str, key: str, parts: int = PARTS,
                  row_group_bytes: int = 32 << 20) -> None:
    """Write ``rows`` below ``path``, replacing what is there. A key that holds a large share of
    the rows is spread over several files of its part."""
    (rows.withColumn("part", _part(F.col(key), parts))
     .hint("rebalance", "part").sortWithinPartitions("part", key)
     .write.mode("overwrite").option("partitionOverwriteMode", "static")
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.block.size", str(row_group_bytes))
     .partitionBy("part").parquet(f"{path}/parts={parts}"))


def lookup(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The rows whose ``key`` is ``value``, which is not null."""
    if value is None:
        raise ValueError("a lookup needs a value")
    levels = [n for n in subfolders(spark, path) if n.startswith("parts=")]
    if len(levels) != 1:
        raise ValueError(f"no indexed rows below {path}")
    parts = int(levels[0].split("=")[1])
    rows = spark.read.parquet(f"{path}/{levels[0]}")
    wanted = F.lit(value).cast(rows.schema[key].dataType)
    return (rows.filter((F.col("part") == _part(wanted, parts)) & (F.col(key) == wanted))
            .drop("part"))
