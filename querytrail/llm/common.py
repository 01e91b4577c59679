"""Pieces that several operators share: word columns, stored steps, numbering in order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.session import scratch_dir, ship_package

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
# Long texts: Arrow batches stay near this size, whatever the rows are like.
ARROW_ROWS, ARROW_BYTES = "2000", str(16 << 20)


def prepare(spark: SparkSession) -> None:
    """What each query sets: UTC, small Arrow batches, the package on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of other characters than blank and \\x09-\\x0D; none for null and empty texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends here."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` stored in ``order`` with ``number`` counting from 0 over all rows.

    Each range of rows counts its own; only one row per range is added up to place them.
    """
    in_part = (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("part_", F.spark_partition_id())
               .withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    stored = store(in_part, name)
    starts = running_start(stored.groupBy("part_").agg(F.count("*").alias("rows_")),
                           "part_", "rows_", "first_")
    return (stored.join(starts.select("part_", "first_"), "part_")
            .withColumn("number", F.col("first_") + F.col("at_"))
            .drop("part_", "at_", "first_"))


def placed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``place_``, a hash of each row's place in the files it is read from: rows alike
    in all columns differ in it, and it is the same however often the files are read. A frame
    that is not read from files is stored."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = store(df, name)
    # The file's own name: the same files may be reached by several paths.
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.select("*", F.xxhash64(file, F.col("_metadata.row_index")).alias("place_"))


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``position``, the number of each row in the order in which the rows were
    written: by task, then by row of the file. A frame that is not read from files is stored."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = store(df, name)
    path, at = F.col("_metadata.file_path").alias("path_"), F.col("_metadata.row_index").alias("at_")
    task = F.regexp_extract("path_", r"part-(\d+)[^/]*$", 1).try_cast("long")
    # Rows that were filtered out leave gaps, never two rows with one number.
    files = (df.select(path, at).groupBy("path_").agg((F.max("at_") + 1).alias("rows_"))
             .withColumn("file_", F.struct(task, F.col("path_"))))
    starts = running_start(files, "file_", "rows_", "first_").select("path_", "first_")
    return (df.select("*", path, at).join(starts, "path_")
            .withColumn("position", F.col("first_") + F.col("at_"))
            .drop("path_", "at_", "first_"))


def running_start(parts: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """The sum of ``amount`` over all earlier rows; for tables of one row per task or file."""
    from pyspark.sql import Window

    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))
