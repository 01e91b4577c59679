"""A daily view of the resolver hours that follows a change log.

The log holds signed rows: a new row counts once, an old one is taken back. The view keeps sums
and counts only, so a change is added to the days it touches, and months without a change are
neither read nor written.

A refreshed month is a folder of its own with one file, named after the last commit it contains;
readers take the newest folder of each month. So a refresh that stops has happened or not for
each month, and a repeated one adds nothing twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querytrail.sources.paths import delete_all, exists, subfolders

_SUMS = ["total_queries", "blocked_queries", "cache_hits", "total_latency_ms"]
#: The mean of an hour as a decimal: taking back what was added leaves nothing behind.
_MEAN = "decimal(28,12)"
_LOG = ("hour_timestamp timestamp, sign int, " + ", ".join(f"{c} long" for c in _SUMS)
        + ", avg_latency_ms double, month string, commit long")
_VIEW = ("stat_date date, hourly_windows_count long, " + ", ".join(f"{c} long" for c in _SUMS)
         + ", mean_sum decimal(38,12), month string, as_of long")


def changes(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Signed rows for hours that had the values ``old`` and now have ``new``: an insert has no
    old row, a delete no new one."""
    columns = ["hour_timestamp", *_SUMS, "avg_latency_ms"]
    parts = [df.select(*columns, F.lit(sign).alias("sign"))
             for df, sign in ((old, -1), (new, 1)) if df is not None]
    return reduce(DataFrame.unionByName, parts)


def append_log(rows: DataFrame, log: str, commit: int) -> None:
    """Write the changes of one commit; writing it again replaces it. Commits rise."""
    (rows.withColumns({"month": F.date_format("hour_timestamp", "yyyy-MM"),
                       "commit": F.lit(commit).cast("long")})
     .hint("rebalance", "month")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month", "commit").parquet(log))


def _newest(spark: SparkSession, view: str) -> DataFrame:
    if not exists(spark, view):
        return spark.createDataFrame([], _VIEW)
    rows = spark.read.schema(_VIEW).parquet(view)
    last = F.max("as_of").over(Window.partitionBy("month"))
    return rows.withColumn("last", last).filter(F.col("as_of") == F.col("last")).drop("last")


def pending(spark: SparkSession, log: str, view: str) -> tuple[int, dict[str, int]]:
    """The newest commit of the log, and the months it has changes for that the view lacks, each
    with the last commit that the view contains (-1: none). A number per month."""
    commits = spark.read.schema(_LOG).parquet(log).select("month", "commit").distinct()
    done = _newest(spark, view).groupBy("month").agg(F.max("as_of").alias("as_of"))
    months = (commits.join(done, "month", "left")
              .groupBy("month").agg(F.max("commit").alias("commit"),
                                    F.coalesce(F.max("as_of"), F.lit(-1)).alias("as_of"))
              .collect())
    return (max((r["commit"] for r in months), default=-1),
            {r["month"]: r["as_of"] for r in months if r["commit"] > r["as_of"]})


def refreshed(spark: SparkSession, log: str, view: str, commit: int, months: dict[str, int]
              ) -> DataFrame:
    """The rows of the touched months after all commits up to the given one."""
    def fresh() -> Column:
        same = {done: [m for m in months if months[m] == done] for done in months.values()}
        return reduce(Column.__or__, [F.col("month").isin(sorted(ms)) & (F.col("commit") > done)
                                      for done, ms in same.items()])

    touched = F.col("month").isin(sorted(months))
    signed = (spark.read.schema(_LOG).parquet(log)
              .filter(touched & fresh() & (F.col("commit") <= commit))
              .select("month", F.to_date("hour_timestamp").alias("stat_date"),
                      F.col("sign").cast("long").alias("hourly_windows_count"),
                      *[(F.col("sign") * F.col(c)).alias(c) for c in _SUMS],
                      (F.col("sign") * F.col("avg_latency_ms").cast(_MEAN)).cast("decimal(38,12)")
                      .alias("mean_sum")))
    sums = ["hourly_windows_count", *_SUMS, "mean_sum"]
    held = _newest(spark, view).filter(touched).select(*signed.columns)
    # A day that has lost all its hours stays as a row of zeros, hidden from readers.
    return (held.unionByName(signed).groupBy("month", "stat_date")
            .agg(*[F.sum(c).alias(c) for c in sums])
            .withColumn("mean_sum", F.col("mean_sum").cast("decimal(38,12)"))
            .withColumn("as_of", F.lit(commit).cast("long")))


def refresh(spark: SparkSession, log: str, view: str) -> list[str]:
    """Bring the view up to the newest commit of the log; returns the months that were touched."""
    commit, months = pending(spark, log, view)
    if not months:
        return []
    (refreshed(spark, log, view, commit, months).repartition("month")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month", "as_of").parquet(view))
    old = [f"{view}/month={m}/{n}" for m in months for n in subfolders(spark, f"{view}/month={m}")
           if n.startswith("as_of=") and int(n.split("=")[1]) < commit]
    delete_all(spark, old)
    return sorted(months)


def read_daily(spark: SparkSession, view: str) -> DataFrame:
    """The view with the columns of ``rollups.mv_resolver_daily``."""
    rows = _newest(spark, view).filter(F.col("hourly_windows_count") > 0)
    total = F.col("total_queries")
    return rows.select(
        F.col("stat_date").cast("timestamp").alias("stat_date"), "hourly_windows_count",
        *_SUMS[:3],
        (F.col("mean_sum").cast("double") / F.col("hourly_windows_count")).alias("avg_latency_ms"),
        F.when(total > 0, F.col("total_latency_ms") / total).otherwise(F.lit(0.0))
        .alias("weighted_avg_latency_ms"))
