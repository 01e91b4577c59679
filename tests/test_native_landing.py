"""Nested batches landed as parquet: merged as encoded ones are, bad ones set aside."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_pipeline import cube, events, nested, tables_of  # noqa: F401

from querytrail.schemas import DNS_BATCH
from querytrail.sources import messages
from querytrail.streaming import sink


def test_nested_batches_merge_and_blank_ids_are_set_aside(spark, nested, tmp_path):  # noqa: F811
    want, got, landed = (str(tmp_path / x) for x in ("want", "got", "landed"))
    sink.apply_batches(nested, 0, want)
    blank = nested.limit(1).withColumn("batch_id", F.lit(" "))
    none = nested.limit(1).withColumn("batch_id", F.lit(None).cast("string"))
    for rows in (nested, blank.unionByName(none), nested):
        messages.write_nested_files(rows, landed)
        stream = messages.read_nested_files(spark, landed, stream=True)
        (sink.merge_nested(stream, got, str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start().awaitTermination())
    assert tables_of(spark, got) == tables_of(spark, want)
    bad = sink.read_dead_letters(spark, got)
    assert bad.count() == 2
    # The row as it came can be read back.
    back = bad.select(F.from_json(F.col("value").cast("string"), DNS_BATCH).alias("b")).select("b.minutes")
    first = nested.limit(1).select("minutes").first()
    assert [r["minutes"] for r in back.collect()] == [first["minutes"]] * 2
