"""Token counts from flat token files that have no index.

A flat file is unsigned 16-bit (or 32-bit) ids and nothing else; documents end with one id that
texts never hold. Files are cut into blocks of a fixed size, wherever documents may lie. Each
block is searched for the end id at once in numpy and gives the lengths between its separators,
what comes before its first and what is left after its last. A prefix sum over the blocks then
stitches the documents that lie across them.

Defined results: a document of no tokens counts 0; tokens after the last separator of a file are
a document without an end (``ended`` false); empty files give no rows. Null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querytrail.llm.common import store
from querytrail.llm.encode import batches_of, encoder
from querytrail.llm.flatfiles import opened, writing

BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int
               ) -> tuple[DataFrame, DataFrame]:
    """Encode documents into flat files, one per task, in the order they are read.

    Returns the stored list of files (``file``, ``n_bytes``, ``id_bytes``) and the list of
    document ids by file and place, which says nothing about lengths.
    """
    from pyspark import TaskContext

    def encode(batches):
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = encoder(path, pattern, ordinary=True)
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        uri, at, size = f"{folder}/part-{part:06d}.tokens", 0, 0
        end = np.array([end_id], kind).tobytes()

        def all_batches():
            yield first
            yield from batches

        with writing(uri) as out:
            for batch in all_batches():
                ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
                for a, b in batches_of(texts):
                    for x in enc.encode(texts[a:b]):
                        size += out.write(np.frombuffer(x, "<u4").astype(kind).tobytes() + end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(ids)), pa.array(range(at, at + len(ids)), pa.int64()),
                     pa.array(ids, pa.int64()),
                     pa.array([int(kind[-1])] * len(ids), pa.int32())],
                    names=["file", "doc_no", "doc_id", "id_bytes"])
                at += len(ids)

    names = store(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "file string, doc_no long, doc_id long, id_bytes int"), "flat-names")
    return names.groupBy("file", "id_bytes").agg(F.count("*").alias("n_docs")), names


def scan_blocks(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block: ``file``, ``block``, ``n_ids``, ``n_ends``, ``head`` (ids before its first end
    or all), ``tail`` (ids after its last) and ``inner`` (lengths between ends)."""
    def sizes(batches):
        for batch in batches:
            for uri, w in zip(batch.column("file").to_pylist(),
                              batch.column("id_bytes").to_pylist(), strict=True):
                with opened(uri) as f:
                    n = -(-f.size() // block_bytes)
                for a in range(0, n, 10_000):
                    some = range(a, min(n, a + 10_000))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uri] * len(some)), pa.array([w] * len(some), pa.int32()),
                         pa.array(some, pa.int64())], names=["file", "id_bytes", "block"])

    def scan(batches):
        for batch in batches:
            rows = []
            for uri, w, block in zip(*(batch.column(c).to_pylist() for c in
                                       ("file", "id_bytes", "block")), strict=True):
                with opened(uri) as f:
                    f.seek(block * block_bytes)
                    ids = np.frombuffer(f.read(block_bytes), f"<u{w}")
                ends = np.flatnonzero(ids == end_id)
                rows.append({"file": uri, "block": block, "n_ids": len(ids),
                             "n_ends": len(ends),
                             "head": int(ends[0]) if len(ends) else len(ids),
                             "tail": len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids),
                             "inner": (np.diff(ends) - 1).tolist()})
                if len(rows) == 16:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_ids", pa.int64()),
                        ("n_ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()),
                        ("inner", pa.list_(pa.int64()))])
    # As many partitions as files: the rows are too small for Spark to see the work in them.
    n = max(1, files.count())
    cut = (files.select("file", "id_bytes").repartition(n, "file")
           .mapInArrow(sizes, "file string, id_bytes int, block long"))
    return cut.repartition(n, "file", "block").mapInArrow(
        scan, "file string, block long, n_ids long, n_ends long, head long, tail long, "
              "inner array<long>")


def stitch(blocks: DataFrame) -> DataFrame:
    """``file``, ``doc_no``, ``start`` (ids of the file before it, ends included), ``n_tokens``
    (without the end) and ``ended``, by prefix sums over the blocks of a file.

    What is still open at a block's begin is the running sum of ids less the place of the last
    end before it. Only a file's blocks, one narrow row each, meet in a window.
    """
    blocks = store(blocks, "separator-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    narrow = blocks.select("file", "block", "n_ids", "n_ends", "head", "tail")
    narrow = (narrow
              .withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
              .withColumn("docs_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
              .withColumn("end_at", F.when(F.col("n_ends") > 0,
                                           F.col("ids_before") + F.col("n_ids") - F.col("tail"))))
    last_end = F.coalesce(F.max("end_at").over(before), F.lit(0))
    narrow = narrow.withColumn("open_from", last_end)
    head = (narrow.where(F.col("n_ends") > 0)
            .select("file", F.col("docs_before").alias("doc_no"),
                    F.col("open_from").alias("start"),
                    (F.col("ids_before") + F.col("head") - F.col("open_from")).alias("n_tokens"),
                    F.lit(True).alias("ended")))
    per_file = narrow.groupBy("file").agg(
        F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("doc_no"),
        F.coalesce(F.max("end_at"), F.lit(0)).alias("start"))
    rest = (per_file.where(F.col("ids") > F.col("start"))
            .select("file", "doc_no", "start", (F.col("ids") - F.col("start")).alias("n_tokens"),
                    F.lit(False).alias("ended")))
    inner = (blocks.where(F.col("n_ends") > 1)
             .join(narrow.select("file", "block", "ids_before", "docs_before"),
                   ["file", "block"])
             .select("file", "docs_before", (F.col("ids_before") + F.col("head") + 1).alias("at"),
                     F.posexplode("inner").alias("i", "n_tokens"), "block"))
    sums = (Window.partitionBy("file", "block").orderBy("i")
            .rowsBetween(Window.unboundedPreceding, -1))
    inner = inner.select(
        "file", (F.col("docs_before") + 1 + F.col("i")).alias("doc_no"),
        (F.col("at") + F.coalesce(F.sum("n_tokens").over(sums), F.lit(0)) + F.col("i"))
        .alias("start"), "n_tokens", F.lit(True).alias("ended"))
    return head.unionByName(inner).unionByName(rest)
