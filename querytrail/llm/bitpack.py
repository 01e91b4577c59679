"""Token ids in files of fixed-width bits.

Each id takes the least whole number of bits that holds the vocabulary, lowest bit first. A file
is packed blocks of ``BLOCK`` ids, then the document ids, document starts and block offsets as
64-bit integers, then a trailer with their counts. Any id, block or document is found from the
trailer without reading the rest, and a block unpacks in numpy at once.

Documents are sorted by range of id, so that one task writes one file and file order is id order.
Files get their name when whole: a task that runs again writes the same file.

Defined results: null texts are empty and hold the end id alone; a null doc_id sorts first and
comes back null; ties in doc_id are ordered by text; an empty table writes no file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytrail.llm.common import running_start, store
from querytrail.llm.encode import batches_of, encoder
from querytrail.llm.flatfiles import opened, writing

MAGIC = b"BITPACK1"
BLOCK = 1 << 16
TRAILER = struct.Struct("<8sIIQQQ")  # magic, width, block ids, documents, ids, blocks
END_ID = 0
NO_ID = -(1 << 63)


def width_for(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, lowest bit first, padded to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width)
    weights = np.left_shift(np.uint64(1), np.arange(width, dtype=np.uint64))
    return (bits.reshape(n, width) @ weights).astype("<u4")


class Writer:
    """Streams ids into one file: a block and the index are held, not the ids."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.held, self.n_held, self.n_ids, self.at = [], 0, 0, 0
        self.doc_ids, self.starts, self.offsets = [], [0], []

    def _flush(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        got = np.frombuffer(ids, "<u4")
        self.n_ids += len(got)
        self.starts.append(self.n_ids)
        self.held.append(got)
        self.n_held += len(got)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._flush(ids[at:at + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        self.offsets.append(self.at)
        for x in (self.doc_ids, self.starts, self.offsets):
            self.out.write(np.array(x, "<i8").tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.width, self.block, len(self.doc_ids),
                                    self.n_ids, len(self.offsets) - 1))


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - TRAILER.size)
        magic, self.width, self.block, self.n_docs, self.n_ids, n_blocks = TRAILER.unpack(
            file.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        counts = [self.n_docs, self.n_docs + 1, n_blocks + 1]
        file.seek(size - TRAILER.size - 8 * sum(counts))
        index = np.frombuffer(file.read(8 * sum(counts)), "<i8")
        self.doc_ids, self.starts, self.offsets = np.split(index, np.cumsum(counts)[:-1])
        self._last = (-1, None)

    def block_ids(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            self.file.seek(int(self.offsets[k]))
            data = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
            n = min(self.block, self.n_ids - k * self.block)
            self._last = (k, unpack(data, self.width, n))
        return self._last[1]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number ``first`` up to ``last``, from the blocks that hold them."""
        parts = [self.block_ids(k)[max(0, first - k * self.block):last - k * self.block]
                 for k in range(first // self.block, -(-last // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, folder: str, path: str, pattern: str, end_id: int = END_ID
          ) -> DataFrame:
    """Encode and write all documents in order of doc_id; a stored list of the files:
    ``part``, ``file``, ``n_docs``, ``n_ids``."""
    from pyspark import TaskContext

    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        enc = encoder(path, pattern)
        uri = f"{folder}/part-{part:06d}.bits"

        def all_batches():
            yield first
            yield from batches

        with writing(uri) as out:
            w = Writer(out, width_for(max(enc.size, end_id + 1)))
            for batch in all_batches():
                ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
                for a, b in batches_of(texts):
                    for doc_id, x in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                        w.add(doc_id, x + end)
            w.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(w.doc_ids)], pa.int64()),
             pa.array([w.n_ids], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = (docs.select(F.col("doc_id").cast("long"), "text")
            .repartitionByRange(order[0], F.xxhash64("text")).sortWithinPartitions(*order))
    return store(rows.mapInArrow(encode, "part int, file string, n_docs long, n_ids long"),
                 "bitpack-files")


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start`` (ids of all earlier documents),
    ``n_tokens`` and the crc32 of its ids as unsigned 32-bit integers."""
    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(),
                                 batch.column("base").to_pylist(), strict=True):
                with opened(uri) as file:
                    r = Reader(file)
                    for at in range(0, r.n_docs, 10_000):
                        some = range(at, min(at + 10_000, r.n_docs))
                        crc = [zlib.crc32(r.document(k).tobytes()) for k in some]
                        ids, starts = r.doc_ids[some.start:some.stop], r.starts[some.start:]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([None if i == NO_ID else int(i) for i in ids], pa.int64()),
                             pa.array(starts[:len(some)] + base),
                             pa.array(np.diff(starts[:len(some) + 1])),
                             pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = running_start(files, "part", "n_ids", "base").select("file", "base")
    # As many partitions as files: the rows are too small for Spark to see the work in them.
    return placed.repartition(max(1, files.count()), "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")
