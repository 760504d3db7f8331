"""Token ids as Arrow files of equal-length sequences with masks.

Documents are range-partitioned by doc_id and encoded in that order; the ids of all documents form one stream. Each
partition writes two Arrow IPC files to a folder that all executors share:

* part-N.tokens.arrow: record batches of BATCH sequences: `ids`, a fixed-size list of `length` unsigned integers
  (16 bits where the vocabulary allows, else 32), and `mask`, a fixed-size list of booleans, false where the last
  sequence is padded. Buffers are not compressed: sequence i lies at a fixed place of a mapped file.
* part-N.docs.arrow: doc_id, first id in the part's stream, number of ids.

The Parquet table `manifest` holds part, documents, ids and the ids before the part, so that readers find any place
without listing the folder. A file is written under a name of its own and then moved, so a repeated task replaces it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulefold.llm.tokens import Encoder

LENGTH = 2_048
BATCH = 64


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Part:
    """One part being written: sequences go out batch by batch."""

    def __init__(self, path: str, number: int, length: int, dtype: np.dtype) -> None:
        self.store, self.folder = _folder(path)
        self.store.create_dir(self.folder, recursive=True)
        self.name, self.length, self.dtype = f"{self.folder}/part-{number:07d}", length, np.dtype(dtype)
        self.temporary = f"{self.folder}/.writing-{number:07d}-{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = self.store.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.stream, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        step = BATCH * self.length
        if self.held >= step:
            joined = np.concatenate(self.rest)
            whole = len(joined) // step * step
            for low in range(0, whole, step):
                self._write(joined[low : low + step], step)
            self.rest, self.held = [joined[whole:]], len(joined) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        columns = []
        for values in (pa.array(ids), pa.array(np.arange(len(ids)) < n)):
            columns.append(pa.FixedSizeListArray.from_arrays(values, self.length))
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self, docs: pa.Table) -> None:
        last = np.concatenate(self.rest) if self.rest else np.zeros(0, self.dtype)
        if len(last):
            padded = np.zeros(-(-len(last) // self.length) * self.length, self.dtype)
            padded[: len(last)] = last
            self._write(padded, len(last))
        self.writer.close()
        self.stream.close()
        self._move(self.temporary, f"{self.name}.tokens.arrow")
        with self.store.open_output_stream(self.temporary) as out, pa.ipc.new_file(out, docs.schema) as writer:
            writer.write_table(docs)
        self._move(self.temporary, f"{self.name}.docs.arrow")

    def _move(self, source: str, target: str) -> None:
        if self.store.get_file_info(target).type != fs.FileType.NotFound:
            self.store.delete_file(target)
        self.store.move(source, target)


def write(docs: DataFrame, path: str, vocabulary: str, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Encode docs, write the files below path, and return the manifest.

    vocabulary is the path of a tokenizers JSON file that the driver reads; its content is broadcast (a few MB). A null
    or empty text holds only the end id 0. Null keys come first; rows of equal keys keep the order of their texts.
    Other columns are left out. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder, part, number = Encoder.of(shared.value), None, TaskContext.get().partitionId()
        keys, sizes = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = part or _Part(path, number, length, encoder.dtype)
            keys.append(batch.column(0))
            for ids, offsets in encoder.slices(batch.column(1)):
                part.add(ids)
                sizes.append(np.diff(offsets))
        if part:
            n = np.concatenate(sizes)
            columns = [pa.chunked_array(keys), pa.array(np.cumsum(n) - n), pa.array(n)]
            part.close(pa.table(columns, names=["doc_id", "start", "n_tokens"]))
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([part.total], pa.int64())], names=["part", "docs", "ids"])

    made = dealt.mapInArrow(run, "part int, docs bigint, ids bigint")
    made.write.parquet(f"{path}/parts")  # the side effect happens in this one job
    parts = spark.read.parquet(f"{path}/parts")
    # one row a file, so one task can number them
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.withColumn("before", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def opened(path: str) -> pa.ipc.RecordBatchFileReader:
    """An Arrow file of the folder, memory-mapped where it is local."""
    store, name = _folder(path)
    local = isinstance(store, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(name) if local else store.open_input_file(name))


def sequence(path: str, part: int, index: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a part, without reading the others."""
    batch = opened(f"{path}/part-{part:07d}.tokens.arrow").get_batch(index // BATCH)
    row = index % BATCH
    return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and part. Each task reads whole files; batches are read one by one."""
    manifest = spark.read.parquet(f"{path}/manifest")
    files = manifest.select("part", "before").repartition(max(1, manifest.count()))  # a task for each file

    def run(batches):
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{path}/part-{part:07d}"
                docs = opened(f"{name}.docs.arrow").read_all()
                tokens = opened(f"{name}.tokens.arrow")
                start, n = (docs.column(k).to_numpy() for k in ("start", "n_tokens"))
                crc = np.zeros(len(n), np.int64)
                doc, done = 0, 0
                for b in range(tokens.num_record_batches):
                    ids = tokens.get_batch(b).column(0).flatten().to_numpy()
                    end = done + len(ids)
                    wide = ids.astype("<u4")
                    while doc < len(n) and start[doc] < end:
                        low, high = max(start[doc], done) - done, min(start[doc] + n[doc], end) - done
                        crc[doc] = zlib.crc32(wide[low:high], int(crc[doc]))
                        if start[doc] + n[doc] > end:
                            break
                        doc += 1
                    done = end
                yield pa.record_batch(
                    [docs.column("doc_id").combine_chunks(), pa.array(start + before), pa.array(n), pa.array(crc), pa.array(np.full(len(n), part, np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                )

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int")
