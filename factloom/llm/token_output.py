"""Operator 1: token ids as flat, memory-mapped binary shards.

A shard is three files: ``.bin`` holds the ids of its documents back to back
as unsigned integers, ``.off`` the ``n + 1`` 64-bit offsets of its documents
counted from the shard's first id, ``.ids`` the 64-bit document ids. A shard's
place in the whole corpus (its base) is the prefix sum of the shards before
it, so shards are written in parallel without knowing each other.

Defined results: null text is empty and yields only the end id; rows are
ordered by (doc_id, hash of the text), null doc_ids first, stored as
``NO_ID`` and read back as null; repeated rows are each written; an empty
table gives a dataset with no shards; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, scratch, written
from .tokens import encoder

#: Stands for a null doc_id in ``.ids`` files.
NO_ID = -(1 << 63)
_READ_IDS = 1 << 22
_SHARDS = "shard int, file string, n_docs long, n_ids long"
_BASED = "file string, doc_base long, id_base long, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, position long"


@dataclass(frozen=True)
class Shard:
    file: str
    doc_base: int
    id_base: int
    n_docs: int
    n_ids: int


@dataclass(frozen=True)
class TokenDataset:
    """Shards in ascending order under ``folder``; one entry per written file, not per document."""

    folder: str
    dtype: str
    shards: tuple[Shard, ...]

    def open(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets and document ids of a shard; memory-mapped where the path is local."""
        return tuple(_mapped(f"{self.folder}/{shard.file}.{x}", kind) for x, kind in (("bin", self.dtype), ("off", "<i8"), ("ids", "<i8")))

    def document(self, position: int) -> np.ndarray:
        """Ids of the document at a global position."""
        k = int(np.searchsorted([s.doc_base for s in self.shards], position, "right")) - 1
        shard = self.shards[k]
        if not 0 <= position - shard.doc_base < shard.n_docs:
            raise IndexError(position)
        ids, offsets, _ = self.open(shard)
        i = position - shard.doc_base
        return np.asarray(ids[offsets[i] : offsets[i + 1]])

    def documents(self, spark: SparkSession) -> DataFrame:
        """Per document, read from the files: doc_id, start, n_tokens, ids_crc32, position."""
        if not self.shards:
            return spark.createDataFrame([], _DOCS)
        rows = [(s.file, s.doc_base, s.id_base, s.n_docs, s.n_ids) for s in self.shards]
        shards = spark.createDataFrame(rows, _BASED).repartition(min(len(rows), 8 * spark.sparkContext.defaultParallelism))
        folder, dtype = self.folder, self.dtype

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _read_shard(TokenDataset(folder, dtype, ()), Shard(**row))

        return shards.mapInArrow(read, _DOCS)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    system, path = file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return np.frombuffer(source.read_buffer(), dtype)  # a view of the mapping, not a copy
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype)


def _read_shard(dataset: TokenDataset, shard: Shard) -> Iterator[pa.RecordBatch]:
    ids, offsets, doc_ids = dataset.open(shard)
    assert len(ids) == shard.n_ids and len(doc_ids) == shard.n_docs == len(offsets) - 1
    at = 0
    while at < shard.n_docs:  # blocks of about _READ_IDS ids, one document at least
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _READ_IDS, "right")) - 1)
        wide = ids[offsets[at] : offsets[end]].astype("<u4")
        cut = offsets[at : end + 1] - offsets[at]
        crc = [zlib.crc32(wide[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        keys = doc_ids[at:end]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, mask=keys == NO_ID),
                pa.array(offsets[at:end] + shard.id_base),
                pa.array(np.diff(offsets[at : end + 1])),
                pa.array(crc, pa.int64()),
                pa.array(np.arange(at, end, dtype=np.int64) + shard.doc_base),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32", "position"],
        )
        at = end


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> TokenDataset:
    """Write ``docs`` (doc_id, text) as shards in ascending doc_id order.

    One range shuffle orders the rows; each partition then encodes and writes
    its own shard, under a name no other attempt uses. Only attempts whose
    manifest row Spark committed count, so lost executors and repeated tasks
    leave no wrong shard behind.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, (system, path) = encoder(tokenizer), file_system(folder)
        pid, sink, name = TaskContext.get().partitionId(), {}, ""
        n_docs = n_ids = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not sink:
                    system.create_dir(path, recursive=True)
                    name = f"shard-{pid:06d}-{uuid.uuid4().hex[:12]}"
                    sink = {x: system.open_output_stream(f"{path}/{name}.{x}") for x in ("bin", "off", "ids")}
                    sink["off"].write(np.zeros(1, "<i8").tobytes())
                for ids, offsets in enc.encode_column(batch.column("text"), end_id):
                    sink["bin"].write(ids.tobytes())
                    sink["off"].write((n_ids + offsets[1:]).astype("<i8").tobytes())
                    n_docs, n_ids = n_docs + len(offsets) - 1, n_ids + len(ids)
                keys = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                sink["ids"].write(keys.astype("<i8").tobytes())
        finally:
            for stream in sink.values():
                stream.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"shard": pid, "file": name, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = written(rows.mapInArrow(write, _SHARDS), "manifest")
    shards, doc_base, id_base = [], 0, 0
    for row in sorted(manifest.collect()):  # a row per shard file
        shards.append(Shard(row.file, doc_base, id_base, row.n_docs, row.n_ids))
        doc_base, id_base = doc_base + row.n_docs, id_base + row.n_ids
    return TokenDataset(folder, encoder(tokenizer).dtype.str, tuple(shards))
