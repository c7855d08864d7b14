"""Token-id files: documents in ascending doc_id order, rANS-coded blocks, parallel reading.

A file set is a folder with ``blocks`` (block number, ids before it, the block's bytes; Parquet is
only the container, so any store that Spark writes to will do and a retried task leaves nothing
behind) and ``symbols`` (the shared frequency table). Each block decodes by itself.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import drop_written, scratch, written
from .textvec import encoder

#: Ids in a block, unless its last document makes it longer.
BLOCK = 1 << 18


def _blocks(path: str, end_id: int, block: int):
    """Batches (doc_id, text) in order -> rows (part, blk, before, n, docs, packed)."""

    def run(batches):
        import zstandard

        tokens, part = encoder(path), TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=1)
        parts, sizes, doc_ids, held, before, k = [], [], [], 0, 0, 0

        def flush():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([squeeze.compress(_narrow(ids))], pa.binary())], names=["part", "blk", "before", "n", "doc_ids", "sizes", "packed"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, n = tokens.encode([x or "" for x in some.column(1).to_pylist()])
                for doc, own in zip(some.column(0).to_pylist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    parts += [own.astype(np.uint32), np.array([end_id], np.uint32)]
                    sizes.append(len(own) + 1)
                    doc_ids.append(doc)
                    held += len(own) + 1
                    if held >= block:
                        yield flush()
                        before, k, held = before + held, k + 1, 0
                        parts, sizes, doc_ids = [], [], []
        if held:
            yield flush()

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Bytes planes after one another: the high bytes of ids repeat much more than the low ones."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _unpacked(batches):
    import zstandard

    squeeze = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, _wide(squeeze.decompress(row["packed"]))


def _count(batches):
    counts = np.zeros(0, np.int64)
    for _, ids in _unpacked(batches):
        own = np.bincount(ids, minlength=len(counts))
        own[: len(counts)] += counts
        counts = own
    has = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has], pa.int64())], names=["symbol", "count"])


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, to: str | None = None, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> str:
    """Encodes every whole text (null: empty), appends end_id to each, and writes the files; returns their folder.

    Documents lie in ascending doc_id order, nulls first; rows of one doc_id by a hash of the text,
    and repeated rows are kept. No documents: no blocks and an empty table. Extra columns of docs are
    not read. Ids are made once; they wait, compressed, in the shared folder until their counts over
    the whole corpus give the frequency table, which is as large as the vocabulary.
    """
    spark = docs.sparkSession
    to = to or scratch(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    kept = written(ordered.mapInArrow(_blocks(path, end_id, block), "part int, blk int, before long, n long, doc_ids array<long>, sizes array<long>, packed binary"), "ids", "uncompressed")
    counts = kept.select("packed").mapInArrow(_count, "symbol int, count long").groupBy("symbol").agg(F.sum("count").alias("count")).collect()  # as many as the vocabulary has
    total = np.zeros(1 + max((r["symbol"] for r in counts), default=-1), np.int64)
    for r in counts:
        total[r["symbol"]] = r["count"]
    freq = rans.Table.of_counts(total).freq.astype(np.int64)
    per_part = sorted((r["part"], r["n"], r["k"]) for r in kept.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect())  # a row for each partition
    base, blocks, a, b = {}, {}, 0, 0
    for part, n, k in per_part:
        base[part], blocks[part] = a, b
        a, b = a + n, b + k

    def encode(batches):
        table = _table(freq.tobytes())
        for row, ids in _unpacked(batches):
            start = base[row["part"]] + row["before"]
            data = rans.write_block(ids, row["doc_ids"], np.array(row["sizes"], np.int64), start, table)
            yield pa.RecordBatch.from_arrays([pa.array([blocks[row["part"]] + row["blk"]], pa.int64()), pa.array([start], pa.int64()), pa.array([data], pa.binary())], names=["block", "start", "data"])

    kept.mapInArrow(encode, "block long, start long, data binary").write.option("compression", "uncompressed").parquet(f"{to}/blocks")
    has = np.flatnonzero(freq)
    spark.createDataFrame([(int(k), int(freq[k])) for k in has], "symbol int, freq long").coalesce(1).write.parquet(f"{to}/symbols")
    drop_written(kept)
    return to


@lru_cache(maxsize=2)
def _table(freq: bytes) -> rans.Table:
    return rans.Table(np.frombuffer(freq, np.int64))


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row for each document of the files, decoded and checked block by block: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit (and ids)."""
    symbols = spark.read.schema("symbol int, freq long").parquet(f"{path}/symbols").collect()  # as many as the vocabulary has
    freq = np.zeros(1 + max((r["symbol"] for r in symbols), default=-1), np.int64)
    for r in symbols:
        freq[r["symbol"]] = r["freq"]

    def run(batches):
        table = _table(freq.tobytes())
        for batch in batches:
            for data in batch.column(0):
                ids, doc_ids, sizes, start = rans.read_block(data.as_py(), table)
                stops = np.cumsum(sizes)
                view = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8))
                spans = [view[4 * (b - n) : 4 * b] for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(start + stops - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in spans], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array([bytes(x) for x in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return spark.read.schema("block long, start long, data binary").parquet(f"{path}/blocks").select("data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
