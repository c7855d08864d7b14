"""Best-fit decreasing packing of documents into token sequences of one capacity.

Pieces of the same length are interchangeable, so best-fit decreasing needs only how many pieces
each length has: at most ``capacity`` numbers, whatever the corpus. The driver plans on that
histogram, with a segment tree over remaining capacities that finds the tightest open bin in
logarithmic time; the plan says, for each length, which ranks go to which bins at which offset, and
its size depends on the capacity alone. Executors rank the pieces of each length and read their
places off the plan, so the whole corpus gets one global packing.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .textvec import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class CapacityTree:
    """A segment tree over remaining capacities 0..size that counts the open groups of each."""

    def __init__(self, size: int):
        self.base = 1
        while self.base <= size:
            self.base *= 2
        self.sums = [0] * (2 * self.base)

    def add(self, capacity: int, change: int) -> None:
        at = self.base + capacity
        while at:
            self.sums[at] += change
            at //= 2

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least that has a group, or -1."""
        at = self.base + least
        if self.sums[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return -1


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a histogram {length: pieces}.

    Rows (length, first rank, first bin, pieces a bin, offset), by length and rank: rank r of a row
    goes to bin ``first bin + (r - first rank) // pieces`` at ``offset + (r - first rank) % pieces * length``.
    A bin that took a piece and has room for another of that length is the tightest for it, so a bin
    takes as many as fit before the next one does: groups of like bins move together.
    """
    tree = CapacityTree(capacity)
    groups: dict[int, deque] = {}
    bins = 0
    rows = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            groups.setdefault(room, deque()).append((first, n))
            tree.add(room, 1)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit in {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = groups[room].popleft()
                tree.add(room, -1)
            each = room // length
            took = min(left, n * each)
            rows.append((length, rank, first, each, capacity - room))
            whole, rest = divmod(took, each)
            put(room - each * length, first, whole)
            if rest:
                put(room - rest * length, first + whole, 1)
            used = whole + (rest > 0)
            put(room, first + used, n - used)
            left -= took
            rank += took
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and end_id, cut only where longer than capacity; the
    first piece takes what is over. ``local_rank`` numbers a task's pieces of each length. With
    ``keep_ids`` also the ids, little-endian unsigned 32-bit."""

    def cut(batches):
        tokens, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                ids, sizes = tokens.encode([x or "" for x in some.column(1).to_pylist()])
                n = sizes + 1
                stops = np.cumsum(n)
                own = np.empty(int(stops[-1]), "<u4")
                ends = np.zeros(len(own), bool)
                ends[stops - 1] = True
                own[ends] = end_id
                own[~ends] = ids
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                first = (n - (k - 1) * capacity)[doc]
                length = np.where(piece == 0, first, capacity)
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                place = (stops - n)[doc] + start
                view = memoryview(own.view(np.uint8))
                spans = [view[4 * a : 4 * (a + b)] for a, b in zip(place.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                fresh = np.append(True, by[1:] != by[:-1])
                within = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
                rank = np.empty(len(by), np.int64)
                rank[order] = within + seen[by]
                np.add.at(seen, length, 1)
                arrays = [some.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array([bytes(x) for x in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    Null and empty texts are one piece of the end id. Repeated rows and repeated or null doc_ids are
    documents of their own. No documents: no rows. Extra columns of docs are not read. Pieces of the
    same length change places only if the input's rows come in another order or split.
    """
    cut = written(token_pieces(docs, path, end_id, capacity, doc_id, text, keep_ids), "pieces")
    per_part = cut.groupBy("part", "length").count()
    before = per_part.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = cut.groupBy("length").count().collect()  # capacity rows at most
    rows = plan({r["length"]: r["count"] for r in histogram}, capacity)
    keys = rows[:, 0] << 45 | rows[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda k: batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            length, rank = col("length"), col("rank")
            row = rows[np.searchsorted(keys, length << 45 | rank, side="right") - 1]
            q, r = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in names), pa.array(row[:, 2] + q), pa.array(row[:, 4] + r * length)], names=[*names, "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select(*names, (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long")
