"""Exact top-k by integer inner product: a KD-tree for each shard, best-first, with the kth score passed on.

Rows are cut into cells at the medians of a bounded sample, and a cell with more rows than a shard may
hold into several shards by a hash of the id. Each shard's tree is built and stored once; it splits at
the median of its widest dimension, and each node has the tight box of its rows, whose upper bound on a
query's inner product orders the traversal. A query visits shards by the bounds of their boxes, in
rounds of 1, 2, 4, ... shards; the kth score found so far leaves out shards and nodes whose bound is
below it. Ties go to the smaller id, so what equals the kth score is visited. Queries come to the trees
in blocks; rows are not copied for them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

SHARD_ROWS = 25_000
BLOCK_QUERIES = 2_000
#: Rows, of least hash, from which the cells' medians are taken.
SAMPLE_ROWS = 20_000
#: Rows of cells or shards that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
LEAF = 256
_EXACT = float(1 << 53)


class Tree:
    """vectors: whole numbers in float64; ids: int64."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # (from, to, left child, right child); a leaf's children are -1
        stack = [(0, len(ids), -1, 0)] if len(ids) else []
        while stack:
            a, b, parent, side = stack.pop()
            me = len(self.nodes)
            if parent >= 0:
                x = list(self.nodes[parent])
                x[2 + side] = me
                self.nodes[parent] = tuple(x)
            self.nodes.append((a, b, -1, -1))
            if b - a <= leaf or not vectors.shape[1]:
                continue
            part = vectors[order[a:b]]
            widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, widest], middle)]
            stack += [(a, a + middle, me, 0), (a + middle, b, me, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b, _, _ in self.nodes]).reshape(len(self.nodes), vectors.shape[1])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b, _, _ in self.nodes]).reshape(len(self.nodes), vectors.shape[1])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that any row in each node's box can score with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: float) -> list[tuple[float, int]]:
        """The best k rows, other than ``own``, that score kth or more: (score, id), best first."""
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            got = self.vectors[a:b] @ query
            hit = np.flatnonzero((got >= kth) & (self.ids[a:b] != own))
            if not len(hit):
                continue
            scores, ids = np.concatenate([scores, got[hit]]), np.concatenate([ids, self.ids[a:b][hit]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                kth = max(kth, scores[-1])
        best = np.lexsort((ids, -scores))[:k]
        return list(zip(scores[best].tolist(), ids[best].tolist(), strict=True))


    def packed(self) -> dict[str, bytes]:
        return {"ids": self.ids.tobytes(), "vectors": self.vectors.tobytes(), "nodes": np.array(self.nodes, np.int64).tobytes(), "boxes": np.stack([self.low, self.high]).tobytes()}

    @classmethod
    def unpacked(cls, dim: int, ids: bytes, vectors: bytes, nodes: bytes, boxes: bytes) -> Tree:
        own = cls.__new__(cls)
        own.ids = np.frombuffer(ids, np.int64)
        own.vectors = np.frombuffer(vectors, np.float64).reshape(len(own.ids), dim)
        own.nodes = np.frombuffer(nodes, np.int64).reshape(-1, 4).tolist()
        own.low, own.high = np.frombuffer(boxes, np.float64).reshape(2, len(own.nodes), dim)
        return own


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Median splits of the widest dimension, by heap order, into ``cells`` (a power of two) cells."""
    out, parts = [], [sample]
    while len(out) < cells - 1:
        part = parts.pop(0)
        widest = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.size else 0
        value = float(np.median(part[:, widest])) if part.size else 0.0
        out.append((widest, value))
        low = part[:, widest] < value if part.size else np.zeros(len(part), bool)
        parts += [part[low], part[~low]]
    return out


def _placed(splits: dict[int, list[tuple[int, float]]]):
    """Batches (vec_id, asked, dim, v) with the number of each row's cell."""

    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                rows, own = np.flatnonzero(dims == dim), splits.get(dim, [])
                if not own or not dim:
                    continue
                x = batch.column(3).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                at = np.zeros(len(rows), np.int64)
                axis, value = (np.array([s[k] for s in own]) for k in (0, 1))
                while at[0] < len(own):  # all rows are equally deep
                    at = 2 * at + 1 + (x[np.arange(len(rows)), axis[at]] >= value[at])
                cell[rows] = at - len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"]))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "dim": [int(pdf["dim"].iloc[0])], **{k: [v] for k, v in tree.packed().items()}, "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()]})


def _next_shards(boxes, take: int):
    """Batches (q_id, q, dim, kth, seen) -> (shard, q_id, q, dim, kth) of the next shards by bound that may hold the kth score or more."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("shard", "row")}
            dims, kth, seen = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                shard, low, high = boxes.value[dim]
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), 256):
                    own = rows[at : at + 256]
                    q = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
                    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    for row, bound in zip(own.tolist(), bounds, strict=True):
                        order = np.argsort(-bound, kind="stable")[int(seen[row]) : int(seen[row]) + take]
                        order = order[bound[order] >= kth[row]] if kth[row] == kth[row] else order
                        out["shard"].append(shard[order])
                        out["row"].append(np.full(len(order), row, np.int64))
            shard, row = (np.concatenate(out[k]) if out[k] else np.zeros(0, np.int64) for k in ("shard", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(k).take(pa.array(row)) for k in range(4))], names=["shard", "q_id", "q", "dim", "kth"])

    return run


def _searched(k: int):
    """Batches (dim, ids, vectors, nodes, boxes, queries): a tree and a block of queries each -> what the tree has for them."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                dim, ids, vectors, nodes, boxes, queries = (batch.column(c)[n].as_py() for c in range(6))
                tree = Tree.unpacked(dim, ids, vectors, nodes, boxes)
                asked = _matrix([x["q"] for x in queries])
                if np.abs(tree.vectors).max(initial=0) * np.abs(asked).max(initial=0) * max(1, dim) >= _EXACT:
                    raise ValueError("components too large for exact scores")
                out, bounds = [], tree.bounds(asked)
                for x, q, bound in zip(queries, asked, bounds, strict=True):
                    out += [(x["q_id"], i, int(s)) for s, i in tree.search(x["q_id"], q, bound, k, -np.inf if x["kth"] is None else x["kth"])]
                got = np.array(out, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, c]) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Each query's k rows of highest integer inner product: query_id, rank (from 1), vec_id, score.

    A component x becomes floor(scale * x), x as double. Vectors that are null or hold null, NaN or an
    infinity, and null ids, take no part; vectors of different lengths never meet. Rows of the query's
    own id are not its candidates; repeated queries are asked once, repeated candidates count each.
    Fewer candidates than k: all. No queries or no candidates: no rows. Extra columns are not read.
    Scores of 2**53 or more raise an error. The driver holds a sample of SAMPLE_ROWS rows and, for each
    shard, a row with its box.
    """
    spark = vectors.sparkSession
    good = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("asked")).filter(good)
    rows = rows.select("vec_id", "asked", F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample, splits = {}, {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "v").collect():
        sample.setdefault(r["dim"], []).append(r["v"])
    for dim, n in counts.items():
        cells = 1
        while cells * shard_rows < n:
            cells *= 2
        splits[dim] = _splits(_matrix(sample.get(dim, [])), cells)
    placed = rows.mapInArrow(_placed(splits), "vec_id long, asked boolean, dim int, v array<double>, cell long")

    table, shards = [], 0
    for r in sorted(placed.groupBy("dim", "cell").count().collect()):  # a row for each cell
        parts = -(-r["count"] // shard_rows)
        table.append((r["dim"], r["cell"], shards, parts))
        shards += parts
    cells = spark.createDataFrame(table, "dim int, cell long, base long, parts long")
    dealt = placed.join(F.broadcast(cells) if len(table) <= BROADCAST_ROWS else cells, ["dim", "cell"])
    dealt = dealt.select("vec_id", "dim", "v", (F.col("base") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("shard"))
    trees = written(dealt.groupBy("shard").applyInPandas(_build, "shard long, dim int, ids binary, vectors binary, nodes binary, boxes binary, low array<double>, high array<double>"), "trees")
    boxes = {}
    for r in trees.select("dim", "shard", "low", "high").collect():
        boxes.setdefault(r["dim"], []).append((r["shard"], r["low"], r["high"]))
    boxes = spark.sparkContext.broadcast({d: (np.array([x[0] for x in own], np.int64), _matrix([x[1] for x in own]), _matrix([x[2] for x in own])) for d, own in boxes.items()})

    asked = written(rows.filter("asked").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q"), "dim").distinct(), "asked")
    state, best, take, seen = asked.select("*", F.lit(None).cast("double").alias("kth"), F.lit(0).alias("seen")), None, 1, 0
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    while seen < shards:
        planned = written(state.mapInArrow(_next_shards(boxes, take), "shard long, q_id long, q array<double>, dim int, kth double"), "planned")
        busy = planned.groupBy("shard").agg(F.ceil(F.count("*") / block_queries).cast("long").alias("blocks"))
        if not planned.limit(1).count():
            break
        met = planned.join(F.broadcast(busy) if shards <= BROADCAST_ROWS else busy, "shard")
        block = met.groupBy("shard", F.pmod(F.xxhash64("q_id"), "blocks").alias("block")).agg(F.collect_list(F.struct("q_id", "q", "kth")).alias("queries"))  # about block_queries of them
        found = block.join(trees, "shard").select("dim", "ids", "vectors", "nodes", "boxes", "queries").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
        every = found if best is None else best.unionByName(found)
        now = written(every.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "nearest")
        for old in (planned, best):
            if old is not None:
                drop_written(old)
        best, seen, take = now, seen + take, 2 * take
        kth = best.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col("query_id").alias("q_id"), F.when(F.col("n") >= k, F.col("low")).cast("double").alias("kth"))
        state = asked.join(kth, "q_id", "left").select("q_id", "q", "dim", "kth", F.lit(seen).alias("seen"))
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.withColumn("rank", rank.cast("int")).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
