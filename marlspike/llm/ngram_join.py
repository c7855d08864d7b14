"""N-gram Jaccard join by PartEnum signatures, and the classes its links make.

A document is the set of its distinct word n-grams. Two sets with 100 * |A & B| >= percent * |A | B|
differ in at most k = floor((|A| + |B|) * (100 - percent) / (100 + percent)) elements. Sizes fall into
bands; in a band's scheme the feature domain is cut into n1 groups of n2 partitions each, and some
group has at most k2 of the differences, so the two sets agree on some n2 - k2 of its partitions:
every such subset of every group gives one signature, and similar sets share one. Sets near a band's
end also sign in the next band's scheme.

Equal sets are one node. What shares a signature is a group. First every set of a group is held
against the group's least. Where that leaves a group in several components, its pairs across
components are screened inside the group by parity sketches of the sets' own length, which bound the
difference exactly; of the pairs that pass, each group gives a spanning forest (nearest first) to be
verified. Only groups that are still apart then, and have pairs left, give those. So each pair that
shares a signature is verified on whole texts, ruled out by its sketches, or already joined.

A signature with more sets than ``most`` is cut into pieces; where a few of its sets stay outside its
largest component, they meet every piece, and where many do, its sets are signed once more, with
another partition of the domain: similar sets share a signature of both.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, free_names, release, written
from .components import components
from .textvec import mix, pieces, utf8_buffers, words

#: Sets of one signature that are held against each other at once.
MOST = 2048
#: Rows of one least set's groups that go to one task, about.
SHARE = 50_000
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
_RATIO = 1.5
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of words; fewer words make one."""
    out = []
    stops = np.cumsum(counts)
    if len(hashes):
        grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            grams += mix(hashes[k : k + len(grams)] * _C[k % 8] + np.uint64(k // 8)) if k >= 8 else hashes[k : k + len(grams)] * _C[k]
        grams = mix(grams)
    for stop, c in zip(stops.tolist(), counts.tolist(), strict=True):
        if c >= n:
            out.append(np.unique(grams[stop - c : stop - n + 1]))
        elif c:
            own = np.array([c], np.uint64)
            for k in range(stop - c, stop):
                own = mix(own * _C[1] + hashes[k : k + 1])
            out.append(own)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of each text's word n-grams as sorted 64-bit hashes."""
    return _grams(*words(data, offsets), n)


def shingle_pairs(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same by two independent hashes: where both say so, 128 bits agree."""
    (h, g), counts = words(data, offsets, second=True)
    return _grams(h, counts, n), _grams(g, counts, n)


class Schemes:
    """The signature schemes of one similarity."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent is in 1..100")
        self.percent = percent
        self.low = [1]

    @lru_cache(maxsize=None)  # noqa: B019 one object for each similarity
    def scheme(self, band: int) -> tuple | None:
        """(k, n1, n2, k2, spare, edges) for pairs whose larger set is in the band; None if only equal sets are similar."""
        top = self.low[band + 1] - 1
        k = 2 * top * (100 - self.percent) // (100 + self.percent)
        if not k:
            return None
        if k <= 3:
            n1, n2, k2, spare = 1, k + 2, k, -1
        elif k <= 5:
            n1, n2, k2, spare = 2, 4, 2, -1
        else:
            n1, n2, k2 = k // 2 + 1, 3, 1
            # more groups than needed, as many as small sets of the band are likely to have with an empty subset
            empty = 3 * np.exp(-2 * self.percent / 100 / _RATIO * top / (n1 * n2))
            spare = int(n1 * min(0.25, max(0.03, 1.6 * empty))) + 1
            n1 += spare
        parts = n1 * n2
        edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
        return k, n1, n2, k2, spare, edges

    def band(self, size: int) -> int:
        while self.low[-1] <= size * 2 + 2:
            self.low.append(max(int(self.low[-1] * _RATIO), self.low[-1] + 1))
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def signatures(self, items: np.ndarray, seed: int = 0) -> np.ndarray:
        """The signatures of a sorted set of 64-bit hashes; another seed partitions the domain in another way."""
        size = len(items)
        if not size:
            return items
        if seed:
            items = np.sort(mix(items + np.array([seed], np.uint64) * _C[7]))
        band = self.band(size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(items * _C[2]), dtype=np.uint64)])
        out = []
        larger = size * 100 // self.percent
        for b in range(band, self.band(larger) + 1):
            scheme = self.scheme(b)
            if scheme is None:
                continue
            k, n1, n2, k2, spare, edges = scheme
            at = np.concatenate([[0], np.searchsorted(items, edges), [size]])
            sums = (total[at[1:]] - total[at[:-1]]).reshape(n1, n2)
            counts = np.diff(at).reshape(n1, n2)
            subsets = list(combinations(range(n2), n2 - k2))
            # An empty subset says nothing. Similar sets agree in spare + 1 groups, and where they agree on an
            # empty subset, both have it: a set with at most ``spare`` such groups leaves them out, and one with
            # more leaves out half as many, so that together two of these leave out ``spare`` at most.
            empty = np.stack([counts[:, s].sum(axis=1) == 0 for s in subsets])
            groups = np.flatnonzero(empty.any(axis=0))
            left_out = np.zeros(n1, bool)
            left_out[groups if len(groups) <= spare else groups[: max(0, spare // 2)]] = True
            for j, s in enumerate(subsets):
                own = np.arange(n1, dtype=np.uint64) * _C[3] + np.array([b * 64 + j], np.uint64) * _C[4]
                for place, part in enumerate(s):
                    own = own + mix(sums[:, part] + _C[5 + place % 3])  # the subset's number tells places apart
                    own = own * _C[6]
                out.append(mix(own)[~(empty[j] & left_out)])
        return np.concatenate(out) if out else items[:0]


@lru_cache(maxsize=8)
def schemes(percent: int) -> Schemes:
    return Schemes(percent)


def sketch(items: np.ndarray) -> bytes:
    """A parity sketch of two to four bits for each element: a power of two, 256 at least. The distance of two
    sets' sketches, folded to one length, never exceeds their difference."""
    bits = max(256, 2 << max(0, len(items) - 1).bit_length())
    own = np.bincount(((items >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(own.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of rows, and the distances of pairs of rows."""

    def __init__(self, column: list[bytes]):
        self.flat = np.frombuffer(b"".join(column), np.uint64)
        self.length = np.array([len(x) // 8 for x in column], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _rows(self, rows: np.ndarray, length: int, to: int) -> np.ndarray:
        own = self.flat[self.start[rows][:, None] + np.arange(length)]
        return np.bitwise_xor.reduce(own.reshape(len(rows), -1, to), axis=1) if length > to else own

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        x, y = self.length[a], self.length[b]
        for m, n in {*zip(x.tolist(), y.tolist(), strict=True)}:
            to = min(m, n)
            own = np.flatnonzero((x == m) & (y == n))
            step = max(1, (1 << 18) // max(m, n))  # 2 MB at once
            for k in range(0, len(own), step):
                rows = own[k : k + step]
                out[rows] = np.bitwise_count(self._rows(a[rows], m, to) ^ self._rows(b[rows], n, to)).sum(axis=1, dtype=np.int64)
        return out


def _texts(batches, most: int = 1_500_000, text: int = 1):
    """(batch, from, to, bytes, offsets) of bounded parts of batches."""
    for batch in batches:
        data, offsets = utf8_buffers(batch.column(text))
        for a, b in pieces(np.diff(offsets).tolist(), most):
            yield batch, a, b, data, offsets[a : b + 1]


def _identified(n: int):
    """Batches (doc_id, text) -> (doc_id, n_shingles, h1, h2, sketch): equal sets have the same two hashes."""

    def run(batches):
        for batch, a, b, data, offsets in _texts(batches):
            sets, other = shingle_pairs(data, offsets, n)
            size = [max(len(x), len(y)) for x, y in zip(sets, other, strict=True)]
            hashes = [np.array([mix(x + c).sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64) for own, c in ((sets, _C[0]), (other, _C[7]))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(size, pa.int64()), *map(pa.array, hashes), pa.array([sketch(x) for x in sets], pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return run


def _signed(n: int, percent: int):
    """Batches (doc_id, text) -> (sig, doc)."""

    def run(batches):
        own = schemes(percent)
        for batch, a, b, data, offsets in _texts(batches):
            sigs = [own.signatures(x) for x in shingle_hashes(data, offsets, n)]
            doc = np.repeat(batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False), [len(x) for x in sigs])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(doc, pa.int64())], names=["sig", "doc"])

    return run


def _signed_again(n: int, percent: int):
    """Batches (doc_id, text, sigs) -> (sig, doc): each of the sigs with each signature of another seed."""

    def run(batches):
        own = schemes(percent)
        for batch, a, b, data, offsets in _texts(batches):
            for k, items in enumerate(shingle_hashes(data, offsets, n), a):
                more, doc = own.signatures(items, seed=1), batch.column(0)[k].as_py()
                for sig in batch.column(2)[k].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array(mix(more * _C[1] + np.array([sig], np.int64).view(np.uint64)).view(np.int64)), pa.array(np.full(len(more), doc, np.int64))], names=["sig", "doc"])

    return run


_GROUPS = "hot boolean, k1 long, k2 long, low long, docs array<long>"


def _grouped(most: int):
    """Rows (sig, doc) sorted by sig -> groups of distinct docs that share a sig. A group's key are two hashes of its
    docs, so that signatures of the same docs are one; a sig with more than ``most`` rows is hot, and gives its docs
    in pieces of that many, under the sig and the piece's number. low: the least doc of the group, or first piece."""

    def groups(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        for distinct in (False, True):  # few rows share a sig: only these are sorted
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(sig)))
            keep = np.repeat(size > 1, size)
            sig, doc, size = sig[keep], doc[keep], size[size > 1]
            if not distinct:
                order = np.lexsort((doc, sig))
                sig, doc = sig[order], doc[order]
                fresh = np.append(True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))[: len(sig)]
                sig, doc = sig[fresh], doc[fresh]
        start = np.cumsum(size) - size
        keys = [np.add.reduceat(mix(doc.view(np.uint64) + c), start).view(np.int64) if len(doc) else doc for c in (_C[0], _C[4])]
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)).astype(np.int32)), pa.array(doc))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(size), bool)), *map(pa.array, keys), pa.array(doc[start]), lists], names=["hot", "k1", "k2", "low", "docs"])

    def piece(sig: int, number: int, low: int, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([True]), pa.array([sig], pa.int64()), pa.array([number], pa.int64()), pa.array([low], pa.int64()), pa.array([np.unique(doc)], pa.list_(pa.int64()))], names=["hot", "k1", "k2", "low", "docs"])

    def run(batches):
        sig, doc, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # hot: (sig, pieces so far, its low)
        for batch in batches:
            sig, doc = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((sig, doc)))
            while len(sig):
                if hot and hot[0] == sig[0]:  # goes on
                    turn = np.flatnonzero(sig != sig[0])
                    end = int(turn[0]) if len(turn) else len(sig)
                    if end == len(sig) and end < most:
                        break
                    cut = min(end, most)
                    yield piece(hot[0], hot[1], hot[2], doc[:cut])
                    hot = (hot[0], hot[1] + 1, hot[2])
                    sig, doc = sig[cut:], doc[cut:]
                    continue
                hot = None
                turns = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig))
                large = np.flatnonzero(np.diff(np.append(0, turns)) > most)
                upto = int(large[0]) if len(large) else len(turns) - 1  # the last group may go on
                at = int(turns[upto - 1]) if upto else 0
                if at:
                    yield groups(sig[:at], doc[:at])
                    sig, doc = sig[at:], doc[at:]
                if not len(large):
                    break
                hot = (int(sig[0]), 0, int(doc[:most].min()))
        if len(sig):
            yield piece(hot[0], hot[1], hot[2], doc) if hot and hot[0] == sig[0] else groups(sig, doc)

    return run


def _groups_of(signed: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups (low, docs), each set of docs once; hot pieces (sig, piece, low, docs); the table of both) of rows (sig, doc)."""
    cut = written(signed.repartition("sig").sortWithinPartitions("sig").mapInArrow(_grouped(most), _GROUPS), name)
    groups = cut.filter("not hot").groupBy("k1", "k2").agg(F.first("low").alias("low"), F.first("docs").alias("docs"))
    return groups.select("low", "docs"), cut.filter("hot").select(F.col("k1").alias("sig"), F.col("k2").alias("piece"), "low", "docs"), cut


def _near(percent: int):
    """Of batches (a, b, m, n, x, y) with sizes m, n and sketches x, y, the pairs that these can't rule out."""

    def run(batches):
        for batch in batches:
            m, n = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in "mn")
            own = Sketches([z for k in "xy" for z in batch.column(batch.schema.get_field_index(k)).to_pylist()])
            fit = np.flatnonzero(np.minimum(m, n) * 100 >= np.maximum(m, n) * percent)
            far = own.distances(fit, fit + len(m))
            keep = pa.array(fit[far * (100 + percent) <= (m + n)[fit] * (100 - percent)])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)).take(keep) for k in "ab"], names=["a", "b"])

    return run


def _similar(n: int, percent: int):
    """Of batches (a, b, x, y) with whole texts x, y, the pairs whose sets are similar enough. Rows of one a adjoin."""

    def sets(column: pa.Array, rows: slice) -> tuple[list[np.ndarray], list[np.ndarray]]:
        data, offsets = utf8_buffers(column.slice(rows.start, rows.stop - rows.start))
        return shingle_pairs(data, offsets, n)

    def both(x: np.ndarray, y: np.ndarray) -> int:
        z = np.sort(np.concatenate([x, y]))
        return int((z[1:] == z[:-1]).sum())

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep, held = [], (None, None, None)
            for a, b in pieces([len(v.as_buffer() or b"") if v.is_valid else 0 for v in right], 1_500_000):
                ys = sets(right, slice(a, b))
                for k in range(a, b):
                    v = left[k].as_py()
                    if held[0] != v:
                        held = (v, *(z[0] for z in sets(left, slice(k, k + 1))))
                    size = [max(len(held[1]), len(held[2])), max(len(z[k - a]) for z in ys)]
                    common = min(both(x, z[k - a]) for x, z in zip(held[1:], ys, strict=True))
                    keep.append(common > 0 and 100 * common >= percent * (sum(size) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts are similar enough. Texts of other documents don't move."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = _with_small(texts, written(ids, "ids"), "doc_id", "left_semi")
    met = pairs.join(own.toDF("b", "y"), "b").join(own.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return written(met.mapInArrow(_similar(n, percent), "a long, b long"), "links")


def _candidates(group: np.ndarray, doc: np.ndarray, comp: np.ndarray, low: np.ndarray, size: np.ndarray, own: Sketches, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of pairs of rows of a group (rows by group and size) in different components that sizes and
    sketches can't rule out. Pairs with the group's least have been held against each other before."""
    last = np.searchsorted(group, group, side="right")
    rows, out, step = np.arange(len(group)), [], 1
    while len(rows):
        rows = rows[rows + step < last[rows]]
        rows = rows[size[rows] * 100 >= size[rows + step] * percent]  # the next are larger still
        a, b = rows, rows + step
        open_ = (comp[a] != comp[b]) & (doc[a] != doc[b]) & (doc[a] != low[a]) & (doc[b] != low[b])
        a, b = a[open_], b[open_]
        if len(a):
            far = own.distances(a, b)
            near = far * (100 + percent) <= (size[a] + size[b]) * (100 - percent)
            out.append(np.stack([a[near], b[near], far[near]]))
        step += 1
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def _forest(a: np.ndarray, b: np.ndarray, far: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which edges (a, b) make a spanning forest over the labels of rows, nearest first (Boruvka's rounds)."""
    picked = np.zeros(len(a), bool)
    up = list(range(int(label.max(initial=-1)) + 1))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    order = np.argsort(far, kind="stable")
    open_ = order
    while len(open_):
        roots = np.array([root(x) for x in range(len(up))], np.int64)
        x, y = roots[label[a[open_]]], roots[label[b[open_]]]
        open_, x, y = open_[x != y], x[x != y], y[x != y]
        if not len(open_):
            break
        ends = np.concatenate([x, y])
        _, first = np.unique(ends, return_index=True)  # of each label the nearest edge, by either end
        least = np.full(len(up), len(open_), np.int64)
        np.minimum.at(least, ends[first], first % len(open_))
        for at in np.unique(least[least < len(open_)]).tolist():
            p, q = root(int(x[at])), root(int(y[at]))
            if p != q:
                up[max(p, q)] = min(p, q)
                picked[open_[at]] = True
    return picked


def _blocks(percent: int, rest: bool, most: int = 20_000):
    """Rows (g, doc, low, size, sketch, comp, now) sorted by (low, g, size, doc), whole groups at a time -> (g, a, b).
    Groups of one low adjoin, and a pair that several of them give is given once.

    Without ``rest``: (null, a, b) of a spanning forest of each group's candidate pairs, and (g, null, null) where it has more.
    With it: these others, as far as the components ``now``, which the forest has led to, are still apart."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        g, doc, low, size, comp, now = (table.column(k).to_numpy() for k in ("g", "doc", "low", "size", "comp", "now"))
        group = np.cumsum(np.append(0, g[1:] != g[:-1]))
        a, b, far = _candidates(group, doc, comp, low, size, Sketches(table.column("sketch").to_pylist()), percent)
        used = np.unique(np.concatenate([a, b]))  # rows that have a pair at all
        label = np.zeros(len(g), np.int64)
        if len(used):
            order = used[np.lexsort((comp[used], group[used]))]
            label[order] = np.cumsum(np.append(0, (group[order[1:]] != group[order[:-1]]) | (comp[order[1:]] != comp[order[:-1]])))
        tree = _forest(a, b, far, label[: used[-1] + 1] if len(used) else label[:0])
        pick = ~tree & (now[a] != now[b]) if rest else tree
        x, y = doc[a[pick]], doc[b[pick]]
        x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        more = np.zeros(0, np.int64) if rest else np.unique(g[a[~tree]])
        none = pa.nulls(len(more), pa.int64())
        columns = [pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(more)]), *(pa.concat_arrays([pa.array(z), none]) for z in (x, y))]
        return pa.RecordBatch.from_arrays(columns, names=["g", "a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            if held.num_rows >= most:
                key = held.column("g").to_numpy()
                turn = np.flatnonzero(key[1:] != key[:-1])
                if len(turn):  # the last group may go on
                    yield pairs(held.slice(0, int(turn[-1]) + 1).combine_chunks())
                    held = held.slice(int(turn[-1]) + 1).combine_chunks()
        if held is not None and held.num_rows:
            yield pairs(held.combine_chunks())

    return run


def _with_small(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """A join that broadcasts the small side if its rows are few enough, by count, and else shuffles both."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_IDS else small, on, how)


def _of_hot(hot: DataFrame, found: DataFrame, texts: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """Groups (low, docs) that hold every pair of a hot signature's docs across components, as far as it isn't
    sure that they aren't similar."""
    rows = hot.select("sig", "piece", "low", F.explode("docs").alias("doc")).join(found, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    rows = written(rows, "hot")
    by = rows.groupBy("sig", "comp").count()
    kinds = by.groupBy("sig").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("n"), F.count("*").alias("comps"))
    kinds = written(kinds.filter("comps > 1").select("sig", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.count")).alias("outside")), "kinds")
    outside = rows.join(kinds.filter(F.col("outside") <= most), "sig").filter("comp <> main").groupBy("sig").agg(F.collect_set("doc").alias("few"))  # most, at most
    groups = hot.join(outside, "sig").select("low", F.array_distinct(F.concat("docs", "few")).alias("docs"))
    again = rows.join(kinds.filter(F.col("outside") > most), "sig").groupBy("doc").agg(F.collect_set("sig").alias("sigs"))  # a document's own signatures
    signed = texts.join(again.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "sigs").mapInArrow(_signed_again(n, percent), "sig long, doc long")
    more, still, _ = _groups_of(signed, most, "again")
    x, y = still.select("sig", "piece", "docs"), still.select("sig", F.col("piece").alias("other"), F.col("docs").alias("docs2"))
    every = x.join(y, "sig").filter("piece <= other").select(F.concat("docs", "docs2").alias("docs"))
    none = F.lit(None).cast("long")
    return groups.unionByName(more.unionByName(every.select(none.alias("low"), F.array_distinct("docs").alias("docs")), allowMissingColumns=True).select(none.alias("low"), "docs"))


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer than n make one shingle; a text
    without words, or null, has no shingles and is linked with nothing. component_id is the smallest
    doc_id reachable by links. A null doc_id takes part in nothing and gets null. Rows of one doc_id
    are one document with several texts: each links for it. Repeated rows give repeated results. No
    documents: no rows. Extra columns of docs are not read. ``most``: sets held against each other at once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = rows.filter("doc_id is not null")
    base = written(rows.mapInArrow(_identified(n), "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"), "sets")
    sets_of = base.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "h1", "h2")
    equal = written(sets_of.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").drop("last"), "equal")
    same = written(_with_small(sets_of, equal, ["n_shingles", "h1", "h2"], "inner").filter("doc_id <> rep").select("doc_id", "rep").distinct(), "same")

    own_sets = sets_of.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).filter("x = y")
    copies = written(same.select("doc_id").distinct().join(own_sets, "doc_id", "left_semi"), "copies")  # their class's least signs for them
    reps = _with_small(known, copies, "doc_id", "left_anti")
    groups, hot, cut = _groups_of(reps.mapInArrow(_signed(n, percent), "sig long, doc long"), most, "shared")
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    release(spark)  # the signatures' shuffle files

    info = base.filter("n_shingles > 0").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size"), "sketch")
    stars = groups.select("low", "docs").unionByName(hot.select("low", "docs")).select(F.col("low").alias("a"), F.explode("docs").alias("b")).filter("a <> b").distinct()
    stars = stars.join(info.toDF("b", "n", "y"), "b").join(info.toDF("a", "m", "x"), "a").select("a", "b", "m", "n", "x", "y")
    links = _verified(stars.mapInArrow(_near(percent), "a long, b long").distinct(), known, n, percent)
    links = links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))

    def joined(links: DataFrame) -> DataFrame:
        both = written(components(links), "components")
        return both.groupBy(F.col("node").alias("doc")).agg(F.min("component").alias("comp"))

    found = written(joined(links), "found")
    if hot.limit(1).count():
        more = written(_of_hot(hot, found, known, n, percent, most).withColumn("g", -1 - F.monotonically_increasing_id()), "groups")
        groups = groups.unionByName(more)
    dealt = groups.select("g", "low", F.explode("docs").alias("doc"))
    comp = dealt.join(found, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    apart = comp.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("g")
    comp = written(comp.join(apart, "g", "left_semi").withColumn("low", F.coalesce("low", F.col("g") - (1 << 62))), "apart")

    def blocks(rows: DataFrame, rest: bool) -> DataFrame:
        # groups of one low go together, as far as a task's share of rows allows
        shares = rows.groupBy("low").count().select("low", F.ceil(F.col("count") / SHARE).cast("int").alias("shares"))
        dealt = _with_small(rows, written(shares.filter("shares > 1"), "shares"), "low", "left").withColumn("share", F.pmod(F.xxhash64("g"), F.coalesce("shares", F.lit(1))))
        wide = dealt.join(info, "doc").repartition("low", "share").sortWithinPartitions("low", "g", "size", "doc")
        return wide.select("g", "doc", "low", "size", "sketch", "comp", "now").mapInArrow(_blocks(percent, rest), "g long, a long, b long")

    first = written(blocks(comp.withColumn("now", F.col("comp")), rest=False), "forest")
    release(spark)
    links = links.unionByName(_verified(first.filter("a is not null").select("a", "b").distinct(), known, n, percent))
    found = written(joined(links), "found")
    more = written(first.filter("a is null").select("g"), "more")
    if more.limit(1).count():
        still = comp.join(more, "g", "left_semi").join(found.withColumnRenamed("comp", "now"), "doc", "left").withColumn("now", F.coalesce("now", "doc"))
        left = _verified(blocks(still, rest=True).select("a", "b").distinct(), known, n, percent)
        if left.limit(1).count():
            found = written(joined(links.unionByName(left)), "found")
    for table in (cut, groups, comp, first, more, equal, same, copies):  # the result reads base and found
        drop_written(table)
    return base.join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is their class's least; null doc_ids stay."""
    (name,) = free_names(docs, "_gone")
    gone = similar_classes(docs, n, percent, doc_id, text).filter("component_id <> doc_id").select(F.col("doc_id").alias(name))
    gone = written(gone.distinct(), "gone")
    match = F.col(doc_id).cast("long") == F.col(name)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, match, "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
