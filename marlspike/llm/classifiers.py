"""Text classifiers of hashed features, trained with numpy on a bounded sample of labelled rows.

Features of a text: its words (runs of letters and digits, A-Z lower-cased), the beginnings of its
words, and, for quality, the shapes of its white-space separated tokens; each counts once in a text.
Whole texts are read, in training too. The driver gets the features of at most ``most`` rows of each
kind, those of least hash, so what it holds is bounded whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_names, written
from .textvec import LOWER, SPACE_BYTES, mix, pieces, run_hashes, spans, utf8_buffers

#: Hashed features.
BITS = 19
_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_PREFIXES = (4, 5)


def _codes(data: np.ndarray, offsets: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of every occurrence."""
    own = data[offsets[0] : offsets[-1]]
    starts, ends, counts = spans(data, offsets, _SPLIT)
    doc = np.repeat(np.arange(len(counts)), counts)
    code = LOWER[own]
    docs, hashes = [doc], [run_hashes(code, starts, ends)]
    for k in _PREFIXES:
        long = ends - starts >= k
        docs.append(doc[long])
        hashes.append(mix(run_hashes(code, starts[long], starts[long] + k) + np.uint64(k)))
    if shapes and len(own):
        starts, ends, counts = spans(data, offsets, SPACE_BYTES)
        kind = _SHAPE[own]
        turn = np.empty(len(own), bool)  # a shape is the token's classes, runs of one class as one
        turn[0] = True
        turn[1:] = kind[1:] != kind[:-1]
        turn[starts] = True
        kept = np.flatnonzero(turn)
        at, to = np.searchsorted(kept, starts), np.searchsorted(kept, ends)
        docs.append(np.repeat(np.arange(len(counts)), counts))
        hashes.append(mix(run_hashes(kind[kept], at, to) + np.uint64(99)))
    return np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _parts(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8_buffers(column)
    for a, b in pieces(np.diff(offsets).tolist()):
        yield a, b, data, offsets[a : b + 1]


def _features(shapes: bool):
    """Batches (label_id, y, text) -> (label_id, y, codes), each id once in a task: of several texts the least codes."""

    def run(batches):
        least: dict[int, tuple[bytes, int]] = {}  # ids of the sample: bounded
        for batch in batches:
            rows = []
            for a, b, data, offsets in _parts(batch.column(batch.schema.get_field_index("text"))):
                doc, code = _codes(data, offsets, shapes)
                both = np.unique(doc << BITS | code)
                rows += [x.astype("<i4").tobytes() for x in np.split(both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(1, b - a)))]
            for i, y, codes in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("label_id", "y")), rows, strict=True):
                least[i] = min(least.get(i, (codes, y)), (codes, y))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array([y for _, y in least.values()], pa.int32()), pa.array([c for c, _ in least.values()], pa.binary())], names=["label_id", "y", "codes"])

    return run


class Sample:
    """Features of rows, one row after another, and their labels. Only features count that tell rows
    above some label from the rest: by their shares' difference, ``clear`` standard errors at least,
    in ``least`` rows and a ``rare`` share of either side at least."""

    def __init__(self, codes: list[bytes], labels: list[int], least: int = 3, clear: float = 4.0, rare: float = 0.01):
        lists = [np.frombuffer(x, "<i4") for x in codes]
        self.y = np.array(labels, np.int64)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int32)
        every = np.bincount(flat, minlength=1 << BITS)
        good = np.zeros(1 << BITS, bool)
        for k in range(1, int(self.y.max(initial=0)) + 1):
            high = self.y >= k
            n1, n0 = max(1, int(high.sum())), max(1, int((~high).sum()))
            a = np.bincount(flat[high[row]], minlength=1 << BITS)
            p1, p0, p = a / n1, (every - a) / n0, every / (n1 + n0)
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
            good |= (np.abs(p1 - p0) >= clear * error) & (np.maximum(p1, p0) >= rare)
        keep = (good & (every >= least))[flat]
        self.used, self.code = np.unique(flat[keep], return_inverse=True)
        self.row = row[keep]
        self.n = len(lists)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.code], minlength=self.n)

    def gradient(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.code, by_row[self.row], minlength=len(self.used))

    def spread(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.used] = weights
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class _Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def nnpu_risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of scores z of positive and unlabelled rows: prior * R(positives as 1); R(unlabelled as 0) - prior *
    R(positives as 0), which is the negatives' part and may fall below zero; and the gradients of both by z."""
    unl = ~positive
    n_pos, n_unl = max(1, positive.sum()), max(1, unl.sum())
    p = _sigmoid(z)
    as_1 = prior * np.logaddexp(0, -z)[positive].sum() / n_pos
    as_0 = np.logaddexp(0, z)  # of a row taken as 0
    rest = as_0[unl].sum() / n_unl - prior * as_0[positive].sum() / n_pos
    return float(as_1), float(rest), np.where(positive, prior * (p - 1) / n_pos, 0), np.where(unl, p / n_unl, -prior * p / n_pos)


def estimated_prior(scores: np.ndarray, positive: np.ndarray, least: float = 0.2) -> float:
    """The class prior from scores of rows that weren't learnt from: no more than prior * P(score > t | positive)
    of unlabelled rows can lie above t for being positive, so the least ratio of both shares, the first with a
    standard error added, bounds the prior; t leaves at least a ``least`` share of positives above."""
    p, u = np.sort(scores[positive])[::-1], np.sort(scores[~positive])
    if not len(p) or not len(u):
        return 0.5
    k = np.arange(max(1, int(np.ceil(least * len(p)))), len(p) + 1)
    above_p, above_u = k / len(p), 1 - np.searchsorted(u, p[k - 1], side="left") / len(u)
    high = above_u + np.sqrt(above_u * (1 - above_u) / len(u)) + 1 / len(u)
    return float(np.clip((high / above_p).min(), 0.001, 0.95))


def fit_nnpu(sample: Sample, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and intercept by the non-negative positive-unlabelled risk. sample.y: 1 confirmed, 0 unlabelled.

    Risk: prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)), logistic
    loss. Where the second part is below zero, the step goes against its gradient instead of along the
    risk's. ``decay``: share of the weights taken off at a step, in units of the rate.
    """
    w, b = np.zeros(len(sample.used)), float(np.log(prior / (1 - prior)))
    adam = _Adam(len(w) + 1, rate)
    for _ in range(steps):
        _, rest, as_1, as_0 = nnpu_risk(sample.scores(w) + b, sample.y == 1, prior)
        by_row = as_1 + as_0 if rest >= 0 else -as_0
        move = adam.step(np.append(sample.gradient(by_row), by_row.sum()))
        w -= move[:-1]
        b -= move[-1]
        w -= rate * decay * w
    return w, b


def ordinal_loss(z: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood of grades y, P(grade > k) = sigmoid(z - cuts[k]), and its gradients by z and cuts."""
    tail = np.concatenate([np.ones((len(y), 1)), _sigmoid(z[:, None] - cuts), np.zeros((len(y), 1))], axis=1)
    slope = tail * (1 - tail)
    rows = np.arange(len(y))
    chance = np.maximum(tail[rows, y] - tail[rows, y + 1], 1e-12)
    by_row = -(slope[rows, y] - slope[rows, y + 1]) / chance / len(y)
    by_cut = np.array([((slope[:, k + 1] / chance)[y == k + 1].sum() - (slope[:, k + 1] / chance)[y == k].sum()) / len(y) for k in range(len(cuts))])
    return float(-np.log(chance).mean()), by_row, by_cut


def fit_ordinal(sample: Sample, grades: int, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds of the cumulative logit link: P(grade > k) = sigmoid(z - threshold k).

    Thresholds are the first and the logarithms of the gaps after it, so they stay in order.
    """
    y = sample.y
    share = np.clip([(y > k).mean() for k in range(grades - 1)], 1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 0.05))
    w = np.zeros(len(sample.used))
    adam = _Adam(len(w) + grades - 1, rate)
    for _ in range(steps):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        _, by_row, by_cut = ordinal_loss(sample.scores(w), cuts, y)
        by_gap = np.array([by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(grades - 2)])
        move = adam.step(np.concatenate([sample.gradient(by_row), [by_cut.sum()], by_gap]))
        w -= move[: len(w)]
        first -= move[len(w)]
        gaps = np.clip(gaps - move[len(w) + 1 :], -4, 4)
        w -= rate * decay * w
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def _sampled(docs: DataFrame, known: DataFrame, most: int, shapes: bool, doc_id: str, text: str) -> tuple[list[bytes], list[int]]:
    """Features of the ``most`` documents of known (label_id, y) of least hash, by that hash: bounded, so they are
    broadcast to the texts. Of several texts with one id the one of least codes counts."""
    some = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(F.col(doc_id).cast("long").alias("label_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "label_id").select("label_id", "y", "text")
    least: dict[int, tuple[bytes, int]] = {}
    for r in rows.mapInArrow(_features(shapes), "label_id long, y int, codes binary").collect():  # most rows, but for ids that come up in several tasks
        least[r["label_id"]] = min(least.get(r["label_id"], (bytes(r["codes"]), r["y"])), (bytes(r["codes"]), r["y"]))
    return [least[i][0] for i in sorted(least)], [least[i][1] for i in sorted(least)]


def _raw(docs: DataFrame, weights: np.ndarray, shapes: bool, doc_id: str, text: str, carry: str | None = None) -> DataFrame:
    """doc_id and the sum z of the weights of the features that each whole text has; with ``carry``, all columns of docs and z under that name."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers, whatever the corpus

    def run(batches):
        w = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, data, offsets in _parts(batch.column(batch.schema.get_field_index(text if carry else "text"))):
                doc, code = _codes(data, offsets, shapes)
                hit = w[code] != 0
                both = np.unique(doc[hit] << BITS | code[hit])
                out[a:b] = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], minlength=b - a)
            if carry:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, carry])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out)], names=["doc_id", "z"])

    if carry:
        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(carry, DoubleType())]))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, z double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, grade: Column) -> DataFrame:
    """(label_id, y) of the documents that may be learnt from; repeated labels of one count as their highest."""
    own = labels.select(F.col("doc_id").cast("long").alias("label_id"), grade.cast("int").alias("y")).filter("y is not null").filter(~held_out(F.col("label_id")))
    ids = docs.select(F.col(doc_id).cast("long").alias("label_id"))
    return written(own.groupBy("label_id").agg(F.max("y").alias("y")).join(ids, "label_id", "left_semi"), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, prior: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, by non-negative positive-unlabelled learning.

    Learns only from rows whose crc32 of doc_id as text isn't a multiple of 5: at most
    ``most_positive`` with toxic = 1 (confirmed), and at most ``most_unlabelled`` of all documents, with
    or without a label, as unlabelled text. No label of a document that isn't toxic is used. The class
    prior, unless given, is estimated from a quarter of this sample that a first fit leaves out. Scores come from whole texts alone; null and empty ones get the intercept's. Without
    toxic rows to learn from, every score is 0; labels that are null don't count. Repeated rows give
    repeated results; null doc_ids aren't held out and have no label. Extra columns are not read.
    """
    model = _toxicity_model(docs, labels, most_positive, most_unlabelled, prior, doc_id, text)
    if model is None:
        return docs.select(F.col(doc_id).cast("long").alias("doc_id")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    score = 1 / (1 + F.exp(-(F.col("z") + F.lit(model[1]))))
    return _raw(docs, model[0], False, doc_id, text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000, prior: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that toxicity() doesn't predict to be toxic."""
    model = _toxicity_model(docs, labels, most_positive, most_unlabelled, prior, doc_id, text)
    if model is None:
        return docs
    (z,) = free_names(docs, "z")
    return _raw(docs, model[0], False, doc_id, text, carry=z).filter(F.col(z) + F.lit(model[1]) < 0).drop(z)


def _toxicity_model(docs: DataFrame, labels: DataFrame, most_positive: int, most_unlabelled: int, prior: float | None, doc_id: str, text: str) -> tuple[np.ndarray, float] | None:
    known = _labelled(docs, labels, doc_id, F.col("toxic")).filter("y = 1")
    a, _ = _sampled(docs, known, most_positive, False, doc_id, text)
    if not a:
        return None
    ids = docs.select(F.col(doc_id).cast("long").alias("label_id")).filter("label_id is not null").filter(~held_out(F.col("label_id"))).distinct()
    b, _ = _sampled(docs, ids.withColumn("y", F.lit(0)), most_unlabelled, False, doc_id, text)
    codes, y = a + b, np.array([1] * len(a) + [0] * len(b))
    if prior is None:
        aside = np.arange(len(y)) % 4 == 0
        first = Sample([x for x, out in zip(codes, aside, strict=True) if not out], y[~aside].tolist())
        w, c = fit_nnpu(first, 0.1)
        prior = estimated_prior(_scored([x for x, out in zip(codes, aside, strict=True) if out], first.spread(w)), y[aside] == 1)
    sample = Sample(codes, y.tolist())
    w, c = fit_nnpu(sample, prior)
    return sample.spread(w), float(c)


def _scored(codes: list[bytes], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[np.frombuffer(x, "<i4")].sum() for x in codes])


def quality(docs: DataFrame, labels: DataFrame, grade: Column | None = None, grades: int = 3, keep_grade: int = 1, most: int = 12000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of keep_grade or better), kept (0.5 or more).

    Cumulative-link regression on grades 0..grades-1, by default 0: quality 0, 1: quality 1 but toxic,
    2: quality 1 and not toxic. Learns from at most ``most`` labelled rows that aren't held out, as
    toxicity() does. Null and empty texts have no features and get the thresholds' own grade. Without
    labelled rows every document is kept, with grade null. Repeated rows give repeated results.
    """
    if grade is None:
        grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    known = _labelled(docs, labels, doc_id, grade)
    codes, y = _sampled(docs, known, most, True, doc_id, text)
    if not y:
        return docs.select(F.col(doc_id).cast("long").alias("doc_id")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    sample = Sample(codes, np.clip(y, 0, grades - 1).tolist())
    w, cuts = fit_ordinal(sample, grades)
    raw = _raw(docs, sample.spread(w), True, doc_id, text)
    tails = [1 / (1 + F.exp(F.lit(float(c)) - F.col("z"))) for c in cuts]
    expected = tails[0]
    for t in tails[1:]:
        expected = expected + t
    return raw.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), expected.alias("expected_grade"), tails[keep_grade - 1].alias("tail_probability")).withColumn("kept", F.col("tail_probability") >= 0.5)
