"""Exact deduplication: binary-fuse filters of an immutable snapshot screen the digests of a new batch.

Digests that the filters pass join the snapshot's exact buckets; the rest can't be there. The new
batch's own copies are grouped separately, before it is screened, so a hot text is one digest.
Classes with several rows are then held against each other byte by byte: one row for each text that
a digest has, combined before the shuffle. A digest with two texts (a collision) is split by text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, free_names, written
from .textvec import mix

#: Digests in a filter, about.
BUCKET = 50_000
#: Digests of classes with several rows that may be broadcast; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


class BinaryFuse:
    """A static 3-wise binary fuse filter with 8-bit fingerprints: every key of the set passes; of others, about 1 in 256."""

    def __init__(self, seed: int, segment: int, count: int, prints: np.ndarray):
        self.seed, self.segment, self.count, self.prints = seed, segment, count, prints

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        """Length of a segment (a power of two) and number of segments where a key's first slot may be."""
        if n < 2:
            return 4, 1
        segment = min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        return segment, max(1, -(-int(n * factor) // segment) - 2)

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.array([seed], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = ((h >> np.uint64(32)) * np.uint64(count * segment) >> np.uint64(32)).astype(np.int64)
        low = segment - 1
        second = (first + segment) ^ ((h >> np.uint64(18)).astype(np.int64) & low)
        third = (first + 2 * segment) ^ (h.astype(np.int64) & low)
        return np.stack([first, second, third]), (mix(h) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """keys: 64-bit, distinct or not. Peels in rounds: slots with one key left give that key up."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment, count = cls._shape(n)
        size = (count + 2) * segment
        for seed in range(1, 200):
            slots, prints = cls._slots(keys, seed, segment, count)
            left = np.bincount(slots.ravel(), minlength=size)
            held = np.zeros(size, np.int64)  # xor of the numbers of a slot's keys
            for k in range(3):
                np.bitwise_xor.at(held, slots[k], np.arange(n))
            rounds, done = [], 0
            alone = np.flatnonzero(left == 1)
            while len(alone):
                owner, place = np.unique(held[alone], return_index=True)
                rounds.append((owner, alone[place]))
                done += len(owner)
                for k in range(3):
                    np.subtract.at(left, slots[k][owner], 1)
                    np.bitwise_xor.at(held, slots[k][owner], owner)
                touched = np.unique(slots[:, owner])
                alone = touched[left[touched] == 1]
            if done == n:
                out = np.zeros(size, np.uint8)
                for owner, place in reversed(rounds):
                    a, b, c = (out[slots[k][owner]] for k in range(3))
                    out[place] = prints[owner] ^ a ^ b ^ c ^ out[place]
                return cls(seed, segment, count, out)
            if seed % 20 == 0:
                count += 1
                size = (count + 2) * segment
        raise RuntimeError("no seed gives a filter")

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.count)
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == prints


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = BinaryFuse.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "seed": [made.seed], "segment": [made.segment], "count": [made.count], "prints": [made.prints.tobytes()]})


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(batch):
        return batch[["digest"]]
    if not len(filters):
        return batch[["digest"]][:0]
    f = filters.iloc[0]
    own = BinaryFuse(int(f["seed"]), int(f["segment"]), int(f["count"]), np.frombuffer(f["prints"], np.uint8))
    return batch[["digest"]][own.has(batch["key"].to_numpy(np.int64).view(np.uint64))]


def _bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return digests.select("digest", key.alias("key"), F.pmod(F.hash("digest"), F.lit(buckets)).alias("bucket"))


def filters_of(snapshot: DataFrame, buckets: int) -> DataFrame:
    """The filters of a snapshot's distinct digests: one row for each bucket."""
    return _bucketed(snapshot.select("digest"), buckets).groupBy("bucket").applyInPandas(_build, "bucket int, seed int, segment int, count int, prints binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's distinct digests that may be in the snapshot: all that are, and few others."""
    return _bucketed(batch.select("digest"), buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest string")


def normal(text: Column | str) -> Column:
    """The text without white space, null as empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, "")


def _best() -> list[Column]:
    # the most code points, then the smallest doc_id, nulls last
    return [F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best"), F.count("*").alias("n")]


def classes(docs: DataFrame, in_snapshot: Column | None = None, doc_id: str = "doc_id", text: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space ``[\\x20\\x09-\\x0D]``; null counts as empty. Of
    equal texts the row with the most code points stays, then the smallest doc_id (null last); of
    repeated rows, one. ``in_snapshot``: which rows are the immutable snapshot's; the rest are the new
    batch (by default a hash of doc_id deals them half and half; the result is the same). Both may be
    empty. Extra columns of docs are not read. digest_bits: fewer make collisions, for tests.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_old", F.coalesce(in_snapshot if in_snapshot is not None else F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0, F.lit(False)))
    rows = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col("_old").alias("old"))
    digest = F.sha2(normal("text"), 256)
    short = F.substring(digest, 1, digest_bits // 4)
    known = written(rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), digest.alias("sha"), short.alias("digest"), "old"), "digests")

    snapshot = written(known.filter("old").groupBy("digest").agg(*_best()), "snapshot")
    batch = written(known.filter("not old").groupBy("digest").agg(*_best()), "batch")
    buckets = max(1, -(-snapshot.count() // BUCKET))
    maybe = screen(batch, filters_of(snapshot, buckets), buckets)
    met = written(batch.join(maybe, "digest", "left_semi").join(snapshot.select("digest", F.col("best").alias("old_best"), F.col("n").alias("old_n")), "digest"), "met")
    merged = met.select("digest", F.least("best", "old_best").alias("best"), (F.col("n") + F.col("old_n")).alias("n"))
    several = merged.unionByName(snapshot.filter("n > 1").join(met, "digest", "left_anti")).unionByName(batch.filter("n > 1").join(met, "digest", "left_anti"))
    several = written(several, "several")

    small = several.count() <= BROADCAST_DIGESTS
    some = several.select("digest")
    texts = rows.select(normal("text").alias("plain")).withColumn("digest", F.substring(F.sha2("plain", 256), 1, digest_bits // 4))
    texts = texts.join(F.broadcast(some) if small else some, "digest", "left_semi")
    collided = texts.groupBy("digest", "plain").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    collided = written(collided, "collided")
    keyed = known.select("doc_id", "points", "sha", "digest")
    if collided.limit(1).count():
        # by whole texts, apart: the key is the text itself
        mixed = rows.withColumns({"plain": normal("text"), "points": F.length(F.coalesce("text", F.lit("")))}).withColumn("sha", F.sha2("plain", 256)).withColumn("digest", F.substring("sha", 1, digest_bits // 4)).join(collided, "digest", "left_semi")
        own = mixed.groupBy("plain").agg(*_best())
        apart = mixed.select("doc_id", "points", "sha", "plain").join(own, "plain").withColumn("digest", F.col("plain")).drop("plain")
        rest = keyed.join(collided, "digest", "left_anti")
        several = several.join(collided, "digest", "left_anti")
    else:
        apart, rest = None, keyed
    found = rest.join(F.broadcast(several) if small else several, "digest", "left")
    if apart is not None:
        found = found.unionByName(apart.select(found.columns))
    alone = F.col("n").isNull() | (F.col("n") == 1)
    is_best = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.p") == -F.col("points"))
    out = found.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.when(alone, 1).otherwise(F.col("n")).cast("long").alias("group_size"), (alone | is_best).alias("kept"), F.col("sha").alias("text_sha256"), alone.alias("alone"))
    # rows that are best in all respects are repeats of one row: the first of them stays
    best = out.filter("kept and not alone")
    once = best.withColumn("kept", F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")) == 1)
    return out.filter("not kept or alone").unionByName(once).drop("alone")


def kept_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay by classes()."""
    sha, key, gone_id, gone_sha = free_names(docs, "_sha", "_id", "_gone", "_gone_sha")
    found = written(classes(docs, doc_id=doc_id, text=text), "classes")
    gone = found.filter("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).distinct()
    once = found.filter("kept").select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    repeated = written(gone.intersect(once), "repeated")  # rows of which one stays and the like go
    gone = gone.subtract(repeated)
    rows = docs.withColumn(sha, F.sha2(normal(text), 256)).withColumn(key, F.col(doc_id).cast("long"))
    small = gone.count() <= BROADCAST_DIGESTS
    match = F.col(key).eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha))
    left = rows.join(F.broadcast(gone) if small else gone, match, "left_anti")
    if repeated.limit(1).count():
        left = left.join(repeated, match, "left_anti").unionByName(rows.join(repeated, match, "left_semi").dropDuplicates([key, sha]))
    return left.drop(sha, key)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents),
r AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY plain) AS group_size,
         row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY plain ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM r
"""
