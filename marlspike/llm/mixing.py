"""Mixing sources to target weights by capped water-filling, and seeded whole and fractional repetitions.

Sources share all words by weight; a source stops at ``epochs`` times its own words and what it
leaves is shared again, by weight, until none is above. A source's documents then repeat as often as
its target holds its words, and what is left of the target is filled with whole documents in a seeded
order: each that still fits, until none does. Into the gap then goes the one other document whose size
is nearest to it, if that comes nearer to the target. The order is cut into buckets; only the buckets
where a source's target ends, or its gap is filled, are sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, word_count, written

#: Documents in a bucket of the seeded order, about.
BUCKET = 20_000
#: Documents of a source that a round of the refill scans, about; a bucket with more is scanned as one.
SCAN = 1_000


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """sources (source, words) -> (source, words, weight, target). Sources in code point order, null last,
    weigh as ``weights``, repeating. A round is one aggregate over the sources, which stay distributed."""
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    placed = written(placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(order))), "sources")
    before, base = 0, {}
    for r in sorted(placed.groupBy("part").count().collect()):  # a row for each partition
        base[r["part"]] = before
        before += r["count"]
    start = F.create_map(*[F.lit(x) for kv in base.items() for x in kv]) if base else F.create_map(F.lit(0), F.lit(0))
    number = start[F.col("part")] + F.col("place") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long")
    weighed = written(placed.select("source", "words", weight.alias("weight")), "weights")
    total, all_weight = weighed.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = total / all_weight if all_weight else 0.0
    clamped = -1
    while True:
        full = F.col("words") * epochs < F.lit(share) * F.col("weight")
        n, words, weight = weighed.filter(full).agg(F.count("*"), F.coalesce(F.sum(F.col("words") * epochs), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n <= clamped or weight >= all_weight:
            break
        clamped, share = n, (total - words) / (all_weight - weight)
    target = F.when(F.col("words") * epochs < F.lit(share) * F.col("weight"), (F.col("words") * epochs).cast("double")).otherwise(F.lit(float(share)) * F.col("weight"))
    return weighed.withColumn("target", target)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken, repeats for every row of docs.

    ``size``: the words of the text (null: 0) unless given. taken = size * repeats; repeats is at most
    ``epochs``. Null sources are one source. Documents without words repeat as often as their source
    does wholly. The order is by md5 of seed and doc_id, then size: reruns and other splits agree.
    Repeated rows are documents of their own. No documents: no rows. Extra columns are not read.
    What a source misses is less than any of its documents that are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), (size if size is not None else word_count(F.col(text))).alias("size"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))), "sizes")
    digits = 1
    while 16**digits * BUCKET < rows.count() and digits < 8:
        digits += 1
    bucket = F.substring("h", 1, digits)
    sums = written(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("words")), weights, epochs)
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).withColumnRenamed("words", "own")
    plan = plan.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words")), F.lit(epochs))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("rest", F.when(F.col("whole") < epochs, F.col("target") - F.col("whole") * F.col("words")).otherwise(0.0))
    plan = plan.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "own", "words", "target", "whole", "rest")
    known = rows.withColumn("bucket", bucket).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("own") > F.col("rest"))
    clear = known.filter(~edge).withColumn("more", F.when((F.col("size") > 0) & (F.col("before") + F.col("own") <= F.col("rest")), 1).otherwise(0))
    upto = Window.partitionBy("s", "b").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    cut = known.filter(edge).withColumn("more", F.when((F.col("size") > 0) & (F.col("before") + F.sum("size").over(upto) <= F.col("rest")), 1).otherwise(0))
    dealt = written(clear.unionByName(cut).select("doc_id", "row", "h", "s", "size", "words", "target", "whole", "rest", "more"), "dealt")
    dealt = _refilled(dealt, bucket)
    gaps = dealt.groupBy("s").agg((F.first("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap")).filter("gap > 0").withColumnRenamed("s", "g")
    off = F.abs(F.col("size") - F.col("gap"))
    last = dealt.filter("more = 0 and size > 0").join(gaps, F.col("s").eqNullSafe(F.col("g"))).filter(off < F.col("gap")).groupBy("g").agg(F.min(F.struct(off.alias("off"), "h", "size", "row")).alias("pick")).select(F.col("pick.row").alias("row"), F.lit(1).alias("last"))
    repeats = (F.col("whole") + F.col("more") + F.coalesce("last", F.lit(0))).cast("int")
    return dealt.join(last, "row", "left").select("doc_id", "size", F.col("words").cast("long").alias("source_size"), "target", (F.col("size") * repeats).cast("long").alias("taken"), repeats.alias("repeats"))


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a source's next buckets that fit into its gap, each taken in order if it still does."""
    pdf = pdf.sort_values(["h", "size", "row"])
    room, took = float(pdf["room"].iloc[0]), []
    for row, size in zip(pdf["row"], pdf["size"], strict=True):
        if size <= room:
            room -= size
            took.append(row)
    return pd.DataFrame({"row": pd.Series(took, dtype="int64")})


def _refilled(dealt: DataFrame, bucket: Column) -> DataFrame:
    """dealt with ``more`` set for all documents that a walk along the seeded order finds to fit.

    A round takes a source's buckets whole while all that is small enough in them fits, then scans the
    next ones; it goes on behind them, with documents of at most the gap that is left, until there are none.
    """
    open_ = dealt.filter("more = 0 and size > 0").select("s", "h", "size", "row", bucket.alias("b"))
    gaps = written(dealt.groupBy("s").agg((F.first("rest") - F.sum(F.col("size") * F.col("more"))).alias("gap")).select(F.col("s").alias("g"), "gap", F.lit("").alias("upto")).filter("gap > 0"), "gaps")
    run, ahead = Window.partitionBy("g").orderBy("b"), Window.partitionBy("g", "clear").orderBy("b")
    taken = None
    while True:
        left = open_.join(gaps, F.col("s").eqNullSafe(F.col("g")) & (F.col("b") > F.col("upto")) & (F.col("size") <= F.col("gap")))
        sums = left.groupBy("g", "gap", "b").agg(F.sum("size").alias("own"), F.count("*").alias("n"))
        sums = sums.withColumn("to", F.sum("own").over(run)).withColumn("clear", F.col("to") <= F.col("gap"))
        sums = sums.withColumn("scan", ~F.col("clear") & ((F.row_number().over(ahead) == 1) | (F.sum("n").over(ahead) <= SCAN)))
        room = F.col("gap") - F.coalesce(F.max(F.when(F.col("clear"), F.col("to"))).over(Window.partitionBy("g")), F.lit(0))
        plan = written(sums.withColumn("room", room).filter("clear or scan").select(F.col("g").alias("pg"), F.col("b").alias("pb"), "clear", "room"), "round")
        if not plan.limit(1).count():
            break
        met = left.join(plan, F.col("g").eqNullSafe(F.col("pg")) & (F.col("b") == F.col("pb"))).select("s", "h", "size", "row", "room", "clear")
        scanned = met.filter("not clear").groupBy("s").applyInPandas(_scan, "row long")
        new = written(met.filter("clear").select("row").unionByName(scanned), "taken")
        spent = open_.join(new, "row").groupBy(F.col("s").alias("ns")).agg(F.sum("size").alias("spent"))
        seen = plan.groupBy("pg").agg(F.max("pb").alias("pb"))
        gaps = gaps.join(seen, F.col("g").eqNullSafe(F.col("pg"))).join(spent, F.col("g").eqNullSafe(F.col("ns")))
        gaps = written(gaps.select("g", (F.col("gap") - F.col("spent")).alias("gap"), F.col("pb").alias("upto")).filter("gap > 0"), "gaps")
        taken = new if taken is None else taken.unionByName(new)
    if taken is None:
        return dealt
    return written(dealt.join(taken.withColumn("refill", F.lit(1)), "row", "left").withColumn("more", F.coalesce("refill", "more")).drop("refill"), "refilled")


#: Rows of (doc_id, repeats) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() repeats it; rows of one doc_id as
    often as the most repeated of them."""
    key, repeats, copy = free_names(docs, "_id", "_repeats", "_copy")
    dealt = written(mix(docs, weights, epochs, seed, doc_id, text, source).groupBy(F.col("doc_id").alias(key)).agg(F.max("repeats").alias(repeats)).filter(F.col(repeats) > 0), "repeats")
    small = dealt.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(dealt) if small else dealt, F.col(doc_id).cast("long").eqNullSafe(F.col(key)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), repeats))).drop(key, repeats, copy)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS words,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(words * 3) OVER w - words * 3 AS caps, sum(weight) OVER w - weight AS used,
         sum(words) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW w AS (ORDER BY words * 3.0 / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((total - caps)::DOUBLE / (weights - used)) FILTER (words * 3 >= (total - caps)::DOUBLE / (weights - used) * weight) AS share FROM o),
t AS (
  SELECT source, words, CASE WHEN words * 3 < share * weight THEN (words * 3)::DOUBLE ELSE share * weight END AS target
  FROM s, l),
p AS (
  SELECT *, CASE WHEN words > 0 THEN least(floor(target / words), 3) ELSE 0 END::BIGINT AS whole FROM t),
r AS (
  SELECT doc_id, d.source, h, size, words, target, whole, CASE WHEN whole < 3 THEN target - whole * words ELSE 0 END AS rest,
         row_number() OVER (PARTITION BY d.source, size > 0 ORDER BY h, size) AS place
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
f AS (
  SELECT source, 0::BIGINT AS place, max(rest) AS room, 0 AS took FROM r GROUP BY source
  UNION ALL
  SELECT f.source, r.place, f.room - CASE WHEN r.size <= f.room THEN r.size ELSE 0 END, CASE WHEN r.size <= f.room THEN 1 ELSE 0 END
  FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source AND r.place = f.place + 1 AND r.size > 0),
e AS (SELECT source, min(room) AS gap FROM f GROUP BY source),
g AS (
  SELECT r.*, CASE WHEN r.size > 0 THEN f.took ELSE 0 END AS more, e.gap
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
  LEFT JOIN f ON r.source IS NOT DISTINCT FROM f.source AND r.place = f.place),
k AS (
  SELECT *, CASE WHEN more = 0 AND size > 0 AND abs(size - gap) < gap THEN 1 ELSE 0 END AS fits FROM g),
n AS (
  SELECT *, CASE WHEN fits = 1 AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - gap), h, size) = 1 THEN 1 ELSE 0 END AS last FROM k),
x AS (SELECT *, whole + more + last AS repeats FROM n)
SELECT doc_id, size, words AS source_size, target, (size * repeats)::BIGINT AS taken, repeats::INTEGER AS repeats FROM x
"""
