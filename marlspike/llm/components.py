"""Connected components over links, without collecting them: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b). Large: each node links its larger neighbours to the least of its neighbours and itself.
    Small: it links its smaller neighbours and itself to the least of them. The least comes from an
    aggregation that combines before the shuffle; the join back is one that can split a hot node."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if small:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is the smallest node reachable.

    Links with a null end, and of a node with itself, say nothing. No links: no rows. Repeated links
    and either direction are fine. Each round's links are a table in the shared folder.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), (x.isNotNull() & y.isNotNull() & (x != y)).alias("ok")).filter("ok").select("a", "b").distinct(), "links")
    seen = None
    for _ in range(rounds):
        large = _stars(edges, small=False)
        new = written(_stars(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), small=True), "links")
        drop_written(edges)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
