"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.storage import erase, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node that has an edge, with the least node it is connected to.

    Every round hangs the neighbours of a node under the least of them, first the larger ones, then the smaller ones,
    until the edges form stars around the least nodes (O(log**2) rounds). Edges live in written tables; the driver sees
    only two numbers a round. A node with very many edges is aggregated partially and joined, so it can be split.
    Null ends and loops are ignored; ids may be numbers or strings.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    now, path = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = _mark(now)
    while True:
        before = path
        now, path = stored(_small_star(_large_star(now)), "edges")
        erase(now.sparkSession, before)
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
