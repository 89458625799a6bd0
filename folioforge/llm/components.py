"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges with m, the least of their a. The second key gives the join shuffles of its own, so that Spark splits a node with very many edges."""
    key = F.hash("a")
    return edges.withColumn("z", key).join(least.withColumn("z", key), ["a", "z"]).drop("z")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a > b")


def components(edges: DataFrame) -> DataFrame:
    """a, root (the least node) of every node of the edges (a, b) but the roots themselves."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = mark(now)
    while state[0]:
        now = written(_small_star(_large_star(now).distinct()).distinct(), drop=[now])
        state, before = mark(now), state
        if state == before:
            break
    return now.select("a", F.col("b").alias("root"))
