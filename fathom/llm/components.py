"""Connected components of an edge table by alternating large and small stars, with tables written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import materialise


def _toward_least(pairs: DataFrame, path: str, rows: int) -> DataFrame:
    """(u, v, m) with the least of u and all its v. The least ones are a table, so that both sides of the join are plain exchanges: a hub's rows can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(materialise(least, path, rows), F.col("u") == F.col("k")).drop("k")


def _stars(now: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has a parent."""
    ends = now.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select(F.col("v").alias("k"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").take(1)


def components(edges: DataFrame, path: str) -> DataFrame:
    """edges: two columns of one orderable type; loops, nulls and repeats are dropped. Returns node and component, its least node, for every node with an
    edge. Rounds go on until all is done, and grow with the logarithm of the longest path; rows never exceed the edges."""
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{path}/cc-start")
    n, step = now.count(), 0
    while not _stars(now):
        at = f"{path}/cc-{step}"
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both, f"{at}-large-least", n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, f"{at}-large", n)
        small = _toward_least(large, f"{at}-small-least", n)
        now = materialise(small.select("u", F.col("m").alias("v")).unionAll(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), at, n)
        step += 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
