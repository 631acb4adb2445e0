"""Connected components of a link table, by alternating stars; every round is staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import few_files, small, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another.

    Each round hangs the neighbours of a node on the smallest of them, first the larger ones,
    then the smaller ones; a few rounds suffice whatever the shape. A hub's links are pre-aggregated
    for its minimum, and the staged minima are joined back: broadcast while they are few, else both
    sides of that join are plain exchanges, which Spark splits where a hub's links fill one
    partition. No table of a round has more than twice the rows of the links before it, so few
    links take few tasks, however many partitions a shuffle has.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    edges = stage(few_files(edges, links.count()), "links")
    before = _state(edges)
    while True:
        rows = 2 * before[0]
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(few_files(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows), "links-least")
        large = both.filter("v > u").join(small(least, 16, rows=rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = stage(few_files(large, rows), "links")
        least = stage(few_files(large.groupBy("u").agg(F.min("v").alias("m")), rows), "links-least")
        smaller = large.join(small(least, 16, rows=rows), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(few_files(smaller.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), rows), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of the links and a sum that tells one set of them from another."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
