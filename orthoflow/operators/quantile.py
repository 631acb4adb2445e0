"""Exact medians by counting: no task holds the values of a group.

Values are counted per (group, value) first. A fixed number of cut points per group, from a
sketch, deals the distinct values into ranges; the ranges' totals tell which of them hold the two
middle ranks, and only those are looked at value by value. The cut points decide about the
spreading alone, the result is exact whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """keys, ``out``: the middle value, or the mean of the two middle ones, of the non-null values
    per group (null keys are groups as well); groups without values are left out."""
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(F.struct(*[F.col(k) for k in keys]).alias("_g"), v.alias("_v"))
    counts = rows.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    marks = [float(i) / CUTS for i in range(1, CUTS)]
    cuts = rows.groupBy("_g").agg(F.percentile_approx("_v", marks, 1000).alias("_cuts"), F.count(F.lit(1)).alias("_all"))
    dealt = counts.join(cuts, "_g").withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    totals = dealt.groupBy("_g", "_b", "_all").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # CUTS rows a group
    placed = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    holds = lambda rank: (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_t"))
    middle = placed.filter(holds(low) | holds(high)).select("_g", "_b", "_before", low.alias("_low"), high.alias("_high"))
    inside = Window.partitionBy("_g", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.select("_g", "_b", "_v", "_n").join(middle, ["_g", "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    at = lambda rank: F.min(F.when(F.col("_upto") >= F.col(rank), F.col("_v")))
    found = ranked.groupBy("_g").agg(at("_low").alias("_a"), F.min(F.when(F.col("_upto") >= F.col("_high"), F.col("_v"))).alias("_c"))
    return found.select(*[F.col(f"_g.{k}").alias(k) for k in keys], ((F.col("_a") + F.col("_c")) / 2).alias(out))


def with_median(aggregated: DataFrame, df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """``aggregated`` (one row per group) with the exact median; null where a group has no values."""
    found = exact_median(df, keys, value, out)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    for k, n in names.items():
        found = found.withColumnRenamed(k, n)
    same = None
    for k, n in names.items():
        here = F.col(k).eqNullSafe(F.col(n))
        same = here if same is None else same & here
    return aggregated.join(found, same, "left").drop(*names.values())
