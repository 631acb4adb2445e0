"""Run comparisons (A12-A14, J8, W5, W6, E6): per-case timing, A/B speed-ups, geometric
means, shares of a total and thread-concurrency measures, as aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.operators.quantile import with_median
from orthoflow.session import scratch_dir


def case_timing(runs: DataFrame, keys: list[str], elapsed: str, testcases: str, sweeps: str,
                exact: bool = True) -> DataFrame:
    """Runs, mean and median elapsed, time per testcase and per sweep, sweeps per testcase."""
    e, t, s = F.col(elapsed), F.col(testcases), F.col(sweeps)
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("runs"), F.avg(e).alias("mean_elapsed"),
        F.percentile_approx(e, 0.5, 10000).alias("median_elapsed"), (F.sum(e) / F.sum(t)).alias("per_testcase"),
        (F.sum(e) / F.sum(s)).alias("per_sweep"), (F.sum(s) / F.sum(t)).alias("sweeps_per_testcase"))
    return with_median(out.drop("median_elapsed"), runs, keys, elapsed, "median_elapsed") if exact else out


def ab_join(timing: DataFrame, key: str, variant: str, base: str, new: str, metric: str) -> DataFrame:
    """Baseline vs changed per key; speed-up = base / new."""
    b = timing.filter(F.col(variant) == base).select(key, F.col(metric).alias("base_value"))
    n = timing.filter(F.col(variant) == new).select(key, F.col(metric).alias("new_value"))
    return b.join(n, key).withColumn("speedup", F.col("base_value") / F.col("new_value"))


def geo_mean(df: DataFrame, value: str) -> DataFrame:
    """Geometric and arithmetic mean of a positive column."""
    return df.agg(F.exp(F.avg(F.ln(F.col(value)))).alias("geo_mean"), F.avg(value).alias("arith_mean"),
                  F.count(F.lit(1)).cast("bigint").alias("n"))


def share_of_total(df: DataFrame, value: str, partition: list[str] | None = None) -> DataFrame:
    """100 * x / sum(x) over the (already aggregated, small) table or a partition of it."""
    w = Window.partitionBy(*(partition or []))
    return df.withColumn("share_pct", F.lit(100.0) * F.col(value) / F.sum(value).over(w))


def profile_distribution(df: DataFrame, keys: list[str], value: str, exact: bool = True) -> DataFrame:
    """Min / median / mean / max of a metric per variant."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.min(v).alias("min"), F.percentile_approx(v, 0.5, 10000).alias("median"), F.avg(v).alias("mean"),
                                F.max(v).alias("max"), F.count(v).cast("bigint").alias("n"))
    return with_median(out.drop("median"), df, keys, value) if exact else out


def ab_report(runs: DataFrame, key: str, variant: str, base: str, new: str, elapsed: str, testcases: str, sweeps: str,
              exact: bool = True) -> DataFrame:
    """Two runs compared in one table. A row per case (``level`` case): mean elapsed and time per
    testcase of both, speed-up of the mean and of the median, sweeps per testcase and whether they agree,
    each case's share of its run's total. A last row (``level`` all, case NULL): totals, and the geometric
    means of the speed-ups (with the arithmetic one of the mean's)."""
    timing = case_timing(runs, [variant, key], elapsed, testcases, sweeps, exact)
    totals = runs.groupBy(variant, key).agg(F.sum(elapsed).alias("total"))
    timing = timing.join(share_of_total(totals, "total", [variant]), [variant, key])
    measures = ("runs", "mean_elapsed", "median_elapsed", "per_testcase", "sweeps_per_testcase", "total", "share_pct")
    side = lambda name, prefix: timing.filter(F.col(variant) == name).select(key, *[F.col(m).alias(f"{prefix}_{m}") for m in measures])
    cases = side(base, "base").join(side(new, "new"), key)
    cases = cases.withColumns({
        "speedup": F.col("base_mean_elapsed") / F.col("new_mean_elapsed"),
        "median_speedup": F.col("base_median_elapsed") / F.col("new_median_elapsed"),
        "testcase_speedup": F.col("base_per_testcase") / F.col("new_per_testcase"),
        "same_sweeps": F.col("base_sweeps_per_testcase") == F.col("new_sweeps_per_testcase"),
    })
    geo = lambda c: F.exp(F.avg(F.ln(c))).alias(c)
    whole = cases.agg(F.count(F.lit(1)).alias("cases"), F.sum("base_runs").alias("base_runs"), F.sum("new_runs").alias("new_runs"), F.sum("base_total").alias("base_total"),
                      F.sum("new_total").alias("new_total"), geo("speedup"), geo("median_speedup"), geo("testcase_speedup"),
                      F.avg("speedup").alias("arith_speedup"), F.bool_and("same_sweeps").alias("same_sweeps"))
    return cases.withColumn("level", F.lit("case")).unionByName(whole.withColumn("level", F.lit("all")), allowMissingColumns=True)


#: starts of a bucket of intervals, about
BUSY_ROWS = 100_000


def _staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that its work is done once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def busy_intervals(intervals: DataFrame, group: str, thread: str, start: str, end: str, buckets: int | None = None) -> DataFrame:
    """Intervals of each thread with overlapping and touching ones joined, so that nested calls of
    one thread count once.

    The starts of all threads, in order, are dealt into ranges of about equal counts (one for each
    ``BUSY_ROWS`` of them, or ``buckets``), so a thread that holds nearly all intervals is spread over
    tasks and the work grows as the rows do. What reaches into a bucket is the running maximum of the
    ends of the buckets before it, a window over one row per thread and bucket; runs are numbered in
    two levels likewise. The intervals are read once.
    """
    keys = [group, thread]
    # intervals that begin together are one, up to the last end
    begun = _staged(intervals.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e")), "busy-begun")
    buckets = buckets or max(1, -(-begun.count() // BUSY_ROWS))
    # a range's number is written with its rows, so that later reads agree on it
    dealt = _staged(begun.repartitionByRange(buckets, *keys, "_s").withColumn("_b", F.spark_partition_id()), "busy-dealt")
    mine = F.col(group).eqNullSafe(F.col(f"_{group}")) & F.col(thread).eqNullSafe(F.col(f"_{thread}"))
    reach = dealt.groupBy(*keys, "_b").agg(F.max("_e").alias("_reach"))
    w_bucket = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = reach.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_bb"), F.max("_reach").over(w_bucket).alias("_carried"))
    w = Window.partitionBy(*keys, "_b").orderBy("_s")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    place = dealt.join(carried, mine & (F.col("_b") == F.col("_bb"))).drop("_bb", *[f"_{k}" for k in keys])
    place = place.withColumn("_far", F.greatest("_carried", F.max("_e").over(before)))
    place = place.withColumn("_new", F.when(F.col("_far").isNull() | (F.col("_s") > F.col("_far")), 1).otherwise(0))
    place = place.withColumn("_nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # within a bucket first, then runs that go on over buckets
    parts = place.groupBy(*keys, "_b", "_nth").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_new").alias("_new"))
    parts = _staged(parts, "busy-parts")
    total = parts.groupBy(*keys, "_b").agg(F.sum("_new").alias("_runs"))
    offset = total.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_bb"), F.coalesce(F.sum("_runs").over(w_bucket), F.lit(0)).alias("_off"))
    numbered = parts.join(offset, mine & (F.col("_b") == F.col("_bb")))
    return numbered.groupBy(*keys, (F.col("_off") + F.col("_nth")).alias("_run")).agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_run")


def thread_concurrency(intervals: DataFrame, group: str, thread: str, start: str, end: str, levels: tuple[int, ...] = (2, 4)) -> DataFrame:
    """W6 over host threads: ``concurrency`` of the threads' busy time, and ``threads``, how many
    there are. total_duration and intervals are those of the joined intervals."""
    busy = _staged(busy_intervals(intervals, group, thread, start, end), "busy")
    threads = busy.groupBy(group).agg(F.countDistinct(thread).alias("threads"))
    return concurrency(busy, group, start, end, levels).join(threads, group)


def concurrency(intervals: DataFrame, group: str, start: str, end: str, levels: tuple[int, ...] = (2, 4),
                buckets: int = 1024) -> DataFrame:
    """Sweep line per group over numeric [start, end) intervals.

    The +1/-1 events are summed per (group, time point) first. The running sum is then a
    two-level prefix sum: per-bucket totals (at most ``buckets`` rows per group) get their
    offsets from a small window, and the window over time points runs per (group, bucket),
    so one busy group is spread over many tasks instead of one.
    """
    ev = intervals.select(group, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(
        intervals.select(group, F.col(end).alias("t"), F.lit(-1).alias("d")))
    pts = _staged(ev.groupBy(group, "t").agg(F.sum("d").alias("d")), "concurrency-points")
    rng = pts.groupBy(group).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    width = F.greatest(F.lit(1.0), (F.col("_t1") - F.col("_t0") + 1) / F.lit(float(buckets)))
    pb = pts.join(rng, group).withColumn("_b", F.floor((F.col("t") - F.col("_t0")) / width).cast("bigint"))
    bsum = pb.groupBy(group, "_b").agg(F.sum("d").alias("_bd"), F.min("t").alias("_bfirst"))
    wb = Window.partitionBy(group).orderBy("_b")
    boff = bsum.select(group, "_b", F.sum("_bd").over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
                       F.lead("_bfirst").over(wb).alias("_next"))
    wt = Window.partitionBy(group, "_b").orderBy("t")
    active = pb.join(boff, [group, "_b"]).select(
        group, "t",
        (F.coalesce(F.col("_off"), F.lit(0)) + F.sum("d").over(wt.rowsBetween(Window.unboundedPreceding, 0))).alias("a"),
        (F.coalesce(F.lead("t").over(wt), F.col("_next")) - F.col("t")).alias("w"))
    dur = intervals.groupBy(group).agg(F.sum(F.col(end) - F.col(start)).alias("total_duration"),
                                       F.count(F.lit(1)).cast("bigint").alias("intervals"))
    span = (F.max("t") - F.min("t"))
    aggs = [span.alias("span"), F.max("a").alias("max_active"),
            (F.sum(F.coalesce(F.col("a") * F.col("w"), F.lit(0))) / span).alias("avg_active")]
    for lv in levels:
        aggs.append((F.sum(F.when(F.col("a") >= lv, F.col("w")).otherwise(0)) / span).alias(f"share_ge{lv}"))
    return active.groupBy(group).agg(*aggs).join(dur, group)
