"""Driver queries of run comparisons: lineitem rows as runs, case = flag x status,
variant 'base' / 'fused' by order-key parity (the two halves)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import compare
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register

RUNS_SQL = """runs AS (SELECT l_returnflag || l_linestatus AS "case",
  CASE WHEN l_orderkey % 2 = 0 THEN 'base' ELSE 'fused' END AS variant,
  l_extendedprice AS elapsed_ms, l_quantity AS testcases, l_quantity * l_linenumber AS sweeps FROM lineitem)"""

TIMING_SQL = RUNS_SQL + """,
timing AS (SELECT variant, "case", CAST(COUNT(*) AS BIGINT) AS runs, AVG(elapsed_ms) AS mean_elapsed,
  MEDIAN(elapsed_ms) AS median_elapsed, SUM(elapsed_ms) / SUM(testcases) AS per_testcase,
  SUM(elapsed_ms) / SUM(sweeps) AS per_sweep, SUM(sweeps) / SUM(testcases) AS sweeps_per_testcase
  FROM runs GROUP BY 1, 2)"""


def runs(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("case"),
                     F.when(F.col("l_orderkey") % 2 == 0, "base").otherwise("fused").alias("variant"),
                     F.col("l_extendedprice").alias("elapsed_ms"), F.col("l_quantity").alias("testcases"),
                     (F.col("l_quantity") * F.col("l_linenumber")).alias("sweeps"))


def _timing(spark, sf_dir):
    return compare.case_timing(runs(spark, sf_dir), ["variant", "case"], "elapsed_ms", "testcases", "sweeps")


def _r(c, d=6):
    return F.round(c, d).alias(c if isinstance(c, str) else None)


@register("case_timing", "WITH " + TIMING_SQL + """
SELECT variant, "case", runs, ROUND(mean_elapsed, 4) AS mean_elapsed, ROUND(median_elapsed, 4) AS median_elapsed,
  ROUND(per_testcase, 6) AS per_testcase, ROUND(per_sweep, 6) AS per_sweep, ROUND(sweeps_per_testcase, 6) AS sweeps_per_testcase
FROM timing""")
def case_timing(spark, sf_dir):
    """Per variant and case."""
    t = _timing(spark, sf_dir)
    return t.select("variant", "case", "runs", F.round("mean_elapsed", 4).alias("mean_elapsed"),
                    F.round("median_elapsed", 4).alias("median_elapsed"), F.round("per_testcase", 6).alias("per_testcase"),
                    F.round("per_sweep", 6).alias("per_sweep"), F.round("sweeps_per_testcase", 6).alias("sweeps_per_testcase"))


AB_SQL = TIMING_SQL + """,
ab AS (SELECT b."case", b.mean_elapsed AS base_value, n.mean_elapsed AS new_value, b.mean_elapsed / n.mean_elapsed AS speedup
       FROM timing b JOIN timing n ON b."case" = n."case" AND b.variant = 'base' AND n.variant = 'fused')"""


@register("ab_speedup", "WITH " + AB_SQL + """
SELECT "case", ROUND(base_value, 4) AS base_value, ROUND(new_value, 4) AS new_value, ROUND(speedup, 6) AS speedup FROM ab""")
def ab_speedup(spark, sf_dir):
    """Base vs fused mean elapsed per case."""
    ab = compare.ab_join(_timing(spark, sf_dir), "case", "variant", "base", "fused", "mean_elapsed")
    return ab.select("case", F.round("base_value", 4).alias("base_value"), F.round("new_value", 4).alias("new_value"),
                     F.round("speedup", 6).alias("speedup"))


@register("geo_mean", "WITH " + AB_SQL + """
SELECT ROUND(EXP(AVG(LN(speedup))), 6) AS geo_mean, ROUND(AVG(speedup), 6) AS arith_mean, CAST(COUNT(*) AS BIGINT) AS n FROM ab""")
def geo_mean(spark, sf_dir):
    """Geometric and arithmetic mean of the per-case speed-ups."""
    ab = compare.ab_join(_timing(spark, sf_dir), "case", "variant", "base", "fused", "mean_elapsed")
    g = compare.geo_mean(ab, "speedup")
    return g.select(F.round("geo_mean", 6).alias("geo_mean"), F.round("arith_mean", 6).alias("arith_mean"), "n")


@register("share_of_total", "WITH " + RUNS_SQL + """,
s AS (SELECT variant, "case", SUM(elapsed_ms) AS total FROM runs GROUP BY 1, 2)
SELECT variant, "case", ROUND(100.0 * total / SUM(total) OVER (PARTITION BY variant), 6) AS share_pct FROM s""")
def share_of_total(spark, sf_dir):
    """Each case's share of its variant's total time (window over the aggregated table)."""
    s = runs(spark, sf_dir).groupBy("variant", "case").agg(F.sum("elapsed_ms").alias("total"))
    return compare.share_of_total(s, "total", ["variant"]).select("variant", "case", F.round("share_pct", 6).alias("share_pct"))


@register("profile_distribution", "WITH " + RUNS_SQL + """
SELECT variant, MIN(elapsed_ms) AS min, MEDIAN(elapsed_ms) AS median, ROUND(AVG(elapsed_ms), 4) AS mean,
       MAX(elapsed_ms) AS max, CAST(COUNT(elapsed_ms) AS BIGINT) AS n FROM runs GROUP BY 1""")
def profile_distribution(spark, sf_dir):
    """Distribution of elapsed per variant."""
    d = compare.profile_distribution(runs(spark, sf_dir), ["variant"], "elapsed_ms")
    return d.select("variant", "min", "median", F.round("mean", 4).alias("mean"), "max", "n")


@register("ab_report", "WITH " + AB_SQL + """,
tot AS (SELECT variant, "case", SUM(elapsed_ms) AS total FROM runs GROUP BY 1, 2),
sh AS (SELECT variant, "case", total, 100.0 * total / SUM(total) OVER (PARTITION BY variant) AS share FROM tot),
c AS (SELECT b."case", b.runs AS base_runs, n.runs AS new_runs, b.mean_elapsed AS bm, n.mean_elapsed AS nm, b.median_elapsed / n.median_elapsed AS med,
  b.per_testcase AS bt, n.per_testcase AS nt, b.sweeps_per_testcase = n.sweeps_per_testcase AS same, sb.total AS btot, sn.total AS ntot, sb.share AS bs, sn.share AS ns
  FROM timing b JOIN timing n ON b."case" = n."case" AND b.variant = 'base' AND n.variant = 'fused'
  JOIN sh sb ON sb."case" = b."case" AND sb.variant = 'base' JOIN sh sn ON sn."case" = b."case" AND sn.variant = 'fused')
SELECT 'case' AS level, "case", CAST(NULL AS BIGINT) AS cases, base_runs, new_runs, ROUND(bm, 4) AS base_mean_elapsed, ROUND(nm, 4) AS new_mean_elapsed,
  ROUND(bt, 6) AS base_per_testcase, ROUND(nt, 6) AS new_per_testcase, ROUND(bs, 6) AS base_share_pct, ROUND(ns, 6) AS new_share_pct, ROUND(btot, 2) AS base_total, ROUND(ntot, 2) AS new_total,
  ROUND(bm / nm, 6) AS speedup, ROUND(med, 6) AS median_speedup, ROUND(bt / nt, 6) AS testcase_speedup, CAST(NULL AS DOUBLE) AS arith_speedup, same AS same_sweeps FROM c
UNION ALL
SELECT 'all', NULL, COUNT(*), CAST(SUM(base_runs) AS BIGINT), CAST(SUM(new_runs) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, ROUND(SUM(btot), 2), ROUND(SUM(ntot), 2),
  ROUND(EXP(AVG(LN(bm / nm))), 6), ROUND(EXP(AVG(LN(med))), 6), ROUND(EXP(AVG(LN(bt / nt))), 6), ROUND(AVG(bm / nm), 6), BOOL_AND(same) FROM c""")
def ab_report(spark, sf_dir):
    """Base against fused over all of lineitem, per case and in total, in one call."""
    r = compare.ab_report(runs(spark, sf_dir), "case", "variant", "base", "fused", "elapsed_ms", "testcases", "sweeps")
    places = {"base_mean_elapsed": 4, "new_mean_elapsed": 4, "base_per_testcase": 6, "new_per_testcase": 6, "base_share_pct": 6, "new_share_pct": 6, "base_total": 2, "new_total": 2,
              "speedup": 6, "median_speedup": 6, "testcase_speedup": 6, "arith_speedup": 6}
    return r.select("level", "case", "cases", "base_runs", "new_runs", *[F.round(c, d).alias(c) for c, d in places.items()], "same_sweeps")


_THREAD = "CASE WHEN o.o_orderkey % 10 <> 0 THEN 'thread 0' ELSE 'thread ' || CAST(o.o_custkey % 9 + 1 AS {s}) END"


@register("thread_concurrency", """
WITH iv AS (SELECT o.o_orderpriority AS process, """ + _THREAD.format(s="VARCHAR") + """ AS thread,
                   CAST(date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS BIGINT) * 100000 + o.o_orderkey % 100000 AS s,
                   CAST(date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS BIGINT) * 100000 + o.o_orderkey % 100000 + 2 + l.q AS e
            FROM orders o JOIN (SELECT l_orderkey, CAST(SUM(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey),
m AS (SELECT *, MAX(e) OVER (PARTITION BY process, thread ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
n AS (SELECT *, SUM(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY process, thread ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
busy AS (SELECT process, thread, MIN(s) AS s, MAX(e) AS e FROM n GROUP BY process, thread, run),
ev AS (SELECT process, s AS t, 1 AS d FROM busy UNION ALL SELECT process, e AS t, -1 AS d FROM busy),
pts AS (SELECT process, t, SUM(d) AS d FROM ev GROUP BY 1, 2),
act AS (SELECT process, t, SUM(d) OVER (PARTITION BY process ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
               LEAD(t) OVER (PARTITION BY process ORDER BY t) - t AS w FROM pts),
agg AS (SELECT process, MAX(t) - MIN(t) AS span, MAX(a) AS max_active, SUM(COALESCE(a * w, 0)) / (MAX(t) - MIN(t)) AS avg_active,
               SUM(CASE WHEN a >= 2 THEN w ELSE 0 END) / (MAX(t) - MIN(t)) AS share_ge2 FROM act GROUP BY 1)
SELECT process, CAST(span AS BIGINT) AS span, CAST(max_active AS BIGINT) AS max_active, ROUND(avg_active, 8) AS avg_active, ROUND(share_ge2, 8) AS share_ge2,
       (SELECT COUNT(DISTINCT thread) FROM iv WHERE iv.process = agg.process) AS threads,
       CAST((SELECT SUM(e - s) FROM busy WHERE busy.process = agg.process) AS BIGINT) AS total_duration,
       (SELECT COUNT(*) FROM busy WHERE busy.process = agg.process) AS intervals FROM agg""")
def thread_concurrency(spark, sf_dir):
    """W6 over threads: orders as calls of ten threads per priority, one of which makes nine tenths of
    them; a thread's overlapping calls count once."""
    q = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    o = fx.table(spark, sf_dir, "orders").alias("o").join(q, F.col("o.o_orderkey") == F.col("l_orderkey"))
    begin = F.expr(_DAY.format(c="o_orderdate")) * 100000 + F.col("o_orderkey") % 100000
    calls = o.select(F.col("o_orderpriority").alias("process"), F.expr(_THREAD.format(s="STRING")).alias("thread"), begin.cast("bigint").alias("s"), (begin + 2 + F.col("q")).cast("bigint").alias("e"))
    c = compare.thread_concurrency(calls, "process", "thread", "s", "e", levels=(2,))
    return c.select("process", F.col("span").cast("bigint").alias("span"), F.col("max_active").cast("bigint").alias("max_active"), F.round("avg_active", 8).alias("avg_active"),
                    F.round("share_ge2", 8).alias("share_ge2"), "threads", F.col("total_duration").cast("bigint").alias("total_duration"), "intervals")


_DAY = "CAST(datediff(CAST({c} AS DATE), DATE '1970-01-01') AS BIGINT)"


@register("concurrency_profile", """
WITH iv AS (SELECT o.o_orderpriority AS thread, CAST(date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS BIGINT) AS s,
                   CAST(date_diff('day', DATE '1970-01-01', CAST(MAX(l.l_shipdate) AS DATE)) AS BIGINT) AS e
            FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderdate),
ev AS (SELECT thread, s AS t, 1 AS d FROM iv UNION ALL SELECT thread, e AS t, -1 AS d FROM iv),
pts AS (SELECT thread, t, SUM(d) AS d FROM ev GROUP BY 1, 2),
act AS (SELECT thread, t, SUM(d) OVER (PARTITION BY thread ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
               LEAD(t) OVER (PARTITION BY thread ORDER BY t) - t AS w FROM pts),
agg AS (SELECT thread, MAX(t) - MIN(t) AS span, MAX(a) AS max_active,
               SUM(COALESCE(a * w, 0)) / (MAX(t) - MIN(t)) AS avg_active,
               SUM(CASE WHEN a >= 2 THEN w ELSE 0 END) / (MAX(t) - MIN(t)) AS share_ge2,
               SUM(CASE WHEN a >= 4 THEN w ELSE 0 END) / (MAX(t) - MIN(t)) AS share_ge4 FROM act GROUP BY 1),
dur AS (SELECT thread, SUM(e - s) AS total_duration, COUNT(*) AS intervals FROM iv GROUP BY 1)
SELECT a.thread, CAST(span AS BIGINT) AS span, CAST(max_active AS BIGINT) AS max_active, ROUND(avg_active, 6) AS avg_active,
       ROUND(share_ge2, 6) AS share_ge2, ROUND(share_ge4, 6) AS share_ge4, CAST(total_duration AS BIGINT) AS total_duration,
       CAST(intervals AS BIGINT) AS intervals
FROM agg a JOIN dur d USING (thread)""")
def concurrency_profile(spark, sf_dir):
    """Order lifetimes (order date to last ship date) per priority as 'threads'."""
    o = fx.table(spark, sf_dir, "orders")
    li = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    iv = o.join(li, o.o_orderkey == li.l_orderkey).select(
        F.col("o_orderpriority").alias("thread"), F.expr(_DAY.format(c="o_orderdate")).alias("s"),
        F.expr(_DAY.format(c="last_ship")).alias("e"))
    c = compare.concurrency(iv, "thread", "s", "e")
    return c.select("thread", F.col("span").cast("bigint").alias("span"), F.col("max_active").cast("bigint").alias("max_active"),
                    F.round("avg_active", 6).alias("avg_active"), F.round("share_ge2", 6).alias("share_ge2"),
                    F.round("share_ge4", 6).alias("share_ge4"), F.col("total_duration").cast("bigint").alias("total_duration"),
                    "intervals")
