"""Driver queries of the run-log ETL.

A run tree is rendered from ``events``: every event becomes one log line of the log
'<event_type>/<mode>/run_<day>.log'. The mode comes from user_id (mod 4) and the kind of
line from props.k (mod 10); these residues define the rendered data (which line a row
becomes), they never drop rows. Every event is also one row of its log's nsys and ncu exports.
The rendering is SQL text evaluated by both engines; the ETL itself is the library's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import logs
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"
MODE = ("CASE user_id % 4 WHEN 0 THEN 'timing' WHEN 1 THEN 'nsys' WHEN 2 THEN 'ncu-basic' "
        "ELSE 'ncu-deep' END")
CENTS = "CAST(ROUND(value * 100) AS BIGINT)"


def _run(d):
    return f"({fx.day_index_sql(d)} + 1)"


def _dec(x):
    return f"(CAST(CAST(FLOOR(({x}) / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(({x}) % 100 AS STRING), 2, '0'))"


def source_log_sql(d):
    return f"(event_type || '/' || {MODE} || '/run_' || CAST({_run(d)} AS STRING) || '.log')"


def line_sql(d):
    run = f"CAST({_run(d)} AS STRING)"
    return f"""(CASE {K} % 10
 WHEN 0 THEN '$ app in_' || CAST(user_id AS STRING) || '.mat out.mat --force --json-report'
 WHEN 1 THEN '==WARNING== slow sweep ' || CAST({K} % 3 AS STRING)
 WHEN 2 THEN '==ERROR== testcase ' || CAST({K} % 4 AS STRING) || ' failed'
 WHEN 3 THEN '==PROF== Profiling "kernel_' || CAST(user_id % 3 AS STRING) || '" - ' || CAST(event_id AS STRING)
             || ': 0%....50%....100% - ' || CAST({K} % 5 + 1 AS STRING) || ' passes'
 WHEN 4 THEN '==PROF== Report: /x/run_' || {run} || '.ncu-rep'
 WHEN 5 THEN '/tmp/prof/run_' || {run} || '.nsys-rep'
 WHEN 6 THEN 'elapsed_seconds=' || {_dec(CENTS)} || ' user_seconds=' || {_dec(CENTS + ' % 997')}
             || ' sys_seconds=' || {_dec(CENTS + ' % 89')} || ' max_rss_kb=' || CAST(event_id AS STRING)
 WHEN 7 THEN 'SKIPPED: ' || event_type
 WHEN 8 THEN 'Error: bad input ' || CAST({K} % 2 AS STRING)
 ELSE chr(27) || '[32m' || '{{"testcase_count": ' || CAST({K} AS STRING) || ', "total_sweeps": '
      || CAST(event_id % 50 AS STRING) || '}}' || chr(13) END)"""


def lines_sql():
    return (f"SELECT {source_log_sql('duckdb')} AS source_log, CAST(event_id AS BIGINT) AS line_no, "
            f"{line_sql('duckdb')} AS line FROM events")


def log_lines(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select(F.expr(source_log_sql("spark")).alias("source_log"),
                     F.col("event_id").cast("bigint").alias("line_no"), F.expr(line_sql("spark")).alias("line"))


def listing(spark, sf_dir):
    """The file listing of the tree: one artifact file per report line."""
    ev = fx.table(spark, sf_dir, "events").filter(F.expr(f"{K} % 10 = 4"))
    return ev.select(F.expr(listing_path_sql("spark")).alias("path"))


def listing_path_sql(d):
    return (f"(event_type || '/' || {MODE} || '/run_' || CAST({_run(d)} AS STRING) || "
            f"CASE {MODE} WHEN 'nsys' THEN '_nsys.nsys-rep' WHEN 'ncu-basic' THEN '_ncu_basic.ncu-rep' "
            f"WHEN 'ncu-deep' THEN '_ncu_deep.ncu-rep' ELSE '.txt' END)")


# ---- the same ETL written in DuckDB SQL ---------------------------------------------

_STRIP = ("regexp_replace(regexp_replace(line, chr(27) || '\\[[0-9;]*[A-Za-z]|' || chr(13), '', 'g'), "
          "'^\\s+|\\s+$', '', 'g')")
_PROF = '==PROF== Profiling "([^"]+)"\\s+-\\s+(\\d+):.*?-\\s+(\\d+)\\s+passes'
_REP = '==PROF== Report:\\s*(.+)'
_TIME = ("elapsed_seconds=([0-9.]+)\\s+user_seconds=([0-9.]+)\\s+sys_seconds=([0-9.]+)\\s+"
         "max_rss_kb=(\\d+)")

CLASSIFIED_SQL = f"""
lines AS ({lines_sql()}),
clean AS (SELECT source_log, line_no, {_STRIP} AS text FROM lines),
nonempty AS (SELECT * FROM clean WHERE text <> ''),
firstcmd AS (SELECT source_log, MIN(line_no) AS cmd_line FROM nonempty WHERE starts_with(text, '$ ') GROUP BY 1),
classified AS (
  SELECT n.source_log, n.line_no, n.text,
    CASE WHEN starts_with(n.text, '$ ') AND n.line_no = f.cmd_line THEN 'command'
         WHEN starts_with(n.text, 'SKIPPED:') OR contains(n.text, '==WARNING==') THEN 'warning'
         WHEN contains(n.text, '==ERROR==') OR starts_with(lower(n.text), 'error:') THEN 'error'
         WHEN regexp_matches(n.text, '{_PROF}') THEN 'profiling'
         WHEN regexp_matches(n.text, '{_REP}') THEN 'report'
         WHEN starts_with(n.text, '/') AND (ends_with(n.text, '.nsys-rep') OR ends_with(n.text, '.sqlite')) THEN 'generated'
         ELSE 'other' END AS class
  FROM nonempty n LEFT JOIN firstcmd f USING (source_log))"""


@register("log_classify", f"WITH {CLASSIFIED_SQL}\nSELECT source_log, line_no, text, class FROM classified")
def log_classify(spark, sf_dir):
    """Cleaned, classified log lines."""
    return logs.classify(log_lines(spark, sf_dir))


@register("kernel_launches", f"""WITH {CLASSIFIED_SQL}
SELECT source_log, regexp_extract(text, '{_PROF}', 1) AS kernel, CAST(COUNT(*) AS INTEGER) AS launches,
       CAST(SUM(CAST(regexp_extract(text, '{_PROF}', 3) AS INTEGER)) AS INTEGER) AS passes
FROM classified WHERE class = 'profiling' GROUP BY 1, 2""")
def kernel_launches(spark, sf_dir):
    """Launches and passes per kernel per log."""
    return logs.kernel_launches(logs.classify(log_lines(spark, sf_dir)))


@register("distinct_messages", f"""WITH {CLASSIFIED_SQL},
d AS (SELECT DISTINCT source_log, class AS kind, text AS message FROM classified WHERE class IN ('warning', 'error'))
SELECT source_log, kind, CAST(ROW_NUMBER() OVER (PARTITION BY source_log, kind ORDER BY message) - 1 AS INTEGER) AS pos,
       message FROM d""")
def distinct_messages(spark, sf_dir):
    """Sorted distinct warnings and errors per log, one row per message."""
    dm = logs.distinct_messages(logs.classify(log_lines(spark, sf_dir)))
    w = dm.select("source_log", F.lit("warning").alias("kind"), F.posexplode("warnings").alias("pos", "message"))
    e = dm.select("source_log", F.lit("error").alias("kind"), F.posexplode("errors").alias("pos", "message"))
    return w.unionByName(e).select("source_log", "kind", F.col("pos").cast("int").alias("pos"), "message")


@register("timing_fields", f"""WITH lines AS ({lines_sql()}),
t AS (SELECT source_log, line_no, regexp_extract(line, '{_TIME}', 1) AS e, regexp_extract(line, '{_TIME}', 2) AS u,
             regexp_extract(line, '{_TIME}', 3) AS s, regexp_extract(line, '{_TIME}', 4) AS m
      FROM lines WHERE regexp_matches(line, '{_TIME}') AND split_part(source_log, '/', 2) = 'timing'),
f AS (SELECT source_log, arg_min(struct_pack(e := e, u := u, s := s, m := m), line_no) AS v FROM t GROUP BY 1)
SELECT source_log, CAST(v.e AS DOUBLE) AS elapsed_seconds, CAST(v.u AS DOUBLE) AS user_seconds,
       CAST(v.s AS DOUBLE) AS sys_seconds, CAST(v.m AS BIGINT) AS max_rss_kb FROM f""")
def timing_fields(spark, sf_dir):
    """First timing line of every timing-mode log."""
    lines = log_lines(spark, sf_dir).filter(F.split("source_log", "/")[1] == "timing")
    return logs.timing_fields(lines)


def _records_sql():
    arts = " UNION ALL ".join(
        f"SELECT source_log, '{key}' AS key, regexp_extract(source_log, '^(.*)/[^/]+$', 1) || '/run_' || "
        f"CAST(run_index AS VARCHAR) || '{suffix}' AS path FROM logs_k WHERE mode = '{mode}' AND run_index IS NOT NULL"
        for mode, items in logs.ARTIFACTS.items() for key, suffix in items)
    return f"""WITH {CLASSIFIED_SQL},
logs_k AS (SELECT DISTINCT source_log, split_part(source_log, '/', 1) AS "case", split_part(source_log, '/', 2) AS mode,
           CAST(regexp_extract(split_part(source_log, '/', 3), '^run_([0-9]+)\\.log$', 1) AS INTEGER) AS run_index
           FROM classified),
listing AS (SELECT DISTINCT {listing_path_sql('duckdb')} AS path FROM events WHERE {K} % 10 = 4),
found AS (SELECT e.source_log, COUNT(*) AS n_art FROM ({arts}) e JOIN listing l USING (path) GROUP BY 1),
per AS (SELECT source_log,
          trim(arg_min(substr(text, 3), CASE WHEN class = 'command' THEN line_no END)) AS command,
          COUNT(DISTINCT CASE WHEN class = 'warning' THEN text END) AS n_warnings,
          COUNT(DISTINCT CASE WHEN class = 'error' THEN text END) AS n_errors,
          COUNT(CASE WHEN class = 'generated' THEN 1 END) AS n_generated,
          COUNT(CASE WHEN class = 'report' THEN 1 END) AS n_reports
        FROM classified GROUP BY 1),
rec AS (SELECT k."case", k.mode, k.run_index, k.source_log, p.command,
               p.n_warnings + CASE WHEN (k.mode = 'nsys' OR starts_with(k.mode, 'ncu-')) AND f.n_art IS NULL THEN 1 ELSE 0 END AS n_warnings,
               p.n_errors, p.n_generated,
               p.n_reports, COALESCE(f.n_art, 0) AS n_artifacts,
               CASE WHEN p.n_errors = 0 THEN 'ok' WHEN COALESCE(f.n_art, 0) > 0 THEN 'partial' ELSE 'failed' END AS status
        FROM logs_k k JOIN per p USING (source_log) LEFT JOIN found f USING (source_log))"""


def _records(spark, sf_dir):
    return logs.log_records(log_lines(spark, sf_dir), listing(spark, sf_dir))


ORACLES_RUN_STATUS = _records_sql() + """
SELECT "case", mode, run_index, source_log, command, CAST(n_warnings AS INTEGER) AS n_warnings,
       CAST(n_errors AS INTEGER) AS n_errors, CAST(n_generated AS INTEGER) AS n_generated,
       CAST(n_reports AS INTEGER) AS n_reports, CAST(n_artifacts AS INTEGER) AS n_artifacts, status FROM rec"""


@register("run_status", _records_sql() + """
SELECT "case", mode, run_index, source_log, command, CAST(n_warnings AS INTEGER) AS n_warnings,
       CAST(n_errors AS INTEGER) AS n_errors, CAST(n_generated AS INTEGER) AS n_generated,
       CAST(n_reports AS INTEGER) AS n_reports, CAST(n_artifacts AS INTEGER) AS n_artifacts, status FROM rec""")
def run_status(spark, sf_dir):
    """One record per log with its status."""
    r = _records(spark, sf_dir)
    return r.select("case", "mode", "run_index", "source_log", "command",
                    F.size("warnings").cast("int").alias("n_warnings"), F.size("errors").cast("int").alias("n_errors"),
                    F.size("generated").cast("int").alias("n_generated"), F.size("report_paths").cast("int").alias("n_reports"),
                    F.size("artifacts").cast("int").alias("n_artifacts"), "status")


def _nsys_rows(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select(F.expr(source_log_sql("spark")).alias("source_log"),
                     F.expr("CASE user_id % 3 WHEN 0 THEN 'cudaMemcpy' WHEN 1 THEN 'cudaLaunchKernel' ELSE 'cudaMalloc' END").alias("Name"),
                     F.expr(f"event_id * 1000 + {K}").alias("Total Time (ns)"), F.expr(f"{K} + 1").alias("Num Calls"),
                     F.col("event_id").alias("row_no"))


def _ncu_rows(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select(F.expr(source_log_sql("spark")).alias("source_log"),
                     F.expr(f"CASE WHEN {K} % 13 = 0 THEN '' ELSE 'kernel_' || CAST(user_id % 3 AS STRING) END").alias("Kernel Name"),
                     F.expr(f"CASE WHEN {K} % 7 = 0 THEN 'n/a' ELSE {_dec(CENTS)} END").alias("gpu__time_duration.sum"))


@register("flat_summary", _records_sql() + f""",
tim AS (SELECT source_log, CAST(arg_min(regexp_extract(line, '{_TIME}', 1), line_no) AS DOUBLE) AS elapsed_seconds,
               CAST(arg_min(regexp_extract(line, '{_TIME}', 4), line_no) AS BIGINT) AS max_rss_kb
        FROM lines WHERE regexp_matches(line, '{_TIME}') AND split_part(source_log, '/', 2) = 'timing' GROUP BY 1),
ns AS (SELECT {source_log_sql('duckdb')} AS source_log,
              CASE user_id % 3 WHEN 0 THEN 'cudaMemcpy' WHEN 1 THEN 'cudaLaunchKernel' ELSE 'cudaMalloc' END AS name,
              event_id * 1000 + {K} AS total_ns, {K} + 1 AS calls, event_id AS row_no
       FROM events),
nsl AS (SELECT source_log, name, arg_max(total_ns, row_no) AS total_ns, arg_max(calls, row_no) AS calls FROM ns GROUP BY 1, 2),
nc AS (SELECT {source_log_sql('duckdb')} AS source_log,
              CASE WHEN {K} % 13 = 0 THEN '' ELSE 'kernel_' || CAST(user_id % 3 AS VARCHAR) END AS kname
       FROM events),
ncs AS (SELECT source_log, COUNT(*) AS row_count, COUNT(DISTINCT NULLIF(kname, '')) AS kernel_count FROM nc GROUP BY 1)
SELECT '' AS instance, '' AS timestamp, r."case", r.mode, r.run_index, r.status, t.elapsed_seconds, t.max_rss_kb,
       m.total_ns AS cudaMemcpy_total_ns, m.calls AS cudaMemcpy_calls,
       k.total_ns AS cudaLaunchKernel_total_ns, k.calls AS cudaLaunchKernel_calls,
       c.row_count AS ncu_row_count, COALESCE(c.kernel_count, 0) AS ncu_kernel_count,
       CAST(r.n_warnings AS BIGINT) AS warning_count, CAST(r.n_errors AS BIGINT) AS error_count
FROM rec r LEFT JOIN tim t USING (source_log)
LEFT JOIN (SELECT * FROM nsl WHERE name = 'cudaMemcpy') m USING (source_log)
LEFT JOIN (SELECT * FROM nsl WHERE name = 'cudaLaunchKernel') k USING (source_log)
LEFT JOIN ncs c USING (source_log)""")
def flat_summary(spark, sf_dir):
    """The 16-column flat summary per record (blank where a part is missing)."""
    return logs.flat_summary(_records(spark, sf_dir), logs.nsys_cuda_api(_nsys_rows(spark, sf_dir)), _ncu_rows(spark, sf_dir))


def _manifest_sql():
    return f"""man AS (SELECT key, arg_max(value, line_no) AS value FROM (
  SELECT line_no, substr(line, 1, strpos(line, '=') - 1) AS key, substr(line, strpos(line, '=') + 1) AS value
  FROM (SELECT event_id AS line_no, {_manifest_line_sql()} AS line FROM events)
  WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '=')) z GROUP BY 1)"""


def _manifest_line_sql():
    return (f"(CASE {K} % 6 WHEN 0 THEN '# note ' || CAST(event_id AS STRING) WHEN 1 THEN '   ' "
            f"WHEN 2 THEN 'noequals' WHEN 3 THEN '  #a=b' || CAST({K} AS STRING) || ' ' "
            f"ELSE 'key' || CAST({K} % 3 AS STRING) || ' = v' || CAST(event_id AS STRING) || '=x ' END)")


def manifest_lines(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("manifest"), F.col("event_id").alias("line_no"), F.expr(_manifest_line_sql()).alias("line"))


@register("run_summary", _records_sql() + f""",
tim AS (SELECT source_log, CAST(arg_min(regexp_extract(line, '{_TIME}', 1), line_no) AS DOUBLE) AS e
        FROM lines WHERE regexp_matches(line, '{_TIME}') AND split_part(source_log, '/', 2) = 'timing' GROUP BY 1),
{_manifest_sql()}
SELECT (SELECT string_agg(key || ':' || value, ';' ORDER BY key) FROM man) AS manifest,
       (SELECT string_agg(mode || ':' || CAST(n AS VARCHAR), ';' ORDER BY mode) FROM (SELECT mode, COUNT(*) AS n FROM rec GROUP BY 1)) AS by_mode,
       (SELECT string_agg(status || ':' || CAST(n AS VARCHAR), ';' ORDER BY status) FROM (SELECT status, COUNT(*) AS n FROM rec GROUP BY 1)) AS by_status,
       CAST((SELECT COUNT(*) FROM rec) AS BIGINT) AS record_count,
       CAST((SELECT SUM(n_warnings) FROM rec) AS BIGINT) AS warning_count,
       CAST((SELECT SUM(n_errors) FROM rec) AS BIGINT) AS error_count,
       CAST(COUNT(e) AS BIGINT) AS elapsed_count, MIN(e) AS elapsed_min, MAX(e) AS elapsed_max,
       ROUND(AVG(e), 9) AS elapsed_mean, MEDIAN(e) AS elapsed_median,
       ROUND(CASE WHEN COUNT(e) > 1 THEN STDDEV_SAMP(e) END, 9) AS elapsed_stdev
FROM tim""")
def run_summary(spark, sf_dir):
    """Manifest, records in total, by mode and by status, warnings, errors, elapsed times."""
    t = F.col("timing_elapsed_seconds")
    manifest = logs.manifest_map(logs.manifest_entries(manifest_lines(spark, sf_dir).withColumn("run", F.lit(0)), "run"), "run").select("manifest")
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";").alias(c)
    return logs.run_summary(_records(spark, sf_dir), manifest).select(
        pairs("manifest"), pairs("by_mode"), pairs("by_status"),
        "record_count", "warning_count", "error_count", F.coalesce(t["count"].cast("bigint"), F.lit(0)).alias("elapsed_count"),
        t["min"].alias("elapsed_min"), t["max"].alias("elapsed_max"), F.round(t["mean"], 9).alias("elapsed_mean"),
        t["median"].alias("elapsed_median"), F.round(t["stdev"], 9).alias("elapsed_stdev"))


@register("ordered_records", _records_sql() + """
SELECT source_log, status, CAST(ROW_NUMBER() OVER (ORDER BY string_split(source_log, '/')) - 1 AS BIGINT) AS pos FROM rec""")
def ordered_records(spark, sf_dir):
    """Each record's place when records are ordered by the parts of their path."""
    from orthoflow.operators import forms

    rows = logs.ordered_records(_records(spark, sf_dir)).select("source_log", "status", F.split("source_log", "/").alias("parts"))
    return forms.with_position(rows, "parts").select("source_log", "status", "pos")


@register("count_by_sets", """
SELECT lang, source, CAST(COUNT(*) AS BIGINT) AS n, CAST(GROUPING(lang, source) AS INTEGER) AS gid
FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def count_by_sets(spark, sf_dir):
    """Documents by language, by source and in total, in one pass."""
    return logs.count_by_sets(fx.table(spark, sf_dir, "documents"), "lang", "source")


@register("numeric_summary", """
SELECT 'events' AS src, event_type AS key, CAST(COUNT(value) AS BIGINT) AS count, MIN(value) AS min, MAX(value) AS max,
       ROUND(AVG(value), 6) AS mean, MEDIAN(value) AS median,
       ROUND(CASE WHEN COUNT(value) > 1 THEN STDDEV_SAMP(value) END, 6) AS stdev FROM events GROUP BY event_type
UNION ALL
SELECT 'orders', o_orderpriority, CAST(COUNT(o_totalprice) AS BIGINT), MIN(o_totalprice), MAX(o_totalprice),
       ROUND(AVG(o_totalprice), 6), MEDIAN(o_totalprice),
       ROUND(CASE WHEN COUNT(o_totalprice) > 1 THEN STDDEV_SAMP(o_totalprice) END, 6) FROM orders GROUP BY o_orderpriority""")
def numeric_summary(spark, sf_dir):
    """Count, min, max, mean, median, sample stdev per key."""
    ev = logs.numeric_summary(fx.table(spark, sf_dir, "events"), ["event_type"], "value").select(
        F.lit("events").alias("src"), F.col("event_type").alias("key"), "*").drop("event_type")
    od = logs.numeric_summary(fx.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").select(
        F.lit("orders").alias("src"), F.col("o_orderpriority").alias("key"), "*").drop("o_orderpriority")
    both = ev.unionByName(od)
    return both.select("src", "key", "count", "min", "max", F.round("mean", 6).alias("mean"), "median",
                       F.round("stdev", 6).alias("stdev"))


@register("latest_per_key", """
SELECT CAST(user_id AS BIGINT) AS user_id, arg_max(event_id, (ts, event_id)) AS event_id,
       arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def latest_per_key(spark, sf_dir):
    """The newest event per user (ties broken by event_id), as max_by (partial + final)."""
    ev = fx.table(spark, sf_dir, "events")
    key = F.struct("ts", "event_id")
    return ev.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(
        F.max_by("event_id", key).alias("event_id"), F.max_by("event_type", key).alias("event_type"))


def _run_name_sql(d):
    day = fx.day_index_sql(d)

    def two(x):
        return f"lpad(CAST({x} AS STRING), 2, '0')"

    return (f"(event_type || '-202401' || {two(day + ' + 1')} || '_' || {two('hour(ts)')} || "
            f"{two('minute(ts)')} || {two('second(ts)')})")


@register("run_names", f"""
WITH n AS (SELECT DISTINCT {_run_name_sql('duckdb')} AS name FROM events),
p AS (SELECT name, regexp_extract(name, '^(.+)-([0-9]{{8}}_[0-9]{{6}})$', 1) AS instance,
             regexp_extract(name, '^(.+)-([0-9]{{8}}_[0-9]{{6}})$', 2) AS timestamp FROM n)
SELECT instance, arg_max(name, (timestamp, name)) AS latest, MAX(timestamp) AS timestamp FROM p
WHERE instance <> '' GROUP BY instance""")
def run_names(spark, sf_dir):
    """Parse '<instance>-<YYYYMMDD_HHMMSS>' run folders and keep the newest per instance."""
    ev = fx.table(spark, sf_dir, "events")
    names = ev.select(F.expr(_run_name_sql("spark")).alias("name")).distinct()
    return logs.latest_runs(names)


def _newest_sql():
    return f"""WITH n AS (SELECT DISTINCT {_run_name_sql('duckdb')} AS name FROM events),
p AS (SELECT name, regexp_extract(name, '^(.+)-([0-9]{{8}}_[0-9]{{6}})$', 1) AS instance,
             regexp_extract(name, '^(.+)-([0-9]{{8}}_[0-9]{{6}})$', 2) AS timestamp FROM n)
SELECT name, instance, timestamp FROM p WHERE instance <> '' ORDER BY timestamp DESC, name DESC LIMIT 1"""


@register("newest_run", _newest_sql())
def newest_run(spark, sf_dir):
    """The newest of all run folders."""
    return logs.newest_run(fx.table(spark, sf_dir, "events").select(F.expr(_run_name_sql("spark")).alias("name")))


@register("manifest_map", f"""
WITH l AS (SELECT event_type AS manifest, event_id AS line_no, {_manifest_line_sql()} AS line FROM events),
k AS (SELECT manifest, line_no, substr(line, 1, strpos(line, '=') - 1) AS key, substr(line, strpos(line, '=') + 1) AS value
      FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '='))
SELECT manifest, key, arg_max(value, line_no) AS value FROM k GROUP BY 1, 2""")
def manifest_map(spark, sf_dir):
    """Manifest entries per instance (last duplicate wins)."""
    return logs.manifest_entries(manifest_lines(spark, sf_dir))


def _report_line_sql(d):
    """Lines of a report over three lines, between text with brackets that begin no JSON."""
    return (f"(CASE event_id % 4 WHEN 0 THEN 'done {{x}} [' || CAST({K} AS STRING) WHEN 1 THEN 'note {{\"a' "
            f"ELSE '{{{{' || chr(10) || '  \"testcase_count\": ' || CAST({K} AS STRING) || ',' || chr(10) || '  \"total_sweeps\": ' || CAST(event_id AS STRING) || chr(10) || '}}}} tail' END)").replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


@register("json_fields", f"""
WITH l AS (SELECT {source_log_sql('duckdb')} AS source_log, CAST(event_id AS BIGINT) AS line_no, {K} AS k FROM events WHERE event_id % 4 >= 2),
f AS (SELECT source_log, arg_min(k, line_no) AS testcase_count, MIN(line_no) AS total_sweeps FROM l GROUP BY 1)
SELECT source_log, testcase_count, total_sweeps FROM f""")
def json_fields(spark, sf_dir):
    """The first report in each log, indented over several lines, after text whose brackets
    begin no JSON."""
    ev = fx.table(spark, sf_dir, "events")
    lines = ev.select(F.expr(source_log_sql("spark")).alias("source_log"), F.col("event_id").cast("bigint").alias("line_no"), F.expr(_report_line_sql("spark")).alias("line"))
    return logs.app_reports(lines).select("source_log", "app_report.testcase_count", "app_report.total_sweeps")


def _raw_sql():
    return (f"(CASE {K} % 9 WHEN 0 THEN '' WHEN 1 THEN CAST({K} AS STRING) WHEN 2 THEN {_dec(CENTS)} "
            f"WHEN 3 THEN 'x' || CAST({K} AS STRING) WHEN 4 THEN CAST({K} AS STRING) || 'd' WHEN 5 THEN {_dec(CENTS)} || 'f' "
            f"WHEN 6 THEN '9' || lpad(CAST(event_id AS STRING), 20, '0') WHEN 7 THEN ' ' || {_dec(CENTS)} || 'e1 ' ELSE '  ' END)")


@register("coerce_values", f"""
WITH r AS (SELECT CAST(event_id AS BIGINT) AS event_id, {K} AS k, CENTS_ AS c, {_raw_sql()} AS raw FROM events)
SELECT event_id, raw, CASE WHEN k % 9 = 1 THEN k END AS as_int,
       CASE k % 9 WHEN 2 THEN c / 100 WHEN 7 THEN c / 10 END AS as_float,
       CASE WHEN k % 9 IN (3, 4, 5, 6, 8) THEN raw END AS as_text,
       CASE k % 9 WHEN 1 THEN CAST(k AS DOUBLE) WHEN 2 THEN c / 100 WHEN 6 THEN CAST(raw AS DOUBLE) WHEN 7 THEN c / 10 ELSE 0.0 END AS or_zero
FROM r""".replace("CENTS_", CENTS))
def coerce_values(spark, sf_dir):
    """profiler cell coercion (int, float, text, blank) and float-or-zero, with suffixed
    numbers, integers beyond 64 bits, exponents and blanks. The oracle knows the value each text
    was made from and parses none of them but the large integers."""
    ev = fx.table(spark, sf_dir, "events")
    r = ev.select(F.col("event_id").cast("bigint").alias("event_id"), F.expr(_raw_sql()).alias("raw"))
    cv = logs.coerce_value(F.col("raw"))
    return r.select("event_id", "raw", cv["as_int"].alias("as_int"), cv["as_float"].alias("as_float"),
                    cv["as_text"].alias("as_text"), logs.float_or_zero(F.col("raw")).alias("or_zero"))


@register("kernel_time", f"""
WITH nc AS (SELECT {source_log_sql('duckdb')} AS source_log,
                   CASE WHEN {K} % 13 = 0 THEN '' ELSE 'kernel_' || CAST(user_id % 3 AS VARCHAR) END AS kernel,
                   CASE WHEN {K} % 7 = 0 THEN 'n/a' ELSE {_dec(CENTS)} END AS dur
            FROM events)
SELECT source_log, kernel, CAST(COUNT(*) AS BIGINT) AS launches,
       ROUND(SUM(COALESCE(TRY_CAST(dur AS DOUBLE), 0.0)), 6) AS gpu_time_duration_sum
FROM nc WHERE kernel <> '' GROUP BY 1, 2""")
def kernel_time(spark, sf_dir):
    """Per log and kernel, launches and summed duration (non-numeric counts 0)."""
    _, by_kernel = logs.ncu_by_kernel(_ncu_rows(spark, sf_dir))
    return by_kernel.select("source_log", "kernel", "launches",
                            F.round("gpu_time_duration_sum", 6).alias("gpu_time_duration_sum"))


@register("run_counts", _records_sql() + """
SELECT mode, status, CAST(COUNT(*) AS BIGINT) AS n, CAST(GROUPING(mode, status) AS INTEGER) AS gid
FROM rec GROUP BY GROUPING SETS ((mode), (status), ())""")
def run_counts(spark, sf_dir):
    """Records by mode, by status and in total, in one pass (GROUPING SETS)."""
    return logs.count_by_sets(_records(spark, sf_dir).select("mode", "status"), "mode", "status")
