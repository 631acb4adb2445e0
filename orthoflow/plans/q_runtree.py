"""Driver queries over a real run tree on disk: the events-rendered logs and exports are
written as files (<case>/<mode>/run_N.log, artifacts, ncu CSV, nsys JSON) into a scratch
folder, then scanned back with the file sources (S8, S10, S11) and turned into records."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from orthoflow.operators import logs
from orthoflow.plans import q_logs
from orthoflow.plans.catalog import ORACLES, register
from orthoflow.session import scratch_dir


def _write_texts(root: str, kind: str = "lines"):
    """mapInArrow body over (path, text) sorted by path and place: the files of a task, one after the
    other, as the rows come. No more than one batch is held, however long a file is."""

    def write(batches):
        import pyarrow as pa

        handle, current, place, files = None, None, 0, 0

        def finish():
            if handle:
                handle.write("\n]" if kind == "json" else "")
                handle.close()

        for batch in batches:
            paths, texts = batch.column("path").to_pylist(), batch.column("text").to_pylist()
            lo = 0
            while lo < len(paths):
                hi = lo + 1
                while hi < len(paths) and paths[hi] == paths[lo]:
                    hi += 1
                if handle is None or paths[lo] != current:
                    finish()
                    current, place = paths[lo], 0
                    full = os.path.join(root, current)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    handle = open(full, "w", encoding="utf-8", newline="")
                    files += 1
                    if kind == "csv":  # the two modes export different columns
                        deep = "/ncu-deep/" in current
                        handle.write('"Block Size","gpu__time_duration.sum","launch__kernel_name"\n' if deep
                                     else '"ID","Kernel Name","gpu__time_duration.sum","Block Size"\n')
                part = texts[lo:hi]
                if kind == "json":
                    handle.write(("[\n" if place == 0 else ",\n") + ",\n".join(part))
                elif kind == "csv" and not deep:
                    handle.write("".join([f'"{i}",{t}\n' for i, t in enumerate(part, place)]))
                else:
                    handle.write("\n".join(part) + "\n")
                place += hi - lo
                lo = hi
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def _write_sorted(texts, root: str, kind: str = "lines") -> None:
    """Write (path, row_no, text) as files under ``root``. As many tasks as the session has for an
    exchange (adaptive execution joins small ones) write whole files each."""
    ordered = texts.repartition("path").sortWithinPartitions("path", "row_no").select("path", "text")
    ordered.mapInArrow(_write_texts(root, kind), "files bigint").write.format("noop").mode("overwrite").save()


#: report -> (JSON fields in Spark, the field that the query reads, its value in SQL)
REPORTS = {
    "cuda_api_sum": ({"Name": "Name", "Total Time (ns)": "total_ns", "Num Calls": "calls"}, "$['Total Time (ns)']", "total_ns"),
    "cuda_gpu_kern_sum": ({"Name": "concat('kernel_', Name)", "Instances": "calls", "Avg (ns)": "CAST(total_ns / 2 AS DECIMAL(22, 1))"}, "$.Instances", "calls"),
    "cuda_gpu_mem_time_sum": ({"Operation": "Name", "Time (%)": "calls % 100", "Count": "calls + 1"}, "$.Count", "calls + 1"),
    "cuda_gpu_mem_size_sum": ({"Operation": "Name", "Total (MB)": "total_ns * 3", "Count": "calls"}, "$['Total (MB)']", "total_ns * 3"),
    "osrt_sum": ({"Name": "Name", "Num Calls": "calls * 7"}, "$['Num Calls']", "calls * 7"),
}


def materialize_tree(spark, sf_dir, root: str | None = None) -> str:
    """Write the run tree of ``sf_dir`` into a folder, a fresh one by default; returns its path."""
    root = root or scratch_dir(spark, "run-tree")
    lines = q_logs.log_lines(spark, sf_dir)
    _write_sorted(lines.select(F.col("source_log").alias("path"), F.col("line_no").alias("row_no"), F.col("line").alias("text")), root)
    # stand-in report files (file scans skip zero-length files)
    _write_sorted(q_logs.listing(spark, sf_dir).distinct().select("path", F.lit(0).alias("row_no"), F.lit("report").alias("text")), root)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ncu = ev.select(F.regexp_replace(F.expr(q_logs.source_log_sql("spark")), r"\.log$", "_ncu.csv").alias("path"),
                    F.expr(f"CASE WHEN {q_logs.K} % 13 = 0 THEN '' ELSE 'kernel_' || CAST(user_id % 3 AS STRING) END").alias("kernel"),
                    F.expr(f"CASE WHEN {q_logs.K} % 7 = 0 THEN 'n/a' ELSE {q_logs._dec(q_logs.CENTS)} END").alias("dur"),
                    F.col("event_id").alias("row_no"))
    kernel, dur = F.coalesce("kernel", F.lit("None")), F.coalesce("dur", F.lit("None"))
    text = F.when(F.col("path").contains("/ncu-deep/"), F.format_string('"256","%s","%s"', dur, kernel)).otherwise(F.format_string('"%s","%s","256"', kernel, dur))
    _write_sorted(ncu.select("path", "row_no", text.alias("text")), root, "csv")
    ns = q_logs._nsys_rows(spark, sf_dir).withColumnsRenamed({"Total Time (ns)": "total_ns", "Num Calls": "calls"})
    for report, (fields, _, _) in REPORTS.items():
        row = F.to_json(F.struct(*[F.expr(v).alias(k) for k, v in fields.items()]))
        rows = ns.select(F.regexp_replace("source_log", r"\.log$", f"_{report}.json").alias("path"), "row_no", row.alias("text"))
        _write_sorted(rows, root, "json")
    return root


def _records_from_tree(spark, root):
    return logs.log_records(logs.scan_run_tree(spark, root), logs.list_artifacts(spark, root))


@register("run_tree_records", q_logs.ORACLES_RUN_STATUS)
def run_tree_records(spark, sf_dir):
    """S8/J6/E1 on files: logs scanned from disk, artifacts from the listing, records."""
    root = materialize_tree(spark, sf_dir)
    r = _records_from_tree(spark, root)
    return r.select("case", "mode", "run_index", "source_log", "command",
                    F.size("warnings").cast("int").alias("n_warnings"), F.size("errors").cast("int").alias("n_errors"),
                    F.size("generated").cast("int").alias("n_generated"), F.size("report_paths").cast("int").alias("n_reports"),
                    F.size("artifacts").cast("int").alias("n_artifacts"), "status")


@register("run_tree_kernel_time", ORACLES["kernel_time"])
def run_tree_kernel_time(spark, sf_dir):
    """S10/A10 on files: exports with two different headers, one of which names kernels in
    another column."""
    root = materialize_tree(spark, sf_dir)
    _, by_kernel = logs.ncu_by_kernel(logs.read_ncu_csv(spark, root))
    return by_kernel.select("source_log", "kernel", "launches", F.round("gpu_time_duration_sum", 6).alias("gpu_time_duration_sum"))


@register("run_tree_summary", ORACLES["flat_summary"])
def run_tree_summary(spark, sf_dir):
    """E3 on files: timing from the logs, cudaMemcpy/cudaLaunchKernel from the nsys JSON
    exports (S11, last row per Name wins), row and kernel counts from the ncu CSV (S10)."""
    root = materialize_tree(spark, sf_dir)
    api = logs.nsys_cuda_api(logs.cuda_api_rows(logs.read_nsys_reports(spark, root)))
    return logs.flat_summary(_records_from_tree(spark, root), api, logs.read_ncu_csv(spark, root))


def _reports_sql():
    rows = f"""SELECT {q_logs.source_log_sql('duckdb')} AS source_log, event_id * 1000 + {q_logs.K} AS total_ns, {q_logs.K} + 1 AS calls FROM events"""
    each = " UNION ALL ".join(f"SELECT source_log, '{r}' AS report, {value} AS v FROM rows_" for r, (_, _, value) in REPORTS.items())
    return f"""WITH rows_ AS ({rows})
SELECT source_log, report, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(v) AS BIGINT) AS total FROM ({each}) z GROUP BY 1, 2"""


@register("run_tree_reports", _reports_sql())
def run_tree_reports(spark, sf_dir):
    """S11 on files: all five reports of every log, kept row by row as they are; a field of each."""
    found = logs.read_nsys_reports(spark, materialize_tree(spark, sf_dir), logs.NSYS_REPORTS)
    value = F.coalesce(*[F.when(F.col("report") == r, F.variant_get("row", path, "bigint")) for r, (_, path, _) in REPORTS.items()])
    return found.groupBy("source_log", "report").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


@register("extract_run", ORACLES["flat_summary"].replace("SELECT '' AS instance, '' AS timestamp,", "SELECT 'bench' AS instance, '20240131_120000' AS timestamp,"))
def extract_run(spark, sf_dir):
    """The log job in one call: the newest of two runs is resolved, scanned and written out; its flat
    summary is read back."""
    prof = scratch_dir(spark, "prof")
    old = spark.createDataFrame([("c/timing/run_1.log", 0, "$ old")], "path string, row_no int, text string")
    _write_sorted(old, f"{prof}/bench-20230131_120000")
    materialize_tree(spark, sf_dir, f"{prof}/bench-20240131_120000")
    out = scratch_dir(spark, "extract")
    logs.extract_run(spark, prof, out)
    schema = ("instance string, timestamp string, case string, mode string, run_index int, status string, elapsed_seconds double, max_rss_kb bigint, "
              + "".join(f"{n}_{part} bigint, " for n in logs.FLAT_NAMES for part in ("total_ns", "calls"))
              + "ncu_row_count bigint, ncu_kernel_count bigint, warning_count bigint, error_count bigint")
    return spark.read.schema(schema).option("header", "true").csv(f"{out}/summary")
