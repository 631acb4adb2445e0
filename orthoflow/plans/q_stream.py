"""Driver queries of the streaming jobs (files land in a scratch folder; availableNow)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orthoflow import streaming
from orthoflow.operators import forms, svd
from orthoflow.plans import fixtures as fx
from orthoflow.plans import q_logs
from orthoflow.plans.catalog import register, sig
from orthoflow.plans.q_svd import SWEEPS_SQL
from orthoflow.plans.sqlgen import gram_jacobi_sigma_sql
from orthoflow.session import scratch_dir
from orthoflow.sources import streams


@register("stream_svd", gram_jacobi_sigma_sql(fx.sql_embedding_wide(4), 4, SWEEPS_SQL))
def stream_svd(spark, sf_dir):
    """ST1: binary matrix streams land in two batches, are read in ranges as they land and solved per
    micro-batch; sigma per vector."""
    root = scratch_dir(spark, "stream-in")
    packed = fx.embedding_packed(spark, sf_dir, 16, 4)
    middle = F.lit(packed.agg(F.avg("matrix_id")).first()[0])
    stream = streaming.matrix_stream(spark, f"{root}/*/run-*/*.mat", chunk_bytes=65536)
    solved = streaming.stream_svd(stream).select("matrix_id", "sigma")
    table, checkpoint = scratch_dir(spark, "stream-svd"), scratch_dir(spark, "stream-ckpt")
    found = []
    for name, half in (("a", packed.filter(F.col("matrix_id") <= middle)), ("b", packed.filter(F.col("matrix_id") > middle))):
        folder = f"{root}/{name}"
        streams.write_mat(half, folder, parts=4)
        out = streaming.run_to_table(solved, table, checkpoint)
        # the stream's key back to the vector: the place of its record, in the order it was written
        at = streams.with_stream_index(streams.read_mat(spark, folder), streams.mat_counts(spark, folder))
        at = at.select(F.xxhash64("path", "seq").alias("h"), F.col("matrix_id").alias("pos"))
        ids = forms.with_position(half.select(F.col("matrix_id").alias("vec_id")), "vec_id")
        found.append(at.join(ids, "pos").select("h", "vec_id"))
    j = out.join(found[0].unionByName(found[1]), out.matrix_id == F.col("h")).select(F.col("vec_id").alias("matrix_id"), "sigma")
    return j.select("matrix_id", F.posexplode(F.sort_array("sigma", asc=False)).alias("k", "s")).select(
        "matrix_id", F.col("k").cast("int").alias("k"), sig(F.col("s")).alias("sigma"))


@register("stream_totals", """
SELECT CAST(COUNT(*) AS BIGINT) AS testcase_count, CAST(3 * COUNT(*) AS BIGINT) AS emitted_matrix_count FROM embeddings""")
def stream_totals(spark, sf_dir):
    """ST2: running totals in complete mode (sweep totals are not hashed)."""
    folder = scratch_dir(spark, "stream-in")
    streams.write_txt(fx.embedding_packed(spark, sf_dir, 16, 4), folder, mode="overwrite", parts=4)
    packed = streaming.text_matrix_stream(spark, folder + "/*.txt", max_files_per_trigger=2)
    solved = svd.svd_batch(packed.select(F.xxhash64("path", "seq").alias("matrix_id"), "n_rows", "n_cols", "cells"),
                           with_u=False)
    name = f"stream_totals_{uuid.uuid4().hex[:8]}"
    out = streaming.run_to_memory(streaming.stream_totals(solved), name, mode="complete",
                                  checkpoint=scratch_dir(spark, "stream-ckpt"))
    return out.select("testcase_count", "emitted_matrix_count")


@register("stream_runs", q_logs.ORACLES_RUN_STATUS)
def stream_runs(spark, sf_dir):
    """ST3: log lines land as Parquet files, every log spread over several files and batches."""
    lines = q_logs.log_lines(spark, sf_dir)
    folder = scratch_dir(spark, "runs-in")
    lines.repartition(8, "line_no").write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", "2").parquet(folder)
    rec = streaming.stream_runs(stream, scratch_dir(spark, "runs-out"), scratch_dir(spark, "runs-ckpt"),
                                q_logs.listing(spark, sf_dir))
    return rec.select("case", "mode", "run_index", "source_log", "command",
                      F.size("warnings").cast("int").alias("n_warnings"), F.size("errors").cast("int").alias("n_errors"),
                      F.size("generated").cast("int").alias("n_generated"), F.size("report_paths").cast("int").alias("n_reports"),
                      F.size("artifacts").cast("int").alias("n_artifacts"), "status")
