"""Structured Streaming jobs (ST1-ST3).

ST1  stream_svd     matrix streams landing in a folder (binary, also files that grow; or text) ->
                    batch SVD per micro-batch
ST2  stream_totals  running testcase count and total sweeps (streaming aggregation)
ST3  stream_runs    log lines landing as files -> per-log records via foreachBatch
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.operators import logs, svd
from orthoflow.sources import matstream, streams


def matrix_stream(spark: SparkSession, path: str, chunk_bytes: int | None = None) -> DataFrame:
    """Packed matrices from binary stream files as they land and grow, in byte ranges (no file is read
    whole): offsets are (file, byte, record)."""
    matstream.register(spark)
    reader = spark.readStream.format("matstream").option("indexDir", streams.index_folder(spark))
    if chunk_bytes:
        reader = reader.option("chunkBytes", str(chunk_bytes))
    return reader.load(path)


def text_matrix_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Packed matrices from text stream files as they land (each file read whole: a text matrix may
    begin in any line, and windows over lines are not allowed on a stream)."""
    files = (spark.readStream.format("text").option("wholetext", "true")
             .option("maxFilesPerTrigger", str(max_files_per_trigger)).load(folder))
    files = files.select(F.col("_metadata.file_path").alias("path"), "value")
    return streams.parse_txt(files)


def stream_svd(packed_stream: DataFrame, eps: float = svd.DEFAULT_EPS, max_sweeps: int = svd.DEFAULT_MAX_SWEEPS,
               with_u: bool = False) -> DataFrame:
    """ST1: stateless SVD of each matrix of the stream (the batch strategy per micro-batch)."""
    keyed = packed_stream.select(F.xxhash64("path", "seq").alias("matrix_id"), "n_rows", "n_cols", "cells")
    # matrix_id is a hash of the source key (path, seq), so results can be joined back to it
    return svd.svd_batch(keyed, eps, max_sweeps, with_u)


def stream_totals(solved_stream: DataFrame) -> DataFrame:
    """ST2: running totals over all micro-batches (complete-mode aggregation)."""
    return solved_stream.agg(F.count(F.lit(1)).cast("bigint").alias("testcase_count"),
                             (F.count(F.lit(1)) * 3).cast("bigint").alias("emitted_matrix_count"),
                             F.sum("sweeps").cast("bigint").alias("total_sweeps"))


def run_to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a streaming DataFrame to completion (availableNow) into a memory table."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive a streaming DataFrame to completion (availableNow) into Parquet files, each batch once."""
    q = (df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_runs(lines_stream: DataFrame, sink: str, checkpoint: str, listing: DataFrame | None = None):
    """ST3: log lines land in any number of micro-batches; one record (E1) per log.

    What a record needs of its log is a streaming aggregate, kept per log in Spark's state store: a
    batch reads its own lines and the state of the logs it touches, whatever came before. The records
    of the touched logs are written to a folder of the batch, so a repeated batch replaces its own
    output; of a log's records the one of its newest batch counts. ``line_no`` orders a log's lines
    over all batches.
    """
    spark = lines_stream.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        logs.finish_records(batch, listing).write.mode("overwrite").parquet(f"{sink}/records/batch={batch_id}")

    q = (logs.gather_logs(lines_stream).writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    records = spark.read.option("basePath", f"{sink}/records").parquet(f"{sink}/records")
    newest = records.groupBy("source_log").agg(F.max("batch").alias("batch"))
    return records.join(newest, ["source_log", "batch"], "left_semi").drop("batch")
