"""Matrix stream readers and writers on DataFrames.

Text streams: one matrix row per line, whitespace-separated; whitespace-only lines
separate matrices (runs collapse, leading ones are skipped); the first row fixes the
width. Writer: 17 significant digits, single spaces, one blank line between matrices.
Numbers are plain decimals (exponent, infinity and NaN included); suffixes as in ``1d`` are not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoflow.functions.numbers import number_of
from orthoflow.session import scratch_dir
from orthoflow.sources import matstream, stream_index

# The stream formats known by extension.
FORMATS = {"mat": "mat", "txt": "txt"}


def index_folder(spark: SparkSession) -> str:
    """Where sidecars of streams that this library did not write are kept."""
    return scratch_dir(spark, "x").rsplit("/", 1)[0] + "/stream-index"


def read_mat(spark: SparkSession, path: str, chunk_bytes: int | None = None,
             split_min_bytes: int | None = None, form: str = "packed") -> DataFrame:
    """Packed matrices (or, with form ``rows``, their rows) with file path and in-file sequence
    number. Files to be cut that have no index get one first, by a job of its own; it is kept in the
    checkpoint folder, nothing is written beside the input."""
    matstream.register(spark)
    index_dir = index_folder(spark)
    split_min = matstream.DEFAULT_SPLIT_MIN_BYTES if split_min_bytes is None else split_min_bytes
    if any(e.size >= split_min and not indexed for e, indexed in matstream.list_files(path, index_dir=index_dir)):
        stream_index.index_streams(spark, path, min_bytes=split_min, index_dir=index_dir)
    reader = spark.read.format("matstream").option("indexDir", index_dir).option("form", form).option("splitMinBytes", str(split_min))
    if chunk_bytes:
        reader = reader.option("chunkBytes", str(chunk_bytes))
    return reader.load(path)


def mat_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, size, records, indexed of each file of a matrix stream: from its index, else by its headers;
    no payload is read."""
    matstream.register(spark)
    return spark.read.format("matstream").option("indexDir", index_folder(spark)).option("form", "counts").load(path)


def with_stream_index(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Global 0-based position over (path, seq) without a single-task window over rows.

    ``counts`` has the records per file (:func:`mat_counts`: no record is read for it); without it the
    rows are counted. File offsets are a running sum over that small table, and each record adds its
    in-file ``seq``.
    """
    if counts is None:
        counts = df.groupBy("path").agg(F.count(F.lit(1)).alias("records"))
    offsets = counts.select(
        "path",
        (F.sum("records").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    # one row per file: AQE broadcasts it when it is small, else it is a shuffle join
    return df.join(offsets, "path").withColumn(
        "matrix_id", (F.coalesce(F.col("_off"), F.lit(0)) + F.col("seq")).cast("bigint")).drop("_off")


def input_paths(df: DataFrame) -> list[str]:
    """Paths that the plan of a DataFrame reads (files and matrix streams; what lies behind a checkpoint
    is not seen)."""
    found = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        kind = leaf.getClass().getSimpleName()
        if kind == "DataSourceV2Relation":
            path = leaf.options().get("path")
            found += [path] if path else []
        elif kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths().iterator()
            while roots.hasNext():
                found.append(roots.next().toString())
    return found


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().normalize().toString()
    return re.sub(r"^file:/+", "file:/", full).rstrip("/")  # both spellings come back as they were given


def refuse_own_input(df: DataFrame, path: str) -> None:
    """An output must not be the input it comes from, nor a folder around it."""
    spark = df.sparkSession
    out = _qualified(spark, path)
    for source in input_paths(df):
        first = min([i for i in (source.find(c) for c in "*?[") if i >= 0], default=-1)
        root = _qualified(spark, source if first < 0 else source[:first].rsplit("/", 1)[0])
        if root == out or root.startswith(out + "/"):
            raise ValueError(f"input and output are the same path: {path}")


def write_mat(packed: DataFrame, path: str, mode: str = "errorifexists", order_col: str = "matrix_id",
              parts: int | None = None) -> None:
    """S3: range-partition by the order column, sort inside, one ordered part file (and its index) per
    task. S7: the input this output derives from must not be the output itself."""
    matstream.register(packed.sparkSession)
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"unsupported save mode for matrix streams: {mode}")
    refuse_own_input(packed, path)
    ordered = _ordered(packed, order_col, parts)
    # The writer refuses a non-empty output folder unless the mode is overwrite
    ordered.write.format("matstream").mode("overwrite" if mode == "overwrite" else "append").save(path)


def _ordered(df: DataFrame, order_col: str, parts: int | None) -> DataFrame:
    n = parts or max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(n, order_col).sortWithinPartitions(order_col)


# ---- text ---------------------------------------------------------------------------

_BLANK_RUN = r"\n([ \t\r\f\v]*\n)+"


def parse_txt(files: DataFrame, text_col: str = "value") -> DataFrame:
    """(path, seq, n_rows, n_cols, cells) from whole-text rows; bad input fails the job."""
    text = F.regexp_replace(F.col(text_col), r"\r\n", "\n")
    blocks = F.split(F.concat(F.lit("\n"), text, F.lit("\n")), _BLANK_RUN)
    kept = F.filter(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")) != "")
    ex = files.select("path", F.posexplode(kept).alias("seq", "block"))
    lines = F.filter(F.split(F.trim(F.col("block"), F.lit("\n")), "\n"), lambda s: F.trim(s) != "")
    rows = ex.select("path", F.col("seq").cast("bigint").alias("seq"), lines.alias("lines"))
    return _parse_blocks(rows)


def _parse_blocks(rows: DataFrame) -> DataFrame:
    """(path, seq, lines) -> packed rows; ragged rows or a bad token fail the job."""
    toks = F.transform("lines", lambda ln: F.split(F.trim(F.regexp_replace(ln, r"[ \t\f\v\r]+", " ")), " "))
    parsed = rows.select("path", "seq", toks.alias("toks"))
    width = F.size(F.element_at("toks", 1))
    ragged = F.exists("toks", lambda t: F.size(t) != width)
    cells = F.flatten(F.transform("toks", lambda t: F.transform(t, number_of)))
    raw = F.flatten(F.col("toks"))
    bad_token = F.exists(F.arrays_zip(cells.alias("d"), raw.alias("s")), lambda z: z["d"].isNull())
    checked = parsed.select(
        "path", "seq", F.size("toks").cast("bigint").alias("n_rows"), width.cast("bigint").alias("n_cols"),
        F.when(ragged, F.raise_error(F.concat(F.lit("ragged rows in "), F.col("path"), F.lit(" matrix "),
                                              F.col("seq").cast("string"))))
        .when(bad_token, F.raise_error(F.concat(F.lit("bad token in "), F.col("path"), F.lit(" matrix "),
                                                F.col("seq").cast("string"))))
        .otherwise(cells).alias("cells"))
    return checked


def read_txt(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Text matrix streams. By default files are read line by line (splittable, no file
    passes through one task whole); ``whole_files`` reads each file as one value instead."""
    if whole_files:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
        return parse_txt(files)
    return parse_txt_lines(spark.read.text(path))


_BLANK = r"^[ \t\r\f\v]*$"


def block_lines(src: DataFrame) -> DataFrame:
    """Gaps and islands with a two-level prefix count. From (path, split, pos, line) the non-blank
    lines, with ``seq``, the number of their block in their file.

    A line's place in its file is (split, position in the split). A block starts at a non-blank
    line whose previous line is blank or absent; the previous line of a split's first line is the
    last line of the split before it (from a small per-split table). The block number is the count
    of starts so far: per-split totals get offsets from a window over the per-split table, and the
    running count inside a split is a window over that split only.
    """
    src = src.withColumn("blank", F.col("line").rlike(_BLANK))
    w_in = Window.partitionBy("path", "split").orderBy("pos")
    marked = src.withColumn("prev_blank", F.lag("blank").over(w_in))
    per_split = marked.groupBy("path", "split").agg(
        F.max_by("blank", "pos").alias("last_blank"))
    w_split = Window.partitionBy("path").orderBy("split")
    per_split = per_split.select("path", "split", F.lag("last_blank").over(w_split).alias("carry_blank"))
    starts = marked.join(per_split, ["path", "split"]).withColumn(
        "start", ~F.col("blank") & F.coalesce(F.col("prev_blank"), F.col("carry_blank"), F.lit(True)))
    counts = starts.groupBy("path", "split").agg(F.sum(F.col("start").cast("int")).alias("n_starts"))
    offsets = counts.select("path", "split", F.coalesce(
        F.sum("n_starts").over(w_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = starts.filter(~F.col("blank")).join(offsets, ["path", "split"]).withColumn(
        "seq", F.col("offset") + F.sum(F.col("start").cast("int")).over(
            w_in.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.select("path", "split", "pos", "line", F.col("seq").cast("bigint").alias("seq"))


def parse_txt_lines(lines: DataFrame) -> DataFrame:
    """S2 on line-mode input: blocks of lines (W3), each gathered as one group (bounded by its matrix)
    and parsed."""
    src = lines.select(F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    blocks = block_lines(src).groupBy("path", "seq").agg(
        F.array_sort(F.collect_list(F.struct("split", "pos", "line"))).alias("_l"))
    return _parse_blocks(blocks.select("path", "seq", F.transform("_l", lambda e: e["line"]).alias("lines")))


def _text_blocks(batches):
    """mapInArrow body: the text of each matrix behind its columns. %.17g as C prints it; Java's
    formatter pads the shortest digits with zeros instead."""
    import pyarrow as pa

    for rb in batches:
        cells, blocks, at = rb.column("cells"), [], 0
        values = cells.flatten().to_numpy(zero_copy_only=False).tolist()
        for size, n in zip(cells.value_lengths().to_pylist(), rb.column("n_cols").to_pylist(), strict=True):
            size = size or 0
            line = " ".join(["%.17g"] * n) + "\n"
            blocks.append(line * (size // n if n else 0) % tuple(values[at:at + size]))
            at += size
        yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(blocks, pa.string())], names=[*rb.schema.names, "block"])


def format_txt(packed: DataFrame) -> DataFrame:
    """One text block per matrix: rows of 17-significant-digit numbers, '\\n' after each row."""
    from pyspark.sql.types import StringType, StructField, StructType

    return packed.mapInArrow(_text_blocks, StructType([*packed.schema.fields, StructField("block", StringType())]))


def write_txt(packed: DataFrame, path: str, mode: str = "errorifexists", order_col: str = "matrix_id",
              parts: int | None = None) -> None:
    """Blocks separated by one blank line, ordered part files. S7: not into its own input."""
    refuse_own_input(packed, path)
    blocks = format_txt(packed).select(order_col, "block")
    _ordered(blocks, order_col, parts).select("block").write.mode(mode).option("lineSep", "\n").text(path)


# ---- S5: factor output --------------------------------------------------------------

def factor_packed(result: DataFrame) -> DataFrame:
    """U, Sigma (1 x n), V per matrix as packed rows in emit order (seq = 3*id + part)."""
    parts = F.array(
        F.struct(F.lit(0).alias("part_order"), F.col("n_rows").alias("pr"), F.col("u").alias("cells")),
        F.struct(F.lit(1).alias("part_order"), F.lit(1).cast("bigint").alias("pr"), F.col("sigma").alias("cells")),
        F.struct(F.lit(2).alias("part_order"), F.col("n_cols").alias("pr"), F.col("v").alias("cells")),
    )
    ex = result.select("matrix_id", "n_cols", F.explode(parts).alias("p"))
    return ex.select((F.col("matrix_id") * 3 + F.col("p.part_order")).alias("seq"),
                     F.col("p.pr").alias("n_rows"), "n_cols", F.col("p.cells").alias("cells"))


def write_factors(packed: DataFrame, path: str, mode: str = "errorifexists", strategy: str = "batch",
                  parts: int | None = None, text: bool = False) -> None:
    """U, Sigma, V of packed matrices as an ordered stream, each matrix solved once.

    ``batch`` solves inside the ranges in which the parts are written; ``auto``, which sends big
    matrices another way, keeps its results as a table and deals that out.
    """
    from orthoflow.operators import svd

    if strategy == "batch":
        refuse_own_input(packed, path)
        matstream.register(packed.sparkSession)
        result = svd.svd_ordered(packed, parts=parts or max(1, packed.sparkSession.sparkContext.defaultParallelism))
        # part files take the order of partitions, records that of rows
        factors = factor_packed(result).withColumnRenamed("seq", "matrix_id")
        if text:
            format_txt(factors).select("block").write.mode(mode).option("lineSep", "\n").text(path)
        else:
            factors.write.format("matstream").mode("overwrite" if mode == "overwrite" else "append").save(path)
        return
    result = svd.svd(packed, strategy=strategy)
    kept = scratch_dir(packed.sparkSession, "factors")
    result.write.parquet(kept)
    result = packed.sparkSession.read.schema(result.schema).parquet(kept)
    refuse_own_input(packed, path)
    (write_txt if text else write_mat)(factor_packed(result).withColumnRenamed("seq", "matrix_id"), path, mode, parts=parts)


# ---- S6: format route ---------------------------------------------------------------

def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def resolve_format(path: Column, requested: Column | None = None, strict: bool = False) -> Column:
    """'mat' / 'txt' from an explicit request or the extension, case-insensitive; NULL if
    unknown, or a failed job with ``strict``."""
    ext = extension(path)
    chosen = F.lower(requested) if requested is not None else ext
    known = F.when(chosen.isin(*FORMATS), chosen)
    if strict:
        return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown matrix format: "), path))).otherwise(known)
    return known


def default_output(path: Column) -> Column:
    """<stem>.svd.<ext> next to the input."""
    return F.regexp_replace(path, r"\.([^./]+)$", ".svd.$1")
