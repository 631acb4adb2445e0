"""Driver queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orthoflow.operators import forms
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register
from orthoflow.session import scratch_dir
from orthoflow.sources import streams


def _stream_cells(packed, counts=None):
    indexed = streams.with_stream_index(packed, counts)
    return forms.packed_to_cells(indexed.select("matrix_id", "n_rows", "n_cols", "cells"))


def _ordinal_cells_sql(n_cols: int) -> str:
    return f"""
WITH o AS (SELECT vec_id, CAST(ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS pos FROM embeddings)
SELECT o.pos AS matrix_id, z.r, z.c, z.v FROM ({fx.sql_embedding_cells(n_cols)}) z JOIN o ON o.vec_id = z.mid
"""


@register("mat_roundtrip", _ordinal_cells_sql(4))
def mat_roundtrip(spark, sf_dir):
    """EMB 16 x 4 written as a binary stream (ordered parts), read back, cells."""
    out = scratch_dir(spark, "mat-roundtrip")
    streams.write_mat(fx.embedding_packed(spark, sf_dir, 16, 4), out, mode="overwrite", parts=4)
    # every part file is read in ranges of 64 KB; the positions come from the index of the parts
    return _stream_cells(streams.read_mat(spark, out, chunk_bytes=65536, split_min_bytes=0), streams.mat_counts(spark, out))


@register("txt_roundtrip", _ordinal_cells_sql(8))
def txt_roundtrip(spark, sf_dir):
    """EMB 8 x 8 written as a text stream, read back bit-exact, cells."""
    out = scratch_dir(spark, "txt-roundtrip")
    streams.write_txt(fx.embedding_packed(spark, sf_dir, 8, 8), out, mode="overwrite", parts=4)
    return _stream_cells(streams.read_txt(spark, out + "/*.txt"))


#: document texts with runs of blank lines before some of their lines
_BLANKS = "replace(replace(text, chr(10) || 'T', chr(10) || ' ' || chr(10) || 'T'), chr(10) || 'I', chr(10) || chr(10) || chr(9) || chr(10) || 'I')"


@register("txt_block_islands", rf"""
WITH s AS (SELECT doc_id, string_split({_BLANKS}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls[i] AS line, i AS ln FROM s, range(1, len(ls) + 1) AS t(i)),
b AS (
  SELECT doc_id, ln, line, regexp_matches(line, '^[ \t\r]*$') AS blank,
         SUM(CASE WHEN regexp_matches(line, '^[ \t\r]*$') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk
  FROM l)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(ln - 1 AS BIGINT) AS line_no,
       CAST(DENSE_RANK() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS BIGINT) AS block,
       CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, blk ORDER BY ln) - 1 AS BIGINT) AS row_in_block,
       CAST(len(string_split_regex(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')), ' ')) AS BIGINT) AS n_tokens
FROM b WHERE NOT blank
""")
def txt_block_islands(spark, sf_dir):
    """Lines of each document, as a file in splits of 16 lines, grouped into blocks by blank-line
    runs (gaps and islands)."""
    docs = fx.table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("path"), F.posexplode(F.split(F.expr(_BLANKS), "\n")).alias("pos", "line"))
    kept = streams.block_lines(lines.withColumn("split", F.floor(F.col("pos") / 16)))
    return kept.select(
        F.col("path").cast("bigint").alias("doc_id"), F.col("pos").cast("bigint").alias("line_no"), F.col("seq").alias("block"),
        (F.row_number().over(Window.partitionBy("path", "seq").orderBy("pos")) - 1).cast("bigint").alias("row_in_block"),
        F.size(F.split(F.trim(F.regexp_replace("line", r"[ \t\r]+", " ")), " ")).cast("bigint").alias("n_tokens"),
    )


#: page paths with the extensions that the route knows, in either case, and others
_PATH = "(regexp_extract(url, '^[^?#]*', 0) || CASE page_id % 5 WHEN 1 THEN '.mat' WHEN 2 THEN '.TXT' WHEN 3 THEN '.Mat' WHEN 4 THEN '.csv' ELSE '' END)"


@register("format_route", rf"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, {_PATH} AS path FROM pages),
e AS (SELECT *, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext FROM p)
SELECT page_id, ext, CASE WHEN ext IN ('mat', 'txt') THEN ext ELSE 'unknown' END AS format,
       regexp_replace(path, '\.([^./]+)$', '.svd.\1') AS default_output
FROM e
""")
def format_route(spark, sf_dir):
    """Format from the (case-insensitive) extension of each path; default output name."""
    path = F.col("path")
    pages = fx.table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), F.expr(_PATH).alias("path"))
    return pages.select("page_id", streams.extension(path).alias("ext"), F.coalesce(streams.resolve_format(path), F.lit("unknown")).alias("format"),
                        streams.default_output(path).alias("default_output"))


def _sigma_by_vec_sql():
    from orthoflow.plans.sqlgen import gram_jacobi_sigma_sql

    return gram_jacobi_sigma_sql(fx.sql_embedding_wide(4), 4, 8)


@register("factor_stream_roundtrip", _sigma_by_vec_sql())
def factor_stream_roundtrip(spark, sf_dir):
    """S1 -> P4 -> D7 -> S5/S3 -> S1: a matrix stream file in, U / Sigma / V stream file out
    (three records per input, in input order), read back; sigma per input from its Sigma record."""
    src = scratch_dir(spark, "svd-in")
    streams.write_mat(fx.embedding_packed(spark, sf_dir, 16, 4), src, mode="overwrite", parts=4)
    packed = streams.with_stream_index(streams.read_mat(spark, src), streams.mat_counts(spark, src))
    good, _ = forms.validate_packed(packed.select("matrix_id", "n_rows", "n_cols", "cells"), strict=True)
    out = scratch_dir(spark, "svd-out")
    streams.write_factors(good, out, mode="overwrite", parts=4)
    back = streams.with_stream_index(streams.read_mat(spark, out), streams.mat_counts(spark, out))
    # the emitted layout: record 3i is U, 3i+1 Sigma, 3i+2 V of input i
    sigma = back.filter(F.pmod(F.col("matrix_id"), F.lit(3)) == 1).select(F.floor(F.col("matrix_id") / 3).alias("pos"), F.col("cells").alias("sigma"))
    ordinal = forms.with_position(fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id")), "vec_id")
    j = sigma.join(ordinal, "pos")
    return j.select(F.col("vec_id").alias("matrix_id"), F.posexplode(F.sort_array("sigma", asc=False)).alias("k", "s")).select(
        "matrix_id", F.col("k").cast("int").alias("k"), F.format_string("%.5e", F.col("s")).alias("sigma"))
