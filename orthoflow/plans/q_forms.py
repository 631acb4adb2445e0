"""Driver queries of matrix forms (P1-P3, P2 round trip, G13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import forms
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register

_EMB_CELLS = fx.sql_embedding_cells(4)


@register("cells_from_table", f"SELECT mid AS matrix_id, r, c, v FROM ({_EMB_CELLS}) z")
def cells_from_table(spark, sf_dir):
    """Packed 16 x 4 matrices (one per embedding) to cells."""
    return forms.packed_to_cells(fx.embedding_packed(spark, sf_dir, 16, 4))


@register("row_major_index", f"SELECT mid AS matrix_id, r, c, CAST(r * 4 + c AS BIGINT) AS ix, v FROM ({_EMB_CELLS}) z")
def row_major_index(spark, sf_dir):
    cells = forms.packed_to_cells(fx.embedding_packed(spark, sf_dir, 16, 4))
    return cells.select("matrix_id", "r", "c",
                        forms.row_major_index(F.col("r"), F.col("c"), F.lit(4)).cast("bigint").alias("ix"), "v")


@register("column_major_index", f"SELECT mid AS matrix_id, r, c, CAST(c * 16 + r AS BIGINT) AS ix, v FROM ({_EMB_CELLS}) z")
def column_major_index(spark, sf_dir):
    cells = forms.packed_to_cells(fx.embedding_packed(spark, sf_dir, 16, 4))
    return cells.select("matrix_id", "r", "c",
                        forms.column_major_index(F.col("r"), F.col("c"), F.lit(16)).cast("bigint").alias("ix"), "v")


@register("transpose", f"""
SELECT mid AS matrix_id, CAST(c AS BIGINT) AS r, CAST(r AS INTEGER) AS c, v, 4::BIGINT AS n_rows, 16::BIGINT AS n_cols
FROM ({_EMB_CELLS}) z
""")
def transpose(spark, sf_dir):
    """Packed transpose (16 x 4 -> 4 x 16), read back as cells."""
    t = forms.transpose_packed(fx.embedding_packed(spark, sf_dir, 16, 4))
    cells = forms.packed_to_cells(t)
    return cells.join(t.select("matrix_id", "n_rows", "n_cols"), "matrix_id")


@register("packed_roundtrip", f"SELECT mid AS matrix_id, r, c, v FROM ({_EMB_CELLS}) z")
def packed_roundtrip(spark, sf_dir):
    """cells -> packed -> rows -> packed -> cells gives the input back."""
    cells = forms.packed_to_cells(fx.embedding_packed(spark, sf_dir, 16, 4))
    packed = forms.cells_to_packed(cells)
    again = forms.rows_to_packed(forms.packed_to_rows(packed))
    return forms.packed_to_cells(again)


@register("identity_v", """
WITH sizes AS (SELECT CAST(l_orderkey AS BIGINT) AS mid, COUNT(*) AS n FROM lineitem GROUP BY 1)
SELECT mid AS matrix_id, CAST(i AS BIGINT) AS r, CAST(j AS INTEGER) AS c,
       CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v
FROM sizes, range(0, sizes.n) AS a(i), range(0, sizes.n) AS b(j)
""")
def identity_v(spark, sf_dir):
    """V = I(n) per order, n = its number of line items."""
    li = fx.table(spark, sf_dir, "lineitem")
    sizes = li.groupBy(F.col("l_orderkey").cast("bigint").alias("matrix_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return forms.identity_cells(sizes)
