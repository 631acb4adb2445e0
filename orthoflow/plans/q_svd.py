"""Driver queries of the decomposition operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import checks, forms, steps, svd
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register, sig
from orthoflow.plans.sqlgen import gram_jacobi_sigma_sql

SWEEPS_SQL = 8


def _spectrum_fmt(factors):
    return svd.spectrum(factors).select("matrix_id", "k", sig(F.col("sigma")).alias("sigma"))


# ---- sigma of the three strategies ---------------------------------------------------

@register("svd_sigma_batch", gram_jacobi_sigma_sql(fx.sql_embedding_wide(4), 4, SWEEPS_SQL))
def svd_sigma_batch(spark, sf_dir):
    """EMB: every embedding as a 16 x 4 matrix, batch strategy."""
    res = svd.svd(fx.embedding_packed(spark, sf_dir, 16, 4), strategy="batch", with_u=False)
    return _spectrum_fmt(res)


@register("svd_sigma_auto", gram_jacobi_sigma_sql(fx.sql_lineitem_wide("supplier", fx.LI4_COLUMNS), 4, SWEEPS_SQL))
def svd_sigma_auto(spark, sf_dir):
    """LI4 per supplier, routed by row count: small ones packed, big ones TSQR."""
    rows = fx.lineitem_rows(spark, sf_dir, "supplier", fx.LI4_COLUMNS)
    return _spectrum_fmt(svd.svd_auto_rows(rows))


@register("svd_sigma_tall", gram_jacobi_sigma_sql(fx.sql_lineitem_wide("flag", fx.LI4_COLUMNS), 4, SWEEPS_SQL))
def svd_sigma_tall(spark, sf_dir):
    """LI4 per return flag: each matrix holds about a third of lineitem (TSQR)."""
    rows = fx.lineitem_rows(spark, sf_dir, "flag", fx.LI4_COLUMNS)
    return _spectrum_fmt(svd.tall_factors(rows))


_N2_SQL = f"""
WITH s AS (SELECT mid, SUM(x0 * x0) AS pp, SUM(x1 * x1) AS qq, SUM(x0 * x1) AS pq
           FROM ({fx.sql_lineitem_wide("supplier", fx.LI2_COLUMNS)}) w GROUP BY mid),
e AS (SELECT mid, (pp + qq) / 2 AS h, SQRT((pp - qq) * (pp - qq) + 4 * pq * pq) / 2 AS d FROM s)
SELECT mid AS matrix_id, 0 AS k, printf('%.5e', SQRT(h + d)) AS sigma FROM e
UNION ALL
SELECT mid AS matrix_id, 1 AS k, printf('%.5e', SQRT(GREATEST(h - d, 0))) AS sigma FROM e
"""


@register("svd_sigma_n2", _N2_SQL)
def svd_sigma_n2(spark, sf_dir):
    """LI2 (quantity, discount) per supplier; oracle is the 2 x 2 closed form."""
    rows = fx.lineitem_rows(spark, sf_dir, "supplier", fx.LI2_COLUMNS)
    return _spectrum_fmt(svd.svd_auto_rows(rows))


# ---- checks (D9) ---------------------------------------------------------------------

@register("svd_reconstruct", f"""
SELECT mid AS matrix_id, r, c, ROUND(v, 6) + 0.0 AS v FROM ({fx.sql_embedding_cells(4)}) z
""")
def svd_reconstruct(spark, sf_dir):
    """U diag(sigma) V^T rebuilt per row equals the input (EMB 16 x 4)."""
    res = svd.svd(fx.embedding_packed(spark, sf_dir, 16, 4), strategy="batch")
    cells = forms.packed_to_cells(checks.reconstruct_packed(res))
    return cells.select("matrix_id", "r", F.col("c").cast("int").alias("c"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


@register("svd_reconstruct_rows", f"""
SELECT mid AS matrix_id, CAST(SUM(x0 + x1 + x2 + x3) * 100 AS BIGINT) AS cents, COUNT(*) AS n FROM ({fx.sql_lineitem_wide("supplier", fx.LI4_COLUMNS)}) w GROUP BY mid
""")
def svd_reconstruct_rows(spark, sf_dir):
    """J9 on row form: every row of LI4 per supplier rebuilt from U, sigma and V, which reach a task once;
    each rebuilt cell in cents, summed per matrix."""
    rows = fx.lineitem_rows(spark, sf_dir, "supplier", fx.LI4_COLUMNS)
    factors, u = svd.svd_rows(rows)
    back = checks.reconstruct_rows(u, factors)
    cents = F.aggregate("x_hat", F.lit(0).cast("bigint"), lambda s, x: s + F.round(x * 100).cast("bigint"))
    return back.groupBy("matrix_id").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))


@register("svd_freivalds", """
SELECT CAST(l_suppkey AS BIGINT) AS matrix_id, TRUE AS whole, FALSE AS damaged FROM lineitem GROUP BY 1
""")
def svd_freivalds(spark, sf_dir):
    """D9 by Freivalds' check on LI4 per supplier: the decomposition passes, and does not where one cell of
    U in each matrix is off by a thousandth."""
    rows = fx.lineitem_rows(spark, sf_dir, "supplier", fx.LI4_COLUMNS)
    factors, u = svd.svd_rows(rows)
    first = u.groupBy("matrix_id").agg(F.min("r").alias("first"))
    bad = u.join(first, "matrix_id").select("matrix_id", "r", F.when(F.col("r") == F.col("first"), F.transform("u", lambda x, i: F.when(i == 1, x + 1e-3).otherwise(x))).otherwise(F.col("u")).alias("u"))
    passes = lambda df, name: df.select("matrix_id", (F.col("residual") <= 1e-11 * F.col("size")).alias(name))
    return passes(checks.freivalds(rows, u, factors), "whole").join(passes(checks.freivalds(rows, bad, factors), "damaged"), "matrix_id")


@register("svd_orthogonality", """
SELECT CAST(vec_id AS BIGINT) AS matrix_id, m.which, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS g
FROM embeddings, (VALUES ('U'), ('V')) AS m(which), range(0, 4) AS a(i), range(0, 4) AS b(j)
""")
def svd_orthogonality(spark, sf_dir):
    """U^T U and V^T V are the identity (EMB 16 x 4, full rank), rounded to 6 places."""
    res = svd.svd(fx.embedding_packed(spark, sf_dir, 16, 4), strategy="batch")
    out = checks.gram_packed(res, "u").withColumn("which", F.lit("U")).unionByName(checks.gram_packed(res, "v").withColumn("which", F.lit("V")))
    return out.select("matrix_id", "which", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                      (F.round("g", 6) + F.lit(0.0)).alias("g"))


@register("svd_energy", f"""
SELECT mid AS matrix_id, printf('%.5e', SUM(v * v)) AS energy FROM ({fx.sql_embedding_cells(4)}) z GROUP BY mid
""")
def svd_energy(spark, sf_dir):
    """sum of sigma^2 equals the sum of squares of the input (A5)."""
    res = svd.svd(fx.embedding_packed(spark, sf_dir, 16, 4), strategy="batch", with_u=False)
    return checks.energy(res).select("matrix_id", sig(F.col("energy")).alias("energy"))


@register("svd_report", """
SELECT CAST(COUNT(*) AS BIGINT) AS testcase_count, CAST(3 * COUNT(*) AS BIGINT) AS emitted_matrix_count,
       CAST(0 AS BIGINT) AS unconverged_count FROM embeddings
""")
def svd_report_q(spark, sf_dir):
    """Run report of the batch solve (sweep totals are not hashed)."""
    res = svd.svd(fx.embedding_packed(spark, sf_dir, 16, 4), strategy="batch", with_u=False)
    return svd.svd_report(res).select("testcase_count", "emitted_matrix_count", "unconverged_count")


@register("svd_report_json", """
SELECT '{"testcase_count":' || COUNT(*) || ',"emitted_matrix_count":' || (3 * COUNT(*)) || ',"unconverged_count":0}'
       AS report FROM embeddings
""")
def svd_report_json(spark, sf_dir):
    """The run report as JSON."""
    return svd.report_json(svd_report_q(spark, sf_dir))


@register("factor_emit_order", """
SELECT CAST(vec_id AS BIGINT) AS matrix_id, p.part_order, p.part, CAST(r AS BIGINT) AS r, CAST(c AS INTEGER) AS c
FROM embeddings,
     (VALUES (0, 'U', 16), (1, 'SIGMA', 1), (2, 'V', 4)) AS p(part_order, part, nr),
     range(0, 16) AS a(r), range(0, 4) AS b(c)
WHERE r < p.nr
""")
def factor_emit_order(spark, sf_dir):
    """U, Sigma, V cells per matrix in emit order (positions only; values carry signs)."""
    return svd.ordered_factor_cells(fx.embedding_packed(spark, sf_dir, 16, 4)).select(
        "matrix_id", F.col("part_order").cast("int").alias("part_order"), "part", "r", "c")


@register("spectrum_descending", gram_jacobi_sigma_sql(fx.sql_embedding_wide(4), 4, SWEEPS_SQL))
def spectrum_descending(spark, sf_dir):
    """T3 over the tall strategy on packed input (EMB 16 x 4 through TSQR)."""
    res = svd.svd(fx.embedding_packed(spark, sf_dir, 16, 4), strategy="tall", with_u=False)
    return _spectrum_fmt(res)


# ---- route and validation (P4, P6) ---------------------------------------------------

_SHAPES_SQL = """
WITH shapes AS (
  SELECT 'emb16x4' AS source, CAST(vec_id AS BIGINT) AS matrix_id, 16::BIGINT AS n_rows, 4::BIGINT AS n_cols, 64::BIGINT AS n_cells FROM embeddings
  UNION ALL SELECT 'emb8x8', CAST(vec_id AS BIGINT), 8, 8, 64 FROM embeddings
  UNION ALL SELECT 'emb4x16', CAST(vec_id AS BIGINT), 4, 16, 64 FROM embeddings
  UNION ALL SELECT 'label64', CAST(label AS BIGINT), COUNT(*), 64, COUNT(*) * 64 FROM embeddings GROUP BY label
  UNION ALL SELECT 'label16', CAST(label AS BIGINT), COUNT(*), 16, COUNT(*) * 16 FROM embeddings GROUP BY label
  UNION ALL SELECT 'wide', CAST(vec_id AS BIGINT), CAST(vec_id % 400 + 10 AS BIGINT), 256, CAST((vec_id % 400 + 10) * 256 - CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) FROM embeddings
  UNION ALL SELECT 'none', CAST(vec_id AS BIGINT), 0, 4, 0 FROM embeddings WHERE vec_id % 50 = 0
  UNION ALL SELECT 'li4_supplier', CAST(l_suppkey AS BIGINT), COUNT(*), 4, COUNT(*) * 4 FROM lineitem GROUP BY l_suppkey
)
"""


def _shapes(spark, sf_dir):
    emb = fx.table(spark, sf_dir, "embeddings")
    li = fx.table(spark, sf_dir, "lineitem")

    def fixed(name, m, n):
        return emb.select(F.lit(name).alias("source"), F.col("vec_id").cast("bigint").alias("matrix_id"),
                          F.lit(m).cast("bigint").alias("n_rows"), F.lit(n).cast("bigint").alias("n_cols"),
                          F.size("embedding").cast("bigint").alias("n_cells"))

    def grouped(name, df, key, n):
        return df.groupBy(F.col(key).cast("bigint").alias("matrix_id")).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("source"), "matrix_id", F.col("n_rows").cast("bigint").alias("n_rows"),
            F.lit(n).cast("bigint").alias("n_cols"), (F.col("n_rows") * n).cast("bigint").alias("n_cells"))

    out = fixed("emb16x4", 16, 4).unionByName(fixed("emb8x8", 8, 8)).unionByName(fixed("emb4x16", 4, 16))
    out = out.unionByName(grouped("label64", emb, "label", 64)).unionByName(grouped("label16", emb, "label", 16))
    # shapes on both sides of every bound, with sizes that do not fit and empty ones
    rows = (F.col("vec_id") % 400 + 10).cast("bigint")
    wide = emb.select(F.lit("wide").alias("source"), F.col("vec_id").cast("bigint").alias("matrix_id"), rows.alias("n_rows"), F.lit(256).cast("bigint").alias("n_cols"),
                      (rows * 256 - F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)).cast("bigint").alias("n_cells"))
    none = emb.filter("vec_id % 50 = 0").select(F.lit("none").alias("source"), F.col("vec_id").cast("bigint").alias("matrix_id"), F.lit(0).cast("bigint").alias("n_rows"),
                                                F.lit(4).cast("bigint").alias("n_cols"), F.lit(0).cast("bigint").alias("n_cells"))
    return out.unionByName(wide).unionByName(none).unionByName(grouped("li4_supplier", li, "l_suppkey", 4))


@register("validate_matrices", _SHAPES_SQL + """
SELECT source, matrix_id, n_rows, n_cols,
       COALESCE(CASE WHEN n_rows <= 0 OR n_cols <= 0 THEN 'zero dimension'
                     WHEN n_rows < n_cols THEN 'rows < columns'
                     WHEN n_cells <> n_rows * n_cols THEN 'size mismatch' END, 'ok') AS reason
FROM shapes
""")
def validate_matrices(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    reason = forms.reject_reason(F.col("n_rows"), F.col("n_cols"), F.col("n_cells"))
    return s.select("source", "matrix_id", "n_rows", "n_cols", F.coalesce(reason, F.lit("ok")).alias("reason"))


@register("strategy_route", _SHAPES_SQL + f"""
SELECT source, matrix_id, n_rows, n_cols,
       (n_cols >= {forms.BIG_MIN_COLUMNS} AND n_rows * n_cols >= {forms.BIG_MIN_ELEMENTS}) AS big,
       CASE WHEN n_rows * n_cols >= {svd.TALL_MIN_ELEMENTS} THEN 'tall' ELSE 'batch' END AS strategy,
       CASE WHEN n_rows >= {svd.TALL_MIN_ROWS} THEN 'tall' ELSE 'batch' END AS row_route
FROM shapes
""")
def strategy_route(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    return s.select("source", "matrix_id", "n_rows", "n_cols",
                    forms.big_matrix(F.col("n_rows"), F.col("n_cols")).alias("big"),
                    svd.strategy_column().alias("strategy"),
                    F.when(F.col("n_rows") >= svd.TALL_MIN_ROWS, "tall").otherwise("batch").alias("row_route"))


@register("svd_tall_check", """
SELECT CAST(ascii(l_returnflag) AS BIGINT) AS matrix_id, CAST(COUNT(*) AS BIGINT) AS n_rows, TRUE AS reconstructs
FROM lineitem GROUP BY 1""")
def svd_tall_check(spark, sf_dir):
    """D5 + D9 on whole lineitem: U from the distributed A V / sigma pass rebuilds every row of
    each return-flag matrix to 1e-9 of the matrix norm (no matrix is gathered)."""
    rows = fx.lineitem_rows(spark, sf_dir, "flag", fx.LI4_COLUMNS)
    factors, u = svd.svd_rows(rows)
    rebuilt, given = checks.by_row(factors, checks.reconstruct_rows(u, factors), rows)
    xh = rebuilt.join(given, ["matrix_id", "r"])
    err = F.aggregate(F.zip_with("x_hat", "x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    per = xh.groupBy("matrix_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum(err).alias("_e2"))
    energy = factors.select("matrix_id", F.aggregate("sigma", F.lit(0.0), lambda a, s: a + s * s).alias("_a2"))
    return per.join(energy, "matrix_id").select(
        "matrix_id", "n_rows", (F.sqrt("_e2") <= F.lit(1e-9) * F.sqrt("_a2")).alias("reconstructs"))


# ---- accuracy and non-finite input on every route -------------------------------------

def _ill_conditioned_rows(spark, sf_dir, condition: float):
    """EMB rows with their columns scaled apart by ``condition`` and mixed by a Hadamard matrix."""
    rows = forms.packed_to_rows(fx.embedding_packed(spark, sf_dir, 16, 4))
    y = [F.col("x")[c] * F.lit(condition ** (-c / 3)) for c in range(4)]
    signs = [(1, 1, 1, 1), (1, -1, 1, -1), (1, 1, -1, -1), (1, -1, -1, 1)]
    mixed = [sum((F.lit(0.5 * s) * v for s, v in zip(row[1:], y[1:])), F.lit(0.5 * row[0]) * y[0]) for row in signs]
    return rows.select("matrix_id", "r", F.array(*mixed).alias("x"))


@register("svd_orthogonality_ill", """
SELECT route, condition, CAST(vec_id AS BIGINT) AS matrix_id, TRUE AS orthogonal FROM embeddings,
(VALUES ('batch'), ('tall')) a(route), (VALUES ('1e8'), ('1e10')) b(condition)""")
def svd_orthogonality_ill(spark, sf_dir):
    """|U^T U - I| <= 2e-9 at conditions 1e8 and 1e10, per matrix and route."""
    out = []
    for condition in ("1e8", "1e10"):
        rows = _ill_conditioned_rows(spark, sf_dir, float(condition))
        batch = svd.svd_batch(forms.rows_to_packed(rows), eps=1e-14)
        _, tall = svd.svd_rows(rows, eps=1e-14)
        for route, u in (("batch", checks.packed_u_rows(batch)), ("tall", tall)):
            g = checks.u_gram(u, 4)
            off = F.abs(F.col("g") - F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0)))
            out.append(g.groupBy("matrix_id").agg((F.max(off) <= 2e-9).alias("orthogonal")).select(
                F.lit(route).alias("route"), F.lit(condition).alias("condition"), "matrix_id", "orthogonal"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@register("svd_nan_contract", """
SELECT route, CAST(vec_id AS BIGINT) AS matrix_id, CAST(vec_id % 4 AS INTEGER) AS c,
       CASE vec_id % 3 WHEN 0 THEN 0.0 ELSE CAST('inf' AS DOUBLE) END AS sigma,
       CAST(CASE vec_id % 3 WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS nan_cells, CAST(0 AS DOUBLE) AS other_cells
FROM embeddings, (VALUES ('batch'), ('tall'), ('relational')) a(route) WHERE vec_id % 3 < 2""")
def svd_nan_contract(spark, sf_dir):
    """Rule 9 on the three routes: of three matrices one has a NaN and one an infinity in a column.
    A NaN column has norm 0 and a zero column of U; an infinite one has infinite norm and, in U,
    NaN in place of the infinity and zeros else."""
    bad = F.when(F.col("matrix_id") % 3 == 0, F.lit(float("nan"))).when(F.col("matrix_id") % 3 == 1, F.lit(float("inf")))
    rows = forms.packed_to_rows(fx.embedding_packed(spark, sf_dir, 16, 4))
    hit = lambda v, c: F.when((F.col("r") == 3) & (c == F.col("matrix_id") % 4), F.coalesce(bad, v)).otherwise(v)
    rows = rows.select("matrix_id", "r", F.transform("x", hit).alias("x"))
    batch = svd.svd_batch(forms.rows_to_packed(rows))
    tall_f, tall_u = svd.svd_rows(rows)
    rel_f, rel_u = steps.svd_relational(rows, 4)
    out = []
    for route, f, u in (("batch", batch, checks.packed_u_rows(batch)), ("tall", tall_f, tall_u), ("relational", rel_f, rel_u)):
        c = (F.col("matrix_id") % 4).cast("int")
        cell = F.col("u")[c]
        per = u.filter("matrix_id % 3 < 2").groupBy("matrix_id").agg(
            F.sum(F.isnan(cell).cast("int")).cast("int").alias("nan_cells"), F.max(F.when(~F.isnan(cell), F.abs(cell))).alias("other_cells"))
        out.append(f.join(per, "matrix_id").select(F.lit(route).alias("route"), "matrix_id", c.alias("c"), F.col("sigma")[c].alias("sigma"), "nan_cells", "other_cells"))
    return out[0].unionByName(out[1]).unionByName(out[2])
