"""Driver queries of the generators.

Cases come from the tables: one file per nation, one case per supplier of that nation
(G11 with a per-file case count), so the generated volume grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.operators import generate as gen
from orthoflow.operators import svd
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register, sig


def case_plan(spark, sf_dir):
    """(file_index, case_index) = nations x sequence(0, suppliers in the nation - 1)."""
    sup = fx.table(spark, sf_dir, "supplier")
    per_file = sup.groupBy(F.col("s_nationkey").cast("bigint").alias("file_index")).agg(
        F.count(F.lit(1)).cast("bigint").alias("cases"))
    return per_file.select("file_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cases") - 1)).alias("case_index"))


_CASES_SQL = """cases AS (
  SELECT CAST(s_nationkey AS BIGINT) AS file_index, CAST(i AS BIGINT) AS case_index
  FROM (SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY 1) f, range(0, 100000) AS t(i) WHERE i < n)"""


@register("case_plan", f"WITH {_CASES_SQL} SELECT file_index, case_index FROM cases")
def case_plan_q(spark, sf_dir):
    return case_plan(spark, sf_dir)


def _cands_sql(o: gen.GenOptions) -> str:
    rows = ", ".join(f"({i}, {r})" for i, r in enumerate(o.rows))
    cols = ", ".join(f"({i}, {c})" for i, c in enumerate(o.columns))
    cond = "TRUE" if o.allow_wide else "nr >= nc"
    pol = o.shape_distribution
    if pol == "square":
        cond += " AND nr = nc"
    elif pol == "tall-skinny":
        cond += " AND nr >= 2 * nc"
    elif pol == "wide":
        cond += " AND nr < nc"
    return f"""cands AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY ri, ci) - 1 AS BIGINT) AS shape_ix, CAST(nr AS BIGINT) AS n_rows,
         CAST(nc AS BIGINT) AS n_cols, 1.0 / SQRT(CAST(nr * nc AS DOUBLE)) AS weight
  FROM (VALUES {rows}) AS a(ri, nr), (VALUES {cols}) AS b(ci, nc) WHERE {cond}),
pref AS (SELECT *, SUM(weight) OVER (ORDER BY shape_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
                SUM(weight) OVER () AS total FROM cands)"""


def _shaped_sql(o: gen.GenOptions) -> str:
    k = gen.candidate_count(o)
    u = gen.uniform_sql(str(o.seed), "file_index", "case_index", "-1", "-1", "7", dialect="duckdb", fn=o.hash_fn)
    if o.shape_distribution == "uniform":
        pick = f"LEAST(CAST(FLOOR({u} * {k}) AS BIGINT), {k - 1})"
        body = f"SELECT file_index, case_index, {pick} AS pick FROM cases"
    elif o.shape_distribution == "log-uniform":
        body = (f"SELECT c.file_index, c.case_index, COALESCE(p.shape_ix, c.case_index % {k}) AS pick "
                f"FROM (SELECT *, {u} AS t FROM cases) c LEFT JOIN pref p "
                f"ON c.t * p.total <= p.prefix AND (c.t * p.total > p.prefix - p.weight OR p.shape_ix = 0)")
    else:
        body = f"SELECT file_index, case_index, case_index % {k} AS pick FROM cases"
    return (f"WITH {_CASES_SQL}, {_cands_sql(o)},\nshaped AS (SELECT s.file_index, s.case_index, p.n_rows, p.n_cols "
            f"FROM ({body}) s JOIN pref p ON p.shape_ix = s.pick)")


def _shaped(spark, sf_dir, o):
    return gen.choose_shapes(case_plan(spark, sf_dir), gen.shape_candidates(spark, o), o)


_POLICIES = {"grid": "grid", "uniform": "uniform", "log_uniform": "log-uniform", "square": "square",
             "tall": "tall-skinny", "wide": "wide"}


def _register_shape(key: str, policy: str):
    o = gen.GenOptions(shape_distribution=policy, allow_wide=(policy == "wide"), hash_fn="md5")

    @register(f"choose_shape_{key}", _shaped_sql(o) + "\nSELECT file_index, case_index, n_rows, n_cols FROM shaped")
    def q(spark, sf_dir):
        """G1/G2/P8 (W2 + J5 for log-uniform): the shape of every case under one policy."""
        return _shaped(spark, sf_dir, o).select("file_index", "case_index", "n_rows", "n_cols")

    return q


for _k, _p in _POLICIES.items():
    _register_shape(_k, _p)


_VALUES = {"uniform": "uniform", "normal": "normal", "log_uniform": "log-uniform", "diag": "diagonal-dominant",
           "low_rank": "low-rank", "ill_cond": "ill-conditioned", "sparse": "sparse", "zero_cols": "zero-columns"}


def _cells_sql(o: gen.GenOptions) -> str:
    base = _shaped_sql(o) + f""",
cells AS (SELECT file_index, case_index, n_rows, n_cols, CAST({o.seed} AS BIGINT) AS seed_key,
                 CAST(ix // n_cols AS BIGINT) AS r, CAST(ix % n_cols AS BIGINT) AS c
          FROM shaped, range(0, 100000) AS t(ix) WHERE ix < n_rows * n_cols)"""
    if o.value_distribution in ("low-rank", "ill-conditioned"):
        left, right, scale, noise = gen.factor_terms_sql(o, dialect="duckdb")
        return base + f""",
terms AS (SELECT *, LEAST({o.rank}, n_rows, n_cols) AS rank_eff FROM cells),
prods AS (SELECT file_index, case_index, n_rows, n_cols, seed_key, r, c, {scale} * {left} * {right} AS t
          FROM terms, range(0, 64) AS kk(k) WHERE k < rank_eff),
summed AS (SELECT file_index, case_index, n_rows, n_cols, seed_key, r, c, SUM(t) AS lr FROM prods GROUP BY ALL)
SELECT file_index, case_index, n_rows, n_cols, r, c, ROUND(lr + {noise}, 6) + 0.0 AS v FROM summed"""
    return base + f"\nSELECT file_index, case_index, n_rows, n_cols, r, c, ROUND({gen.value_sql(o, dialect='duckdb')}, 6) + 0.0 AS v FROM cells"


def _register_values(key: str, dist: str):
    o = gen.GenOptions(value_distribution=dist, hash_fn="md5")  # md5: DuckDB recomputes the same values

    @register(f"gen_{key}", _cells_sql(o))
    def q(spark, sf_dir):
        """Generated cells (grid shapes of the defaults), rounded to 6 places."""
        cells = gen.generate_cells(_shaped(spark, sf_dir, o), o)
        return cells.select("file_index", "case_index", "n_rows", "n_cols", "r", "c",
                            (F.round("v", 6) + F.lit(0.0)).alias("v"))

    return q


for _k, _d in _VALUES.items():
    _register_values(_k, _d)


_SIZES = list(gen.BENCHMARK_SIZES)


@register("gen_benchmark", f"""
WITH sizes AS (SELECT CAST(s_suppkey AS BIGINT) AS case_index,
                      CAST(list_value({', '.join(map(str, _SIZES))})[(s_suppkey % {len(_SIZES)}) + 1] AS BIGINT) AS n FROM supplier),
cells AS (SELECT case_index, 2 * n AS n_rows, n AS n_cols, CAST(ix // n AS BIGINT) AS r, CAST(ix % n AS BIGINT) AS c
          FROM sizes, range(0, 20000) AS t(ix) WHERE ix < 2 * n * n)
SELECT case_index, n_rows, n_cols, r, c, ROUND({gen.BENCHMARK_SQL}, 9) + 0.0 AS v FROM cells
""")
def gen_benchmark(spark, sf_dir):
    """The 2n x n benchmark matrix per supplier, n from the fixed size list."""
    sup = fx.table(spark, sf_dir, "supplier")
    sizes = sup.select(F.col("s_suppkey").cast("bigint").alias("case_index"),
                       F.element_at(F.array(*[F.lit(s) for s in _SIZES]),
                                    (F.pmod(F.col("s_suppkey"), F.lit(len(_SIZES))) + 1).cast("int")).cast("bigint").alias("n"))
    cells = gen.benchmark_cells(sizes)
    return cells.select("case_index", "n_rows", "n_cols", "r", "c", (F.round("v", 9) + F.lit(0.0)).alias("v"))


@register("gen_uniform_svd", None)
def gen_uniform_svd(spark, sf_dir):
    """Generated uniform matrices (one per supplier, grid shapes), batch SVD, descending sigma.

    No SQL oracle (shapes up to 64 x 32); checked against numpy in the tests.
    """
    o = gen.GenOptions()
    packed = gen.generate_packed(gen.spread(_shaped(spark, sf_dir, o), "file_index", "case_index"), o)
    res = svd.svd(packed, strategy="batch", with_u=False)
    return svd.spectrum(res).select("matrix_id", "k", sig(F.col("sigma")).alias("sigma"))
