"""Driver queries of the relational step operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthoflow.functions.rotation import rotation_params
from orthoflow.operators import forms, steps
from orthoflow.operators.kernels import DEFAULT_EPS, round_robin_pairs
from orthoflow.plans import fixtures as fx
from orthoflow.plans.catalog import register, sig
from orthoflow.plans.sqlgen import gram_jacobi_sigma_sql, identity_rows_sql, wide_rounds_sql

_EV = fx.sql_events_wide()
_EV_N = len(fx.EVENT_TYPES)


# ---- schedule (F3, F4, G14) ----------------------------------------------------------

@register("round_robin_schedule", """
WITH RECURSIVE mats AS (SELECT CAST(l_orderkey AS BIGINT) AS matrix_id, CAST(COUNT(*) AS INTEGER) AS n
                        FROM lineitem GROUP BY 1),
sizes AS (SELECT DISTINCT n FROM mats WHERE n >= 2),
circle AS (
  SELECT n, n + n % 2 AS e, 0 AS round, CAST(range(0, n + n % 2) AS INTEGER[]) AS a FROM sizes
  UNION ALL
  SELECT n, e, round + 1, [a[1]] || [a[e]] || a[2:e - 1] FROM circle WHERE round + 1 < e - 1
),
sched AS (SELECT n, CAST(round AS INTEGER) AS round, CAST(slot AS INTEGER) AS slot, a[slot + 1] AS p, a[e - slot] AS q
          FROM circle, range(0, circle.e // 2) AS t(slot)
          WHERE a[slot + 1] < n AND a[e - slot] < n)
SELECT m.matrix_id, s.n, s.round, s.slot, s.p, s.q FROM mats m JOIN sched s USING (n)
""")
def round_robin_schedule(spark, sf_dir):
    """G14 + J2: the pair schedule (closed form F4) of every column count, attached to each
    matrix (one per order, n = its line items) by an equi-join on n."""
    li = fx.table(spark, sf_dir, "lineitem")
    mats = li.groupBy(F.col("l_orderkey").cast("bigint").alias("matrix_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    sched = steps.schedule_frame(mats.select("n"))
    out = mats.join(sched, "n")
    return out.select("matrix_id", F.col("n").cast("int").alias("n"), F.col("round").cast("int").alias("round"),
                      F.col("slot").cast("int").alias("slot"), F.col("p").cast("int").alias("p"),
                      F.col("q").cast("int").alias("q"))


# ---- aggregates (A1-A3, A5) ----------------------------------------------------------

def _pair_rows_sql():
    parts = []
    for rnd, pairs in enumerate(round_robin_pairs(_EV_N)):
        for p, q in pairs:
            parts.append(
                f"SELECT mid AS matrix_id, {rnd} AS round, {p} AS p, {q} AS q, "
                f"CAST(SUM(x{p} * x{p}) AS BIGINT) AS pp, CAST(SUM(x{q} * x{q}) AS BIGINT) AS qq, "
                f"CAST(SUM(x{p} * x{q}) AS BIGINT) AS pq FROM ev GROUP BY mid")
    return f"WITH ev AS ({_EV})\n" + "\nUNION ALL\n".join(parts)


@register("pair_stats", _pair_rows_sql())
def pair_stats(spark, sf_dir):
    """Pp, qq, pq of every scheduled pair (EV: day x user x event-type counts, exact)."""
    outs = steps.sweep_pair_stats(fx.events_rows(spark, sf_dir), _EV_N)
    return outs.select("matrix_id", F.col("round").cast("int").alias("round"),
                       F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q"),
                       *[F.col(c).cast("bigint").alias(c) for c in ("pp", "qq", "pq")])


def _gram_sql():
    cents = [f"CAST(ROUND(x{j} * 100) AS BIGINT)" for j in range(4)]
    parts = [
        f"SELECT mid AS matrix_id, {i} AS i, {j} AS j, CAST(SUM(CAST({cents[i]} AS HUGEINT) * {cents[j]}) AS DECIMAL(38,0)) AS g "
        f"FROM w GROUP BY mid"
        for i in range(4) for j in range(i, 4)
    ]
    return f"WITH w AS ({fx.sql_lineitem_wide('supplier', fx.LI4_COLUMNS)})\n" + "\nUNION ALL\n".join(parts)


@register("gram", _gram_sql())
def gram(spark, sf_dir):
    """A2: upper triangle of A^T A per supplier on LI4 in cents (exact DECIMAL sums)."""
    rows = fx.lineitem_rows(spark, sf_dir, "supplier", fx.LI4_COLUMNS)
    cents = rows.select("matrix_id", "r", F.transform("x", lambda v: F.round(v * 100).cast("bigint").cast("decimal(38,0)")).alias("x"))
    g = steps.gram(cents, 4)
    return g.select("matrix_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                    F.col("g").cast("decimal(38,0)").alias("g"))


@register("column_norms", f"""
SELECT mid AS matrix_id, c, printf('%.5e', SQRT(GREATEST(SUM(v * v), 0))) AS sigma
FROM ({fx.sql_embedding_cells(4)}) z GROUP BY mid, c
""")
def column_norms(spark, sf_dir):
    """A3 on EMB 16 x 4 cells."""
    cells = forms.packed_to_cells(fx.embedding_packed(spark, sf_dir, 16, 4))
    return steps.column_norms_cells(cells).select("matrix_id", "c", sig(F.col("sigma")).alias("sigma"))


@register("frobenius", f"""
SELECT mid AS matrix_id, CAST(SUM(v * v) AS BIGINT) AS sum_sq FROM ({fx.sql_events_wide()}) w,
LATERAL (SELECT UNNEST([x0, x1, x2, x3, x4]) AS v) GROUP BY mid
""")
def frobenius(spark, sf_dir):
    """A5 on EV cells (integer counts, exact)."""
    cells = forms.rows_to_cells(fx.events_rows(spark, sf_dir))
    return steps.frobenius(cells).select("matrix_id", F.col("sum_sq").cast("bigint").alias("sum_sq"))


# ---- rotation (F1, P5) and the relational Jacobi (D1-D3, A4, D6) ---------------------

def _rotation_sql():
    pairs = round_robin_pairs(_EV_N)[0]
    parts = []
    for p, q in pairs:
        pp, qq, pq = f"SUM(x{p} * x{p})", f"SUM(x{q} * x{q})", f"SUM(x{p} * x{q})"
        parts.append(f"SELECT mid, {p} AS p, {q} AS q, {pp} AS pp, {qq} AS qq, {pq} AS pq FROM ev GROUP BY mid")
    from orthoflow.plans.sqlgen import _params

    prm = _params("pp", "qq", "pq", DEFAULT_EPS, 0)
    return (f"WITH ev AS ({_EV}), s AS ({' UNION ALL '.join(parts)}), "
            f"r AS (SELECT mid, p, q, {', '.join(prm)} FROM s)\n"
            "SELECT mid AS matrix_id, p, q, rot0 AS rotate, ROUND(c0, 12) + 0.0 AS c, ROUND(s0, 12) + 0.0 AS s FROM r")


@register("rotation_params", _rotation_sql())
def rotation_params_q(spark, sf_dir):
    """F1/P5 on the round-0 pair statistics of EV."""
    rows = fx.events_rows(spark, sf_dir)
    st = steps.pair_stats(rows, round_robin_pairs(_EV_N)[0])
    rot, c, s = rotation_params(F.col("pp"), F.col("qq"), F.col("pq"), DEFAULT_EPS)
    return st.select("matrix_id", F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q"),
                     rot.alias("rotate"), (F.round(c, 12) + F.lit(0.0)).alias("c"),
                     (F.round(s, 12) + F.lit(0.0)).alias("s"))


def _ev_state_sql(ev: str = _EV):
    xs = ", ".join(f"x{j}" for j in range(_EV_N))
    a = f"SELECT mid, 'A' AS kind, r, {xs}, FALSE AS rot FROM ({ev}) e"
    v = identity_rows_sql(f"SELECT DISTINCT mid FROM ({ev}) e2", _EV_N)
    return f"{a} UNION ALL {v}"


def _rounds_sql(rounds: list[int], decimals: int):
    ctes, last = wide_rounds_sql(_ev_state_sql(), _EV_N, rounds)
    xs = ", ".join(f"ROUND(x{j}, {decimals}) + 0.0" for j in range(_EV_N))
    return (f"WITH {', '.join(ctes)}\nSELECT mid AS matrix_id, kind, r, [{xs}] AS x, rot AS rotated FROM {last}")


def _state_out(state, decimals: int):
    return state.select("matrix_id", "kind", "r",
                        F.transform("x", lambda v: F.round(v, decimals) + F.lit(0.0)).alias("x"),
                        F.col("rot").alias("rotated"))


@register("jacobi_round", _rounds_sql([0], 9))
def jacobi_round(spark, sf_dir):
    """Round 0 applied to A and V of every EV matrix (n = 5, one dummy slot)."""
    state = steps.initial_state(fx.events_rows(spark, sf_dir), _EV_N)
    return _state_out(steps.jacobi_round(state, _EV_N, 0), 9)


@register("jacobi_sweep", _rounds_sql(list(range(len(round_robin_pairs(_EV_N)))), 6))
def jacobi_sweep(spark, sf_dir):
    """One full sweep (5 rounds) of EV; ``rotated`` is the sweep flag."""
    state = steps.initial_state(fx.events_rows(spark, sf_dir), _EV_N)
    return _state_out(steps.jacobi_sweep(state, _EV_N), 6)


def _flags_sql():
    rounds = list(range(len(round_robin_pairs(_EV_N))))
    cells = ", ".join(f"CASE WHEN mid % 2 = 0 THEN 0.0 ELSE x{j} END AS x{j}" for j in range(1, _EV_N))
    ctes, last = wide_rounds_sql(_ev_state_sql(f"SELECT mid, r, x0, {cells} FROM ({_EV}) half"), _EV_N, rounds)
    return f"WITH {', '.join(ctes)}\nSELECT mid AS matrix_id, BOOL_OR(rot) AS rotated FROM {last} GROUP BY mid"


@register("convergence_flags", _flags_sql())
def convergence_flags(spark, sf_dir):
    """A4: per matrix, did the first sweep rotate; every other matrix keeps one column and does not."""
    rows = fx.events_rows(spark, sf_dir)
    alone = F.array(F.col("x")[0], *[F.lit(0.0)] * (_EV_N - 1))
    rows = rows.withColumn("x", F.when(F.col("matrix_id") % 2 == 0, alone).otherwise(F.col("x")))
    state = steps.initial_state(rows, _EV_N)
    return steps.convergence_flags(steps.jacobi_sweep(state, _EV_N))


@register("u_sigma", f"""
WITH ev AS ({_EV}),
cells AS (SELECT mid, r, c - 1 AS c, [x0, x1, x2, x3, x4][c] AS v FROM ev, range(1, 6) AS t(c)),
nrm AS (SELECT mid, c, SQRT(GREATEST(SUM(v * v), 0)) AS sigma FROM cells GROUP BY mid, c)
SELECT cells.mid AS matrix_id, cells.r, CAST(cells.c AS INTEGER) AS c,
       ROUND(CASE WHEN sigma > {DEFAULT_EPS!r} THEN v / sigma ELSE 0.0 END, 12) + 0.0 AS u
FROM cells JOIN nrm USING (mid, c)
""")
def u_sigma(spark, sf_dir):
    """Normalised columns of EV (absolute cut-off eps)."""
    state = steps.initial_state(fx.events_rows(spark, sf_dir), _EV_N)
    _, u = steps.u_sigma(state, _EV_N)
    return u.select("matrix_id", "r", F.posexplode("u").alias("c", "u")).select(
        "matrix_id", "r", F.col("c").cast("int").alias("c"), (F.round("u", 12) + F.lit(0.0)).alias("u"))


@register("svd_relational", gram_jacobi_sigma_sql(_EV, _EV_N, 10))
def svd_relational(spark, sf_dir):
    """D3: the relational strategy to convergence on EV (sigma descending, 6 digits).

    Oracle: the same Jacobi unrolled on the Gram matrix in SQL.
    """
    factors, _ = steps.svd_relational(fx.events_rows(spark, sf_dir), _EV_N)
    from orthoflow.operators.svd import spectrum

    return spectrum(factors).select("matrix_id", "k", sig(F.col("sigma")).alias("sigma"))


@register("svd_sigma_events", gram_jacobi_sigma_sql(_EV, _EV_N, 10))
def svd_sigma_events(spark, sf_dir):
    """D7 on EV (per day: users x event-type counts): the auto route on row form; same oracle
    as the relational strategy, so the two strategies are checked against one another too."""
    from orthoflow.operators.svd import spectrum, svd_auto_rows

    return spectrum(svd_auto_rows(fx.events_rows(spark, sf_dir))).select(
        "matrix_id", "k", sig(F.col("sigma")).alias("sigma"))
