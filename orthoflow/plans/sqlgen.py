"""Generators of DuckDB oracle SQL for the iterative operators.

The Jacobi schedule is static (it depends on n only), so a fixed number of sweeps can be
unrolled into chained CTEs: on the Gram matrix for singular values, on wide rows for the
round and sweep step operators.
"""

from __future__ import annotations

from orthoflow.operators.kernels import DEFAULT_EPS, round_robin_pairs

D = "::DOUBLE"


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}_{max(i, j)}"


def _params(pp: str, qq: str, pq: str, eps: float, k: int) -> list[str]:
    """rot_k, c_k, s_k with the exact operation order of the Spark side (s = t * c)."""
    rot = (f"(ABS({pq}) > {eps!r}{D} * SQRT(GREATEST({pp}, 0.0{D}) * GREATEST({qq}, 0.0{D})) "
           f"AND ABS({pq}) > 1e-300{D})")
    tau = f"(({qq}) - ({pp})) / (2.0{D} * ({pq}))"
    t = (f"(CASE WHEN {tau} >= 0 THEN 1.0{D} / ({tau} + SQRT(1.0{D} + {tau} * {tau})) "
         f"ELSE -1.0{D} / (-({tau}) + SQRT(1.0{D} + {tau} * {tau})) END)")
    c = f"(1.0{D} / SQRT(1.0{D} + {t} * {t}))"
    return [
        f"{rot} AS rot{k}",
        f"CASE WHEN {rot} THEN {c} ELSE 1.0{D} END AS c{k}",
        f"CASE WHEN {rot} THEN {t} * {c} ELSE 0.0{D} END AS s{k}",
    ]


def _support(i: int, pairs: list[tuple[int, int]]) -> list[tuple[int, str | None]]:
    for k, (p, q) in enumerate(pairs):
        if i == p:
            return [(p, f"c{k}"), (q, f"(-s{k})")]
        if i == q:
            return [(p, f"s{k}"), (q, f"c{k}")]
    return [(i, None)]


def gram_jacobi_sigma_sql(wide_sql: str, n: int, sweeps: int, eps: float = DEFAULT_EPS,
                          key: str = "matrix_id", fmt: str = "%.5e") -> str:
    """(key, k, sigma): singular values, descending, printf-formatted, via Jacobi on A^T A."""
    ctes = []
    sums = ", ".join(f"SUM(x{i} * x{j}) AS {_g(i, j)}" for i in range(n) for j in range(i, n))
    ctes.append(f"s0 AS MATERIALIZED (SELECT mid, {sums} FROM ({wide_sql}) w GROUP BY mid)")
    cur, step = "s0", 0
    gcols = [_g(i, j) for i in range(n) for j in range(i, n)]
    for _ in range(sweeps):
        for pairs in round_robin_pairs(n):
            if not pairs:
                continue
            step += 1
            params = []
            for k, (p, q) in enumerate(pairs):
                params += _params(_g(p, p), _g(q, q), _g(p, q), eps, k)
            ctes.append(f"p{step} AS MATERIALIZED (SELECT mid, {', '.join(gcols)}, {', '.join(params)} FROM {cur})")
            news = []
            for i in range(n):
                for j in range(i, n):
                    terms = []
                    for a, ca in _support(i, pairs):
                        for b, cb in _support(j, pairs):
                            f = [x for x in (ca, _g(a, b), cb) if x is not None]
                            terms.append(" * ".join(f))
                    news.append(f"({' + '.join(terms)}) AS {_g(i, j)}")
            ctes.append(f"s{step} AS MATERIALIZED (SELECT mid, {', '.join(news)} FROM p{step})")
            cur = f"s{step}"
    unp = " UNION ALL ".join(
        f"SELECT mid, SQRT(GREATEST({_g(j, j)}, 0.0{D})) AS sig FROM {cur}" for j in range(n))
    return (
        "WITH " + ",\n".join(ctes) +
        f",\nu AS (SELECT mid, sig, ROW_NUMBER() OVER (PARTITION BY mid ORDER BY sig DESC) - 1 AS k FROM ({unp}) z)\n"
        f"SELECT mid AS {key}, CAST(k AS INTEGER) AS k, printf('{fmt}', sig) AS sigma FROM u"
    )


def wide_rounds_sql(state_sql: str, n: int, rounds: list[int], eps: float = DEFAULT_EPS) -> tuple[list[str], str]:
    """CTEs applying the listed rounds (indices into one sweep, repeatable) to a wide state.

    state columns: mid, kind ('A'/'V'), r, x0..x{n-1}, rot (BOOLEAN). Returns (ctes, last name).
    """
    sched = round_robin_pairs(n)
    ctes = [f"w0 AS MATERIALIZED ({state_sql})"]
    cur = "w0"
    for step, rnd in enumerate(rounds, start=1):
        pairs = sched[rnd]
        sums = []
        for k, (p, q) in enumerate(pairs):
            sums += [f"SUM(x{p} * x{p}) AS pp{k}", f"SUM(x{q} * x{q}) AS qq{k}", f"SUM(x{p} * x{q}) AS pq{k}"]
        params = []
        for k in range(len(pairs)):
            params += _params(f"pp{k}", f"qq{k}", f"pq{k}", eps, k)
        ctes.append(f"st{step} AS MATERIALIZED (SELECT mid, {', '.join(params)} FROM "
                    f"(SELECT mid, {', '.join(sums)} FROM {cur} WHERE kind = 'A' GROUP BY mid) z)")
        new = {j: f"x{j}" for j in range(n)}
        for k, (p, q) in enumerate(pairs):
            new[p] = f"CASE WHEN rot{k} THEN c{k} * x{p} - s{k} * x{q} ELSE x{p} END"
            new[q] = f"CASE WHEN rot{k} THEN s{k} * x{p} + c{k} * x{q} ELSE x{q} END"
        anyrot = " OR ".join(f"rot{k}" for k in range(len(pairs))) or "FALSE"
        sel = ", ".join(f"{new[j]} AS x{j}" for j in range(n))
        ctes.append(f"w{step} AS MATERIALIZED (SELECT s.mid, s.kind, s.r, {sel}, (s.rot OR {anyrot}) AS rot "
                    f"FROM {cur} s JOIN st{step} USING (mid))")
        cur = f"w{step}"
    return ctes, cur


def identity_rows_sql(ids_sql: str, n: int) -> str:
    xs = ", ".join(f"CASE WHEN r = {j} THEN 1.0{D} ELSE 0.0{D} END AS x{j}" for j in range(n))
    return f"SELECT mid, 'V' AS kind, CAST(r AS BIGINT) AS r, {xs}, FALSE AS rot FROM ({ids_sql}) i, range(0, {n}) AS t(r)"
