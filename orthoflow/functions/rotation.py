"""Scalar column functions of the rotation contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthoflow.operators.kernels import TINY_PQ


def positive_mod(value: Column, modulus: Column | int) -> Column:
    """non-negative modulo."""
    return F.pmod(value, modulus if isinstance(modulus, Column) else F.lit(modulus))


def round_robin_column_at(position: Column, rnd: Column, n: Column) -> Column:
    """column index at a circle position in a round; NULL marks the dummy column."""
    even_n = n + F.pmod(n, F.lit(2))
    col = F.when(position == 0, F.lit(0)).otherwise(1 + F.pmod(position - 1 - rnd, even_n - 1))
    return F.when(col < n, col)


def rotation_needed(pp: Column, qq: Column, pq: Column, eps: float) -> Column:
    """P5: |pq| > eps*sqrt(max(pp,0)*max(qq,0)) and |pq| > 1e-300; NaN never rotates."""
    rhs = F.lit(eps) * F.sqrt(fmax0(pp) * fmax0(qq))
    return (
        ~F.isnan(pq) & pq.isNotNull() & ~F.isnan(rhs)
        & (F.abs(pq) > rhs) & (F.abs(pq) > F.lit(TINY_PQ))
    )


def fmax0(x: Column) -> Column:
    """C fmax(x, 0): NaN gives 0 (Spark's greatest would give NaN)."""
    return F.when(F.isnan(x) | (x < 0), F.lit(0.0)).otherwise(x)


def rotation_params(pp: Column, qq: Column, pq: Column, eps: float) -> tuple[Column, Column, Column]:
    """(rotate, c, s). tau is computed only inside the branch that tested pq (ANSI-safe)."""
    rot = rotation_needed(pp, qq, pq, eps)
    tau = (qq - pp) / (F.lit(2.0) * pq)
    root = F.sqrt(F.lit(1.0) + tau * tau)
    t = F.when(tau >= 0, F.lit(1.0) / (tau + root)).otherwise(F.lit(-1.0) / (-tau + root))
    c = F.lit(1.0) / F.sqrt(F.lit(1.0) + t * t)
    return rot, F.when(rot, c).otherwise(F.lit(1.0)), F.when(rot, t * c).otherwise(F.lit(0.0))


def keep_if_ranked(v: Column, sigma: Column, eps: float) -> Column:
    """V / sigma where sigma > eps (NaN is not), else 0."""
    return F.when((sigma > F.lit(eps)) & ~F.isnan(sigma), v / sigma).otherwise(F.lit(0.0))
