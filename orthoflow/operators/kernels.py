"""Numpy bodies run inside Spark tasks (mapInPandas / applyInPandas).

Everything here works on a stack of equal-shape matrices at once, so one Arrow batch
of many small matrices is solved with a handful of vectorised numpy calls per round.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the rotation contract.
DEFAULT_EPS = 1e-9
DEFAULT_MAX_SWEEPS = 128
TINY_PQ = 1.0e-300


def round_robin_pairs(n: int) -> list[list[tuple[int, int]]]:
    """Pairs (p, q) of every round of one sweep for n columns (p may exceed q)."""
    even_n = n + (n & 1)
    ring = even_n - 1
    rounds = []
    for rnd in range(max(ring, 0)):
        pairs = []
        for slot in range(even_n // 2):
            p = _column_at(slot, rnd, ring)
            q = _column_at(even_n - 1 - slot, rnd, ring)
            if p < n and q < n:
                pairs.append((p, q))
        rounds.append(pairs)
    return rounds


def _column_at(position: int, rnd: int, ring: int) -> int:
    if position == 0:
        return 0
    return 1 + (position - 1 - rnd) % ring


def _rotation(pp, qq, pq, eps):
    """Rotation mask and (c, s) for arrays of pair statistics; NaN never rotates."""
    rhs = eps * np.sqrt(np.fmax(pp, 0.0) * np.fmax(qq, 0.0))
    apq = np.abs(pq)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        rot = (apq > rhs) & (apq > TINY_PQ)
        safe_pq = np.where(rot, pq, 1.0)
        tau = (qq - pp) / (2.0 * safe_pq)
        root = np.sqrt(1.0 + tau * tau)
        t = np.where(tau >= 0.0, 1.0 / (tau + root), -1.0 / (-tau + root))
        c = 1.0 / np.sqrt(1.0 + t * t)
        s = t * c
    return rot, c, s


def jacobi_rounds(a: np.ndarray, rounds: list[list[tuple[int, int]]], eps: float = DEFAULT_EPS):
    """The given rounds of pairs on a stack (B, m, n): (rotated stack, product of the rotations, whether
    anything rotated per matrix)."""
    a = np.array(a, dtype=np.float64, copy=True)
    v = np.broadcast_to(np.eye(a.shape[2]), (a.shape[0], a.shape[2], a.shape[2])).copy()
    rotated = np.zeros(a.shape[0], dtype=bool)
    for pairs in rounds:
        if pairs:
            p, q = (np.array(i, dtype=np.int64) for i in zip(*pairs, strict=True))
            rotated |= _rotate_round(a, v, p, q, eps)
    return a, v, rotated


def _rotate_round(aa: np.ndarray, vv: np.ndarray, pidx: np.ndarray, qidx: np.ndarray, eps: float) -> np.ndarray:
    """One round on stacks of A and V, in place; whether anything rotated, per matrix."""
    ap, aq = aa[:, :, pidx], aa[:, :, qidx]
    pp = np.einsum("bmk,bmk->bk", ap, ap)
    qq = np.einsum("bmk,bmk->bk", aq, aq)
    pq = np.einsum("bmk,bmk->bk", ap, aq)
    rot, c, s = _rotation(pp, qq, pq, eps)
    if rot.any():
        m3, c3, s3 = rot[:, None, :], c[:, None, :], s[:, None, :]
        vp, vq = vv[:, :, pidx], vv[:, :, qidx]
        aa[:, :, pidx] = np.where(m3, c3 * ap - s3 * aq, ap)
        aa[:, :, qidx] = np.where(m3, s3 * ap + c3 * aq, aq)
        vv[:, :, pidx] = np.where(m3, c3 * vp - s3 * vq, vp)
        vv[:, :, qidx] = np.where(m3, s3 * vp + c3 * vq, vq)
    return rot.any(axis=1)


def jacobi_stack(a: np.ndarray, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS):
    """One-sided Jacobi on a stack ``a`` of shape (B, m, n).

    Returns (a_rotated, v, sweeps, converged). Matrices that finish early stop
    counting sweeps; their later sweeps would not rotate, so they are dropped
    from the active set.
    """
    a = np.array(a, dtype=np.float64, copy=True)
    bsz, _, n = a.shape
    v = np.broadcast_to(np.eye(n), (bsz, n, n)).copy()
    sweeps = np.zeros(bsz, dtype=np.int32)
    converged = np.zeros(bsz, dtype=bool)
    rounds = [
        (np.array([p for p, _ in pr], dtype=np.int64), np.array([q for _, q in pr], dtype=np.int64))
        for pr in round_robin_pairs(n)
    ]
    active = np.arange(bsz)
    for sweep in range(max_sweeps):
        if active.size == 0:
            break
        aa = a[active]
        vv = v[active]
        rotated = np.zeros(active.size, dtype=bool)
        for pidx, qidx in rounds:
            if pidx.size == 0:
                continue
            rotated |= _rotate_round(aa, vv, pidx, qidx, eps)
        a[active] = aa
        v[active] = vv
        sweeps[active] = sweep + 1
        done = ~rotated
        converged[active[done]] = True
        active = active[rotated]
    return a, v, sweeps, converged


def column_norms(a: np.ndarray) -> np.ndarray:
    """sigma_j = sqrt(max(sum a_ij^2, 0)) along the row axis; NaN columns give 0."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(np.fmax(np.einsum("...mk,...mk->...k", a, a), 0.0))


def u_from_rotated(a_rot: np.ndarray, sigma: np.ndarray, eps: float) -> np.ndarray:
    """U_j = A_j / sigma_j where sigma_j > eps, else the zero column (absolute cut-off)."""
    keep = sigma > eps
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        u = a_rot / np.where(keep, sigma, 1.0)[..., None, :]
    return np.where(keep[..., None, :], u, 0.0)


# What a column holds; a column that is not finite never rotates.
FINITE, INFINITE, NOT_A_NUMBER = 0, 1, 2


def column_flags(a: np.ndarray) -> np.ndarray:
    """FINITE, INFINITE or NOT_A_NUMBER per column (row axis second to last)."""
    if np.isfinite(a).all():
        return np.zeros(a.shape[:-2] + a.shape[-1:], dtype=np.int8)
    return np.where(np.isnan(a).any(axis=-2), NOT_A_NUMBER, np.where(np.isinf(a).any(axis=-2), INFINITE, FINITE)).astype(np.int8)


def flagged_sigma(sigma: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Norms by the contract: infinite for an infinite column, 0 for one with NaN."""
    return np.where(flags == INFINITE, np.inf, np.where(flags == NOT_A_NUMBER, 0.0, sigma))


def flagged_sigma_sql(sigma, flag):
    """The same as a column expression, for one column of a matrix."""
    from pyspark.sql import functions as F

    return F.when(flag == INFINITE, F.lit(float("inf"))).when(flag == NOT_A_NUMBER, F.lit(0.0)).otherwise(sigma)


def divide_infinite(u: np.ndarray, a: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """``u`` with the columns of infinite norm taken as a / sigma (0 for finite cells, else NaN)."""
    wide = np.isinf(sigma)[..., None, :]
    if not wide.any():
        return u
    with np.errstate(invalid="ignore"):
        return np.where(wide, a / np.where(wide, np.inf, 1.0), u)


def svd_stack(a: np.ndarray, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS, with_u: bool = True):
    """(u, sigma, v, sweeps, converged) for a stack (B, m, n), m >= n; sigma in column order. Without U
    no Q is formed, and u is None.

    The n x n R of a batched QR is rotated instead of A: the pair statistics of R equal those
    of A (R^T R = A^T A), so the rotations, sweeps and V are the same in exact arithmetic. With
    R_rot = R V, sigma are its column norms and U = Q (R_rot / sigma): orthogonal to working
    precision at any condition, since Q is and the rotated R's columns are by convergence.

    Rows of zeros at the end change nothing, so matrices of one width and different heights may
    share a zero-padded stack. Columns with NaN or Inf never rotate: they are set to zero for
    the solve and take their norm from the flag.
    """
    a = np.asarray(a, dtype=np.float64)
    flags = column_flags(a)
    clean = np.where(flags[..., None, :] > FINITE, 0.0, a) if flags.any() else a
    q, r = np.linalg.qr(clean) if with_u else (None, np.linalg.qr(clean, mode="r"))
    r_rot, v, sweeps, converged = jacobi_stack(r, eps, max_sweeps)
    sigma = column_norms(r_rot)
    if not with_u:
        return None, flagged_sigma(sigma, flags), v, sweeps, converged
    u = q @ u_from_rotated(r_rot, sigma, eps)
    sigma = flagged_sigma(sigma, flags)
    return divide_infinite(u, a, sigma), sigma, v, sweeps, converged


def r_factor(block: np.ndarray) -> np.ndarray:
    """R of a finite row block (k, n): at most n rows.

    A block with k <= n rows is already as small as its R and is returned unchanged,
    so the exact rows travel on and no rounding is added for short blocks.
    """
    k, n = block.shape
    if k <= n:
        return np.array(block, dtype=np.float64)
    return np.linalg.qr(block, mode="r")
