"""Numerical contract of the Jacobi kernel (no Spark)."""

import numpy as np
import pytest

from orthoflow.operators.kernels import r_factor, round_robin_pairs, svd_stack


def test_schedule_n4_order_and_p_above_q():
    assert round_robin_pairs(4) == [[(0, 3), (1, 2)], [(0, 2), (3, 1)], [(0, 1), (2, 3)]]


@pytest.mark.parametrize("n", range(2, 40))
def test_schedule_covers_each_pair_once(n):
    seen = [tuple(sorted(p)) for rnd in round_robin_pairs(n) for p in rnd]
    assert len(seen) == len(set(seen)) == n * (n - 1) // 2
    for rnd in round_robin_pairs(n):
        cols = [c for p in rnd for c in p]
        assert len(cols) == len(set(cols))


def test_edge_sweeps():
    assert svd_stack(np.ones((1, 3, 1)))[3][0] == 1          # n = 1
    assert svd_stack(np.eye(4)[None])[3][0] == 1             # identity
    u, s, v, sw, cv = svd_stack(np.zeros((1, 6, 3)))         # zeros
    assert sw[0] == 1 and np.all(u == 0) and np.all(s == 0) and np.allclose(v[0], np.eye(3))


def test_uniform_64x32_contract():
    rng = np.random.default_rng(7)
    a = rng.uniform(-1, 1, (3, 64, 32))
    u, s, v, sw, cv = svd_stack(a)
    assert cv.all()
    recon = np.einsum("bmk,bk,bjk->bmj", u, s, v)
    assert np.abs(recon - a).max() <= 1e-9 * np.linalg.norm(a[0])
    assert np.allclose(np.einsum("bki,bkj->bij", v, v), np.eye(32), atol=1e-12)
    assert np.allclose(np.sort(s[0])[::-1], np.linalg.svd(a[0], compute_uv=False), rtol=1e-12)
    assert np.allclose((s ** 2).sum(axis=1), (a ** 2).sum(axis=(1, 2)))


def test_absolute_cutoff_and_rank_deficiency():
    rng = np.random.default_rng(3)
    tiny = rng.uniform(-1, 1, (1, 20, 4)) * 1e-12
    u, s, _, _, _ = svd_stack(tiny)
    assert np.all(u == 0)
    a = rng.normal(size=(1, 40, 8))
    a[0, :, 5] = a[0, :, 2]                                  # duplicate column
    u, s, _, _, _ = svd_stack(a)
    assert (s < 1e-9).sum() == 1


def test_nan_column_never_rotates():
    a = np.random.default_rng(1).normal(size=(1, 10, 3))
    a[0, 4, 1] = np.nan
    u, s, v, sw, cv = svd_stack(a)
    assert s[0, 1] == 0 and np.all(u[0, :, 1] == 0)


def test_r_factor_keeps_singular_values():
    a = np.random.default_rng(5).normal(size=(500, 6))
    r = r_factor(a)
    assert r.shape == (6, 6)
    assert np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(a, compute_uv=False))


def test_local_r_folds_many_matrices(monkeypatch):
    """The per-task partial R keeps singular values when the task-wide fold kicks in."""
    import pandas as pd

    from orthoflow.operators import svd

    monkeypatch.setattr(svd, "TASK_HELD_ROWS", 50)
    rng = np.random.default_rng(11)
    mats = {mid: rng.normal(size=(int(rng.integers(5, 40)), 3)) for mid in range(30)}
    rows = [(mid, list(x)) for mid, a in mats.items() for x in a]
    rng.shuffle(rows)
    batches = [pd.DataFrame(rows[i:i + 37], columns=["matrix_id", "x"]) for i in range(0, len(rows), 37)]
    import pyarrow as pa
    out = pd.concat([b.to_pandas() for b in svd._local_r(iter([pa.RecordBatch.from_pandas(x, preserve_index=False) for x in batches]))])
    for rec in out.itertuples():
        r = np.asarray(rec.r_cells).reshape(rec.r_rows, 3)
        assert rec.n_rows == len(mats[rec.matrix_id])
        assert np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(mats[rec.matrix_id], compute_uv=False))


def ill(m, n, condition, seed=0):
    rng = np.random.default_rng(seed)
    u, v = np.linalg.qr(rng.normal(size=(m, n)))[0], np.linalg.qr(rng.normal(size=(n, n)))[0]
    return (u * np.geomspace(1.0, 1.0 / condition, n)) @ v.T


def test_u_is_orthogonal_at_any_condition():
    for condition in (1e2, 1e8, 1e10):
        for m, n in ((64, 16), (20, 16), (16, 16)):
            a = ill(m, n, condition)
            u, s, v, _, _ = svd_stack(a[None], eps=1e-14)
            assert np.abs(u[0].T @ u[0] - np.eye(n)).max() <= 2e-9
            assert np.abs((u[0] * s[0]) @ v[0].T - a).max() <= 1e-12


def test_non_finite_columns_by_the_contract():
    """The batch solve on R equals the direct rotation of A, column by column."""
    a = np.random.default_rng(2).normal(size=(1, 10, 4))
    a[0, 4, 1], a[0, 2, 3] = np.nan, -np.inf
    u, s, v, _, conv = svd_stack(a)
    assert conv.all() and s[0, 1] == 0 and np.isinf(s[0, 3])
    assert np.all(u[0, :, 1] == 0) and np.isnan(u[0, 2, 3]) and np.all(np.delete(u[0, :, 3], 2) == 0)
    assert np.array_equal(v[0, :, [1, 3]], np.eye(4)[[1, 3]])
    u2, s2, _, _, _ = svd_stack(a[:, :, [0, 2]])
    assert np.allclose(s[0, [0, 2]], s2[0]) and np.allclose(u[0][:, [0, 2]], u2[0])
