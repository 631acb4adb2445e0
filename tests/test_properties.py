"""Property tests of the kernel contract on random shapes and values (no Spark)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orthoflow.operators.kernels import DEFAULT_EPS, svd_stack


@st.composite
def stacks(draw):
    n = draw(st.integers(1, 7))
    m = draw(st.integers(n, 3 * n + 4))
    b = draw(st.integers(1, 4))
    seed = draw(st.integers(0, 2**32 - 1))
    scale = draw(st.sampled_from([1e-3, 1.0, 1e3]))
    return np.random.default_rng(seed).normal(size=(b, m, n)) * scale


@settings(max_examples=60, deadline=None)
@given(stacks())
def test_contract_holds(a):
    u, s, v, sweeps, conv = svd_stack(a)
    assert conv.all() and (sweeps >= 1).all()
    norm = np.linalg.norm(a, axis=(1, 2))
    recon = np.einsum("bmk,bk,bjk->bmj", u, s, v)
    assert (np.linalg.norm(recon - a, axis=(1, 2)) <= 1e-9 * np.maximum(norm, 1e-300) + 1e-300).all()
    n = a.shape[2]
    assert np.allclose(np.einsum("bki,bkj->bij", v, v), np.eye(n), atol=1e-12)
    for i in range(a.shape[0]):
        assert np.allclose(np.sort(s[i])[::-1], np.linalg.svd(a[i], compute_uv=False), rtol=1e-9, atol=1e-12 * norm[i])
    assert np.allclose((s ** 2).sum(axis=1), (a ** 2).sum(axis=(1, 2)), rtol=1e-12)
    assert np.all(u[np.broadcast_to((s <= DEFAULT_EPS)[:, None, :], u.shape)] == 0)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.lists(st.integers(0, 12), min_size=2, max_size=5), st.integers(0, 2**32 - 1))
def test_zero_padding_changes_nothing(n, extra_rows, seed):
    rng = np.random.default_rng(seed)
    mats = [rng.normal(size=(n + e, n)) for e in extra_rows]
    m_max = max(x.shape[0] for x in mats)
    stack = np.zeros((len(mats), m_max, n))
    for i, x in enumerate(mats):
        stack[i, : x.shape[0]] = x
    u, s, v, sweeps, conv = svd_stack(stack)
    for i, x in enumerate(mats):
        assert np.allclose(np.sort(s[i])[::-1], np.linalg.svd(x, compute_uv=False), rtol=1e-9)
        assert np.all(u[i, x.shape[0]:] == 0)
        recon = (u[i, : x.shape[0]] * s[i]) @ v[i].T
        assert np.abs(recon - x).max() <= 1e-9 * np.linalg.norm(x)
