"""Whitening against a dense eigensolver, and its eigensolver alone."""

import math

import numpy as np
import pytest

from orthoflow.llm import whitening as W


def sample(kind, n, d, seed):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.standard_normal((10, d))
        return centres[rng.integers(10, size=n)] + 0.5 * rng.standard_normal((n, d))
    if kind == "equal":  # all variances alike: eigenvalues lie close together
        return rng.standard_normal((n, d))
    if kind == "thin":
        return rng.standard_normal((n, 2)) @ rng.standard_normal((2, d))
    return rng.standard_normal((n, d)) * np.logspace(0, -5, d)


@pytest.mark.parametrize("kind", ["clusters", "equal", "thin", "steep"])
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_eigenpairs(kind, d):
    x = sample(kind, 800, d, 3)
    a = np.cov(x.T, bias=True).reshape(d, d)
    calls = []
    found = W.jacobi_davidson(lambda b: calls.append(b.shape) or a @ b, d, 4)
    values, vectors = np.linalg.eigh(a)
    k = min(4, d)
    assert np.allclose(found.values, values[::-1][:k], rtol=0, atol=1e-13 * values[-1])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(k), atol=1e-13)
    assert np.abs(a @ found.vectors - found.vectors * found.values).max() < 1e-11 * values[-1]
    assert len(calls) < 150 and max(s[1] for s in calls) <= 6


def test_minres():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    a = q @ np.diag(np.linspace(-2, 3, 30)) @ q.T
    b = rng.standard_normal((30, 3))
    assert np.allclose(a @ W.minres(lambda t: a @ t, b, 30, 1e-14), b, atol=1e-8)


def brute(rows, k=4):
    """(n, exact deviations, eigenvalues, trace, whitened up to sign) of [(id, vector or None)]."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in rows if v is not None), default=0)
    ints = [[math.floor(256 * c) for c in v] + [0] * (d - len(v)) for _, v in kept]
    fit = sorted(set(map(tuple, ints)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in ints]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        white = (np.array(ints, float) - np.array(sums) / n) @ vectors / np.sqrt(values)
    return kept, n, off, values, np.trace(centred.T @ centred / n), white


def compare(spark, rows, schema="vec_id long, embedding array<float>, n string, id int"):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema).repartition(3)
    rows = [(r[0], r[1]) for r in table.select("vec_id", "embedding").collect()]
    got = W.whiten(table, W.fit_whitening(table)).collect()
    kept, n, off, values, trace, white = brute(rows)
    k = len(values)
    assert len(got) == len(kept) * k
    want, have = {}, {}
    signs = np.ones(k)
    for j in range(k):
        first = next((r for r in got if r["component"] == j + 1 and r["whitened"] is not None and abs(r["whitened"]) > 1e-3), None)
        if first is not None:
            at = next(i for i, (v, _) in enumerate(kept) if v == first["vec_id"])
            signs[j] = np.sign(white[at, j] * first["whitened"])
    for (i, _), o, w in zip(kept, off, white, strict=True):
        for j in range(k):
            alive = values[j] > 1e-13 * trace
            want.setdefault((i, j + 1), []).append((o if o < 2**63 else None, round(w[j] * signs[j], 6) + 0.0 if alive else None))
    for r in got:
        assert r["n"] == n
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace if trace > 0 else 0, rel=1e-9, abs=1e-12)
        if r["identity_error"] is not None:
            assert r["identity_error"] < 1e-9
        have.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], None if r["whitened"] is None else round(r["whitened"], 6) + 0.0))
    order = lambda t: (t[0] is None, t[0] or 0, t[1] is None, t[1] or 0)
    assert have.keys() == want.keys()
    for key, rows_of in want.items():
        for a, b in zip(sorted(rows_of, key=order), sorted(have[key], key=order), strict=True):
            assert a[0] == b[0] and (a[1] is None) == (b[1] is None)
            assert a[1] is None or abs(a[1] - b[1]) < 5e-6, (key, a, b)
    return got


def test_whitening_messy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(sample("clusters", 300, 7, 2))]
    rows += [(1000 + i, rows[5][1]) for i in range(80)]  # copies count once in the fit
    rows += [(5, rows[5][1]), (None, rows[9][1]), (2000, None), (2001, [1.0] * 6 + [None]), (2002, [1.0] * 6 + [float("nan")]), (2003, [float("inf")] + [0.0] * 6)]
    rows += [(2004, []), (2005, [0.5]), (2006, [-0.0] * 7), (2007, [float(c) for c in rng.standard_normal(7) * 300])]
    got = compare(spark, rows)
    assert {r["component"] for r in got} == {1, 2, 3, 4}


def test_whitening_large_entries(spark):
    """Entries that need four and eight bytes, deviations beyond a long."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * (1e9 if i % 3 else 1e3)]) for i in range(60)]
    got = compare(spark, rows, "vec_id long, embedding array<double>, n string, id int")
    assert any(r["deviation"] is None for r in got)


def test_whitening_without_variance(spark):
    rows = [(i, [1.0, 2.0]) for i in range(4)]
    got = compare(spark, rows)
    assert len(got) == 8 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)]
    got = compare(spark, line)
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True), (3, True)}


def test_whitening_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(table, W.fit_whitening(table)).collect() == []
    table = spark.createDataFrame([(1, None), (2, [None])], "vec_id long, embedding array<float>")
    assert W.whiten(table, W.fit_whitening(table)).collect() == []


def test_sums_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(sample("steep", 200, 6, 8))]
    compare(spark, rows)


def test_registered_query(spark, sf):
    from orthoflow.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(out) == 4 * table.count()
    white = np.zeros((table.count(), 4))
    for r in out:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-4
    assert out[0]["identity_error"] < 1e-10
