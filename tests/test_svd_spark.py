"""The three strategies agree; checks (D9) hold; validation fails fast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflow.operators import checks, forms, steps, svd
from orthoflow.plans import fixtures as fx


def _sig(df):
    return {r["matrix_id"]: np.array(r["sigma"]) for r in df.select("matrix_id", "sigma").collect()}


def test_batch_tall_relational_agree(spark, sf):
    packed = fx.embedding_packed(spark, sf, 16, 4).filter(F.col("matrix_id") < 40)
    b = _sig(svd.svd(packed, strategy="batch"))
    t = _sig(svd.svd(packed, strategy="tall"))
    r = _sig(svd.svd(packed, strategy="relational", max_sweeps=20))
    for k in b:
        assert np.allclose(b[k], t[k], rtol=1e-10)
        assert np.allclose(b[k], r[k], rtol=1e-10)


def test_auto_rows_matches_numpy(spark, sf):
    rows = fx.lineitem_rows(spark, sf, "supplier", fx.LI4_COLUMNS)
    got = _sig(svd.svd_auto_rows(rows, tall_min_rows=600))
    pdf = rows.toPandas()
    for mid, grp in pdf.groupby("matrix_id"):
        a = np.stack(grp["x"].tolist())
        assert np.allclose(np.sort(got[mid])[::-1], np.linalg.svd(a, compute_uv=False), rtol=1e-9)


def test_tall_u_reconstructs(spark, sf):
    rows = fx.lineitem_rows(spark, sf, "flag", fx.LI4_COLUMNS)
    factors, u = svd.svd_rows(rows)
    xh = checks.reconstruct_rows(u, factors).join(rows, ["matrix_id", "r"])
    err = xh.select(F.max(F.aggregate(F.zip_with("x_hat", "x", lambda a, b: F.abs(a - b)), F.lit(0.0),
                                      lambda acc, d: F.greatest(acc, d)))).first()[0]
    assert err < 1e-6


def test_validation_raises(spark):
    bad = spark.createDataFrame([(1, 2, 3, [1.0] * 6)], "matrix_id long, n_rows long, n_cols long, cells array<double>")
    good, _ = forms.validate_packed(bad, strict=True)
    with pytest.raises(Exception):
        good.collect()
    ok, rejected = forms.validate_packed(bad, strict=False)
    assert ok.count() == 0 and rejected.first()["reject_reason"] == "rows < columns"


def test_schedule_frame_matches_kernel(spark):
    from orthoflow.operators.kernels import round_robin_pairs

    sched = steps.schedule_frame(spark.range(2, 13).select(F.col("id").cast("int").alias("n"))).collect()
    got = {}
    for r in sched:
        got.setdefault((r["n"], r["round"]), []).append((r["slot"], (r["p"], r["q"])))
    for n in range(2, 13):
        for rnd, pairs in enumerate(round_robin_pairs(n)):
            assert [p for _, p in sorted(got.get((n, rnd), []))] == pairs


def test_auto_packed_routes_big_matrix_to_tall(spark):
    rng = np.random.default_rng(9)
    mats = {1: rng.normal(size=(300, 256)), 2: rng.normal(size=(12, 5)), 3: rng.normal(size=(30, 30))}
    df = spark.createDataFrame([(k, a.shape[0], a.shape[1], a.ravel().tolist()) for k, a in mats.items()],
                               "matrix_id long, n_rows long, n_cols long, cells array<double>")
    assert df.filter(svd.strategy_column() == "tall").count() == 1
    got = _sig(svd.svd(df, strategy="auto", with_u=False))
    for k, a in mats.items():
        assert np.allclose(np.sort(got[k])[::-1], np.linalg.svd(a, compute_uv=False), rtol=1e-9)


def test_batch_mixed_heights_and_nan(spark):
    from orthoflow.operators.kernels import svd_stack

    rng = np.random.default_rng(21)
    mats = {i: rng.normal(size=(int(rng.integers(6, 40)), 6)) for i in range(12)}
    mats[5][3, 2] = np.nan
    df = spark.createDataFrame([(k, a.shape[0], a.shape[1], a.ravel().tolist()) for k, a in mats.items()],
                               "matrix_id long, n_rows long, n_cols long, cells array<double>")
    res = {r["matrix_id"]: r for r in svd.svd(df, strategy="batch").collect()}
    for k, a in mats.items():
        u, s, v, sw, cv = svd_stack(a[None])
        r = res[k]
        assert r["sweeps"] == sw[0]
        assert np.allclose(r["sigma"], s[0], rtol=1e-9, equal_nan=True)
        if k != 5:
            recon = np.array(r["u"]).reshape(a.shape) * np.array(r["sigma"]) @ np.array(r["v"]).reshape(6, 6).T
            assert np.abs(recon - a).max() < 1e-9


def test_gram_blocked_matches_gram(spark, sf):
    rows = fx.lineitem_rows(spark, sf, "supplier", fx.LI4_COLUMNS).repartition(5)
    a = {(r["matrix_id"], r["i"], r["j"]): r["g"] for r in steps.gram(rows, 4).collect()}
    b = {(r["matrix_id"], r["i"], r["j"]): r["g"] for r in steps.gram_blocked(rows).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1e-9 * max(1.0, abs(a[k])) for k in a)


def test_auto_rows_with_u_reconstructs(spark, sf):
    rows = fx.lineitem_rows(spark, sf, "supplier", fx.LI4_COLUMNS)
    factors, u = svd.svd_auto_rows(rows, tall_min_rows=600, with_u=True)
    strategies = {r[0] for r in factors.select("strategy").distinct().collect()}
    assert strategies == {"batch", "tall"}
    xh = checks.reconstruct_rows(u, factors).join(rows, ["matrix_id", "r"])
    assert xh.count() == rows.count()
    err = xh.select(F.max(F.aggregate(F.zip_with("x_hat", "x", lambda a, b: F.abs(a - b)), F.lit(0.0),
                                      lambda acc, d: F.greatest(acc, d)))).first()[0]
    assert err < 1e-6


def test_max_sweeps_is_silent_and_wide_is_rejected(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 8))
    df = spark.createDataFrame([(1, 20, 8, a.ravel().tolist())], "matrix_id long, n_rows long, n_cols long, cells array<double>")
    r = svd.svd(df, strategy="batch", max_sweeps=1).first()
    assert r["sweeps"] == 1 and r["converged"] is False
    r = svd.svd(df, strategy="batch").first()
    assert r["converged"] is True and r["sweeps"] > 1
    wide = spark.createDataFrame([(2, 3, 5, [0.0] * 15)], "matrix_id long, n_rows long, n_cols long, cells array<double>")
    with pytest.raises(Exception, match="rows < columns"):
        svd.svd(wide, strategy="batch").collect()
    with pytest.raises(ValueError):
        svd.svd(df, eps=0.0)


def test_tsqr_two_level_tree(spark, sf):
    """More than 64 input partitions: the salted first combine level runs too."""
    rows = fx.lineitem_rows(spark, sf, "flag", fx.LI4_COLUMNS).repartition(100)
    got = _sig(svd.tall_factors(rows))
    pdf = rows.toPandas()
    for mid, grp in pdf.groupby("matrix_id"):
        a = np.stack(grp["x"].tolist())
        assert np.allclose(np.sort(got[mid])[::-1], np.linalg.svd(a, compute_uv=False), rtol=1e-9)


def test_flagship_plan_prunes_and_shuffles_once(spark, sf):
    """Scale guard: the TSQR flagship reads only the columns it needs and shuffles only the
    small R factors (one exchange; no sort, no join of the rows)."""
    rows = fx.lineitem_rows(spark, sf, "flag", fx.LI4_COLUMNS)
    plan = svd.tall_factors(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    for unused in ("l_orderkey", "l_partkey", "l_shipdate", "l_linestatus", "l_suppkey"):
        assert unused not in scan


def test_batch_plan_has_no_exchange(spark, sf):
    """Scale guard: packed matrices are solved where they are read (no shuffle)."""
    plan = svd.svd(fx.embedding_packed(spark, sf, 16, 4), strategy="batch")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def _packed(spark, mats):
    return spark.createDataFrame([(k, a.shape[0], a.shape[1], a.ravel().tolist()) for k, a in mats.items()],
                                 "matrix_id long, n_rows long, n_cols long, cells array<double>")


def _dense(rows, n):
    out = {}
    for r in rows:
        out.setdefault(r["matrix_id"], {})[r["r"]] = r["u"]
    return {k: np.array([v[i] for i in sorted(v)]).reshape(-1, n) for k, v in out.items()}


def test_routes_agree_on_non_finite_and_ill_conditioned(spark):
    from test_kernels import ill

    mats = {1: np.random.default_rng(4).normal(size=(30, 5)), 2: ill(40, 5, 1e8), 3: np.random.default_rng(5).normal(size=(12, 5))}
    mats[1][3, 2], mats[3][0, 0], mats[3][5, 4] = np.nan, np.inf, np.nan
    df = _packed(spark, mats).repartition(3)
    got = {s: {r["matrix_id"]: r for r in svd.svd(df, strategy=s).collect()} for s in ("batch", "tall", "relational")}
    for k, a in mats.items():
        ref = got["batch"][k]
        for s in ("tall", "relational"):
            assert np.allclose(got[s][k]["sigma"], ref["sigma"], rtol=1e-6, atol=1e-12)
            assert np.allclose(got[s][k]["u"], ref["u"], atol=1e-5, equal_nan=True)
    for s in ("batch", "tall"):
        u = np.array(got[s][2]["u"]).reshape(40, 5)
        assert np.abs(u.T @ u - np.eye(5)).max() <= 2e-9


def test_factors_travel_once_per_run(spark, monkeypatch):
    """Beyond the broadcast bound the factors go in front of the rows; the result is the same."""
    rng = np.random.default_rng(6)
    mats = {k: rng.normal(size=(50 + k, 4)) for k in range(6)}
    rows = forms.packed_to_rows(_packed(spark, mats)).repartition(3)
    factors, u = svd.svd_rows(rows)
    one = _dense(u.collect(), 4)
    monkeypatch.setattr(svd, "BROADCAST_FACTOR_BYTES", 0)
    monkeypatch.setattr(svd, "ROWS_PER_SALT", 7)
    two_frame = svd.tall_u(rows, factors)
    two = _dense(two_frame.collect(), 4)
    assert all(np.allclose(one[k], two[k]) for k in mats)


def test_nan_rows_do_not_grow_r(spark):
    a = np.random.default_rng(7).normal(size=(4000, 4))
    a[17, 1] = np.nan
    rows = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(a)], "matrix_id long, r long, x array<double>").repartition(2)
    assert svd.r_factors(rows).first()["r_rows"] == 4


def test_settings_are_checked(spark):
    rows = spark.createDataFrame([(1, 0, [1.0])], "matrix_id long, r long, x array<double>")
    packed = _packed(spark, {1: np.eye(2)})
    for call in (lambda: svd.svd_rows(rows, eps=-1), lambda: svd.svd_batch(packed, max_sweeps=0), lambda: svd.svd_auto_rows(rows, eps=0), lambda: svd.tall_factors(rows, max_sweeps=-3)):
        with pytest.raises(ValueError):
            call()


def test_relational_on_no_matrices(spark):
    assert svd.svd(_packed(spark, {1: np.eye(2)}).limit(0), strategy="relational").count() == 0


def test_checks_hold_no_matrix_beside_a_row(spark):
    """Reconstruction and Freivalds' check agree with numpy; V is never joined to rows."""
    rng = np.random.default_rng(8)
    mats = {k: rng.normal(size=(40 + k, 5)) for k in range(4)}
    rows = forms.packed_to_rows(_packed(spark, mats)).repartition(3)
    factors, u = svd.svd_rows(rows)
    back = checks.reconstruct_rows(u, factors)
    got = _dense(back.withColumnRenamed("x_hat", "u").collect(), 5)
    assert all(np.allclose(got[k], a, atol=1e-12) for k, a in mats.items())
    assert "Join" not in back._jdf.queryExecution().executedPlan().toString()
    ok = checks.freivalds(rows, u, factors)
    assert all(r["residual"] < 1e-12 * r["size"] for r in ok.collect())
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and not any(" v#" in line for line in joins)
    v = np.array(factors.filter("matrix_id = 2").first()["v"])
    wrong = factors.withColumn("v", F.when(F.col("matrix_id") == 2, F.array(*[F.lit(float(x)) for x in v + 1e-6])).otherwise(F.col("v")))
    bad = {r["matrix_id"]: r["residual"] > 1e-9 * r["size"] for r in checks.freivalds(rows, u, wrong).collect()}
    assert bad == {0: False, 1: False, 2: True, 3: False}
    missing = checks.freivalds(rows, u.filter("not (matrix_id = 1 and r = 3)"), factors).collect()
    assert {r["matrix_id"] for r in missing if r["residual"] == float("inf")} == {1}
    vg = {(r["matrix_id"], r["i"], r["j"]): r["g"] for r in checks.v_gram(factors).collect()}
    assert len(vg) == 100 and all(abs(g - (i == j)) < 1e-12 for (_, i, j), g in vg.items())


def test_sweep_touches_the_rows_once(spark):
    """A sweep on the triangular factor equals the rounds on the rows one by one."""
    rng = np.random.default_rng(12)
    mats = {1: rng.normal(size=(30, 5)), 2: rng.normal(size=(6, 5)), 3: np.diag([1.0, 2, 3, 4, 5])}
    mats[1][4, 2] = np.nan
    rows = forms.packed_to_rows(_packed(spark, mats)).repartition(3)
    state = steps.initial_state(rows, 5)
    swept = steps.jacobi_sweep(state, 5)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    # no row is exploded by pair, and nothing is kept between rounds: the rows are read once more
    assert plan.count("Generate") <= state._jdf.queryExecution().executedPlan().toString().count("Generate") and "InMemory" not in plan
    one = state
    for k in range(5):
        one = steps.jacobi_round(one, 5, k, broadcast_stats=True)
    want = {(r["matrix_id"], r["kind"], r["r"]): (r["x"], r["rot"]) for r in one.collect()}
    got = {(r["matrix_id"], r["kind"], r["r"]): (r["x"], r["rot"]) for r in swept.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k][0], want[k][0], atol=1e-10, equal_nan=True), k
        assert got[k][1] == want[k][1]


def test_pair_stats_wide_and_narrow(spark):
    rng = np.random.default_rng(13)
    for n in (6, 40):
        a = rng.normal(size=(25, n))
        rows = forms.packed_to_rows(_packed(spark, {1: a, 2: a * 2})).repartition(2)
        got = steps.sweep_pair_stats(rows, n)
        assert n > 32 or "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()
        seen = set()
        for r in got.collect():
            b = a * r["matrix_id"]
            seen.add((r["matrix_id"], r["p"], r["q"]))
            assert np.allclose([r["pp"], r["qq"], r["pq"]], [b[:, r["p"]] @ b[:, r["p"]], b[:, r["q"]] @ b[:, r["q"]], b[:, r["p"]] @ b[:, r["q"]]])
        assert len(seen) == n * (n - 1)


def test_auto_rows_in_one_pass(spark, sf):
    """The route is decided inside the solve: one scan, one exchange, no job while the plan is built."""
    rows = fx.lineitem_rows(spark, sf, "supplier", fx.LI4_COLUMNS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("auto-build", "auto-build")
    auto = svd.svd_auto_rows(rows)
    plan = auto._jdf.queryExecution().executedPlan().toString()
    assert not tracker.getJobIdsForGroup("auto-build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_rows_of_many_matrices_leave_as_one_batch():
    """Mixed rows of many matrices go through one stacked product, not a batch and product per matrix."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    factors = {k: (rng.normal(size=4), rng.normal(size=(4, 4)), np.eye(4)) for k in range(500)}
    tables = svd._factor_stacks(list(factors), [np.concatenate([x.ravel() for x in f]) for f in factors.values()])
    x = rng.normal(size=(1000, 4))
    mids = np.arange(1000) % 501  # 500 has no factors and is left out

    class Sent:
        value = tables

    batch = pa.RecordBatch.from_arrays([pa.array(mids), pa.array(np.arange(1000)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["matrix_id", "r", "x"])
    made = list(svd._mapped_rows(lambda u, s, v, _: (u * s[..., None, :]) @ np.swapaxes(v, -1, -2), "y", Sent)(iter([batch])))
    assert len(made) == 1
    got = made[0].to_pydict()
    assert got["r"] == [i for i in range(1000) if mids[i] != 500]
    for k, r, y in zip(got["matrix_id"], got["r"], got["y"], strict=True):
        assert k == mids[r] and np.allclose(y, (x[r] * factors[k][0]) @ factors[k][1].T)


def test_rows_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    from orthoflow.operators import checks

    monkeypatch.setattr(checks, "ROWS_PER_TASK", 10)
    rows = spark.range(300).select(F.lit(1).cast("bigint").alias("matrix_id"), F.col("id").alias("r"))
    factors = rows.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n_rows"))
    assert checks.by_row(factors, rows)[0].rdd.getNumPartitions() == 30
