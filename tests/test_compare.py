"""Sweep-line concurrency (W6) against a brute-force count on random intervals."""

import numpy as np
import pytest

from orthoflow.operators import compare


def _brute(iv):
    pts = sorted({t for s, e in iv for t in (s, e)})
    span = pts[-1] - pts[0]
    area, ge2, mx = 0.0, 0.0, 0
    for a, b in zip(pts, pts[1:]):
        act = sum(1 for s, e in iv if s <= a and e > a)
        area += act * (b - a)
        ge2 += (b - a) if act >= 2 else 0
        mx = max(mx, act)
    mx = max(mx, max(sum(1 for s, e in iv if s <= t and e > t) for t in pts))
    return span, mx, area / span, ge2 / span


def test_concurrency_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in ("a", "b"):
        for _ in range(60):
            s = int(rng.integers(0, 500))
            rows.append((g, s, s + int(rng.integers(0, 80))))
    df = spark.createDataFrame(rows, "g string, s long, e long")
    got = {r["g"]: r for r in compare.concurrency(df, "g", "s", "e", buckets=7).collect()}
    for g in ("a", "b"):
        span, mx, avg, ge2 = _brute([(s, e) for gg, s, e in rows if gg == g])
        r = got[g]
        assert r["span"] == span and r["max_active"] == mx
        assert abs(r["avg_active"] - avg) < 1e-12 and abs(r["share_ge2"] - ge2) < 1e-12


def test_exact_median(spark):
    import statistics

    from orthoflow.operators.quantile import exact_median

    rng = np.random.default_rng(8)
    rows = [(None if i % 50 == 0 else f"k{int(rng.integers(4))}", float(rng.integers(-5, 6)) if i % 3 else None) for i in range(600)]
    rows += [("hot", float(x)) for x in rng.normal(size=901)] + [("one", 2.5), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_threads_count_once(spark):
    """Nested calls of one thread are one busy stretch."""
    calls = [("g", 1, 0, 10), ("g", 1, 2, 5), ("g", 1, 8, 12), ("g", 2, 4, 6), ("g", 3, 5, 6), ("h", 1, 0, 4)]
    df = spark.createDataFrame(calls, "g string, thread long, s long, e long")
    got = {r.g: r for r in compare.thread_concurrency(df, "g", "thread", "s", "e").collect()}
    assert (got["g"].threads, got["g"].max_active, got["g"].span) == (3, 3, 12)
    assert abs(got["g"].share_ge2 - 2 / 12) < 1e-12 and got["h"].max_active == 1


def test_busy_intervals_of_a_long_thread(spark):
    """One thread has nearly all intervals; they are joined bucket by bucket."""
    import random

    rng = random.Random(1)
    rows = [("p", "long", s := rng.randrange(50_000), s + rng.choice([0, 1, 3, 40, 3000 if rng.random() < 0.01 else 2])) for _ in range(6000)]
    rows += [("p", f"t{i % 9}", s := rng.randrange(50_000), s + rng.randrange(9)) for i in range(500)] + [("p", None, 5, 9), (None, "x", 1, 2), ("p", None, 9, 12)]
    frame = spark.createDataFrame(rows, "g string, t string, s long, e long").repartition(6)
    want = set()
    for key in {r[:2] for r in rows}:
        run = None
        for s, e in sorted(r[2:] for r in rows if r[:2] == key):
            if run is None or s > run[1]:
                if run:
                    want.add((*key, *run))
                run = (s, e)
            run = (run[0], max(run[1], e))
        want.add((*key, *run))
    for buckets in (2, 7, 256):
        got = compare.busy_intervals(frame, "g", "t", "s", "e", buckets)
        assert {(r["g"], r["t"], r["s"], r["e"]) for r in got.collect()} == want
        assert got.count() == len(want)


def test_thread_intervals_are_read_once(spark, monkeypatch):
    """The intervals are computed once, however many buckets their number asks for."""
    monkeypatch.setattr(compare, "BUSY_ROWS", 50, raising=False)
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("p", "long", 3 * i, 3 * i + (2 if i % 4 else 3)) for i in range(800)] + [("p", "short", 0, 4), (None, "x", 1, 2)]
    schema = "g string, t string, s long, e long"
    frame = spark.createDataFrame(rows, schema).repartition(3).mapInArrow(watched, schema)
    got = compare.thread_concurrency(frame, "g", "t", "s", "e", levels=(2,)).collect()
    span, most, mean, ge2 = _brute([r[2:] for r in rows if r[0]])
    assert [(r.g, r.span, r.max_active, r.threads, r.intervals) for r in got] == [("p", span, most, 2, 601)]
    assert abs(got[0].avg_active - mean) < 1e-12 and abs(got[0].share_ge2 - ge2) < 1e-12
    assert seen.value == len(rows)


def test_ab_report(spark):
    import math

    rows = [(c, v, e, 2.0, s) for c, base, s in (("x", 10.0, 6.0), ("y", 30.0, 8.0)) for v, f in (("base", 1.0), ("new", 0.5 if c == "x" else 0.25)) for e in (base * f, base * f, base * f * 4)]
    rows.append(("only base", "base", 5.0, 1.0, 1.0))
    frame = spark.createDataFrame(rows, "case string, variant string, elapsed double, testcases double, sweeps double")
    got = {r["case"]: r for r in compare.ab_report(frame, "case", "variant", "base", "new", "elapsed", "testcases", "sweeps").collect()}
    assert set(got) == {"x", "y", None}
    assert got["x"]["speedup"] == 2 and got["y"]["median_speedup"] == 4 and got["y"]["base_mean_elapsed"] == 60
    assert got["x"]["base_share_pct"] == pytest.approx(100 * 60 / 245) and got["x"]["same_sweeps"]
    assert got[None]["speedup"] == pytest.approx(math.sqrt(8)) and got[None]["arith_speedup"] == 3 and got[None]["cases"] == 2 and got[None]["level"] == "all"
