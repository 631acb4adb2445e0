"""Singular value decomposition strategies over DataFrames.

batch (D4)  packed matrices, many small ones: one mapInArrow pass, no shuffle; each
            Arrow batch is sorted by shape and solved as stacks of equal shapes.
tall  (D5)  row form, any size: a local QR per task is the partial aggregate of R,
            R factors are combined in a salted two-level tree, Jacobi runs on the
            small n x n R, and U = A V / sigma is one more distributed pass.
auto  (D7)  packed input split by size class; big matrices go the tall way.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.operators import forms
from orthoflow.operators.kernels import (
    DEFAULT_EPS,
    DEFAULT_MAX_SWEEPS,
    FINITE,
    column_flags,
    column_norms,
    divide_infinite,
    flagged_sigma,
    jacobi_stack,
    r_factor,
    svd_stack,
)

RESULT_SCHEMA = (
    "matrix_id bigint, n_rows bigint, n_cols bigint, u array<double>, sigma array<double>, "
    "v array<double>, sweeps int, converged boolean"
)
FACTORS_SCHEMA = (
    "matrix_id bigint, n_rows bigint, n_cols bigint, sigma array<double>, v array<double>, "
    "sweeps int, converged boolean"
)
R_SCHEMA = "matrix_id bigint, part bigint, n_rows bigint, n_cols bigint, r_rows bigint, r_cells array<double>, flags array<tinyint>"

# A packed row goes to the tall path from this many elements on (512 KB of doubles), which
# bounds the memory of one Arrow batch of packed matrices without changing session settings.
TALL_MIN_ELEMENTS = 1 << 16
# Rows gathered per matrix inside a task before they are folded into R.
FOLD_ROWS = 4096
# Rows held by one task over all its matrices before everything is folded.
TASK_HELD_ROWS = 1 << 18
# Largest factor table (matrices x n^2 doubles) joined by broadcast for U.
BROADCAST_FACTOR_BYTES = 32 << 20
# Matrices stacked into one numpy array by the batch strategy.
ARROW_MATRICES_PER_BATCH = 256


def check_settings(eps: float, max_sweeps: int) -> None:
    """Contract of every entry point: both settings are positive."""
    if not eps > 0 or not max_sweeps > 0:
        raise ValueError("eps and max_sweeps must be positive")


def _check_shape(mid, m, n, ncells):
    if m <= 0 or n <= 0:
        raise ValueError(f"invalid testcase {mid}: zero dimension")
    if m < n:
        raise ValueError(f"invalid testcase {mid}: rows < columns")
    if ncells != m * n:
        raise ValueError(f"invalid testcase {mid}: size mismatch")


# ---- D4 batch -----------------------------------------------------------------------

def _list_array(pa, flat: np.ndarray, width: np.ndarray):
    """Arrow list<double> from a flat buffer and per-row lengths (no per-row Python objects)."""
    offsets = np.zeros(len(width) + 1, dtype=np.int64)
    np.cumsum(width, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.float64())).cast(
        pa.list_(pa.float64()))


def _batch_solver(eps: float, max_sweeps: int, with_u: bool = True, in_order: bool = False, counter=None):
    """mapInArrow body: gather every shape's stack from the list offsets, solve it in chunks.
    ``in_order`` returns them as they came; ``counter`` (an accumulator) counts what was solved."""

    def solve(batches):
        import pyarrow as pa

        for rb in batches:
            if rb.num_rows == 0:
                continue
            mids = rb.column("matrix_id").to_numpy(zero_copy_only=False)
            ms = rb.column("n_rows").to_numpy(zero_copy_only=False).astype(np.int64)
            ns = rb.column("n_cols").to_numpy(zero_copy_only=False).astype(np.int64)
            cells = rb.column("cells")
            if cells.null_count:
                raise ValueError("invalid testcase: null cells")
            offs = cells.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            vals = cells.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            sizes = offs[1:] - offs[:-1]
            for i in np.flatnonzero((ms <= 0) | (ns <= 0) | (ms < ns) | (sizes != ms * ns)):
                _check_shape(int(mids[i]), int(ms[i]), int(ns[i]), int(sizes[i]))
            parts = {k: [] for k in ("idx", "u", "u_w", "sigma", "v", "sweeps", "conv")}

            def emit(idx, u, sigma, v, sweeps, conv, m_each, n):
                parts["idx"].append(idx)
                if with_u:
                    width = m_each * n
                    if u.shape[1] * n == width.max() and (width == width[0]).all():
                        parts["u"].append(u.reshape(-1))
                    else:  # drop the zero rows added by padding
                        flat = u.reshape(len(idx), -1)
                        parts["u"].append(flat[np.arange(flat.shape[1])[None, :] < width[:, None]])
                    parts["u_w"].append(width)
                parts["sigma"].append(sigma.reshape(-1))
                parts["v"].append(v.reshape(-1))
                parts["sweeps"].append(sweeps)
                parts["conv"].append(conv)

            # one stack per column count, rows zero-padded
            for n in np.unique(ns):
                sel = np.flatnonzero(ns == n)
                sel = sel[np.argsort(ms[sel], kind="stable")]  # similar heights share a stack
                for lo in range(0, len(sel), ARROW_MATRICES_PER_BATCH):
                    idx = sel[lo:lo + ARROW_MATRICES_PER_BATCH]
                    m_each = ms[idx]
                    m_max = int(m_each.max())
                    pos = np.arange(m_max * n)
                    valid = pos[None, :] < (m_each * n)[:, None]
                    gather = np.where(valid, offs[idx][:, None] + pos[None, :], 0)
                    stack = np.where(valid, vals[gather], 0.0).reshape(len(idx), m_max, n)
                    emit(idx, *svd_stack(stack, eps, max_sweeps, with_u), m_each, int(n))
            idx = np.concatenate(parts["idx"])
            nn = ns[idx]
            cols = [
                pa.array(mids[idx], type=pa.int64()), pa.array(ms[idx], type=pa.int64()), pa.array(nn, type=pa.int64()),
                _list_array(pa, np.concatenate(parts["u"]), np.concatenate(parts["u_w"])) if with_u
                else pa.nulls(len(idx), type=pa.list_(pa.float64())),
                _list_array(pa, np.concatenate(parts["sigma"]), nn),
                _list_array(pa, np.concatenate(parts["v"]), nn * nn),
                pa.array(np.concatenate(parts["sweeps"]).astype(np.int32), type=pa.int32()),
                pa.array(np.concatenate(parts["conv"]), type=pa.bool_()),
            ]
            out = pa.RecordBatch.from_arrays(
                cols, names=["matrix_id", "n_rows", "n_cols", "u", "sigma", "v", "sweeps", "converged"])
            if counter is not None:
                counter.add(len(idx))
            yield out.take(pa.array(np.argsort(idx))) if in_order else out

    return solve


def svd_batch(packed: DataFrame, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS,
              with_u: bool = True) -> DataFrame:
    """Batch strategy: solve every packed matrix inside the task that holds it."""
    check_settings(eps, max_sweeps)
    ordered = packed.select("matrix_id", "n_rows", "n_cols", "cells")
    if not ordered.isStreaming:  # sorting by shape only makes longer equal-shape stacks
        ordered = ordered.sortWithinPartitions("n_cols", "n_rows")
    return ordered.mapInArrow(_batch_solver(eps, max_sweeps, with_u), RESULT_SCHEMA)


def svd_ordered(packed: DataFrame, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS,
                with_u: bool = True, parts: int | None = None, counter=None) -> DataFrame:
    """Batch strategy, results in the order of matrix_id over partitions and inside them.

    The input is range-partitioned and sorted, then solved where it lies: the bounds are sampled from
    the keys of the input alone, so nothing is solved to find them, and nothing is sorted afterwards.
    """
    check_settings(eps, max_sweeps)
    rows = packed.select("matrix_id", "n_rows", "n_cols", "cells")
    ranged = rows.repartitionByRange(parts, "matrix_id") if parts else rows.repartitionByRange("matrix_id")
    solver = _batch_solver(eps, max_sweeps, with_u, in_order=True, counter=counter)
    return ranged.sortWithinPartitions("matrix_id").mapInArrow(solver, RESULT_SCHEMA)


# ---- D5 tall (TSQR) -----------------------------------------------------------------

def _groups(mids: np.ndarray):
    """(matrix_id, row indices) per matrix in a batch, without pandas."""
    order = np.argsort(mids, kind="stable")
    uniq, starts = np.unique(mids[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    return [(int(u), order[s:e]) for u, s, e in zip(uniq, starts, ends)]


def _rows_block(vals, offs, idx, mid, width_known):
    """The (rows, width) block of one matrix from a list column's flat buffer; ragged fails."""
    w = offs[idx + 1] - offs[idx]
    width = int(w[0]) if width_known is None else width_known
    if (w != width).any():
        raise ValueError(f"invalid testcase {mid}: ragged rows")
    return vals[offs[idx][:, None] + np.arange(width)], width


def _local_r(batches):
    """Partial aggregate (mapInArrow): one R (at most n rows) per matrix seen by this task."""
    import pyarrow as pa
    from pyspark import TaskContext

    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx is not None else 0
    pending: dict[int, list] = {}
    counts: dict[int, int] = {}
    widths: dict[int, int] = {}
    held: dict[int, int] = {}
    flags: dict[int, np.ndarray] = {}
    total = floor = 0
    for rb in batches:
        if rb.num_rows == 0:
            continue
        mids = rb.column("matrix_id").to_numpy(zero_copy_only=False)
        x = rb.column("x")
        offs = x.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        vals = x.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        for mid, idx in _groups(mids):
            block, width = _rows_block(vals, offs, idx, mid, widths.get(mid))
            widths[mid] = width
            flag = column_flags(block)
            if flag.any():  # the solve takes such columns as zero; finite cells may stay until then
                block = np.where(np.isfinite(block), block, 0.0)
            flags[mid] = np.maximum(flags[mid], flag) if mid in flags else flag
            pending.setdefault(mid, []).append(block)
            counts[mid] = counts.get(mid, 0) + len(idx)
            held[mid] = held.get(mid, 0) + len(idx)
            total += len(idx)
            if held[mid] >= max(FOLD_ROWS, 4 * width):
                total -= held[mid]
                r = r_factor(np.vstack(pending[mid]))
                pending[mid] = [r]
                held[mid] = r.shape[0]
                total += held[mid]
        if total > max(TASK_HELD_ROWS, 2 * floor):
            # many matrices in one task: fold them all so held rows stay bounded (at most
            # twice the irreducible R state, which re-arms the trigger without thrashing)
            for mid in pending:
                r = r_factor(np.vstack(pending[mid]))
                pending[mid] = [r]
                held[mid] = r.shape[0]
            total = floor = sum(held.values())
    if not pending:
        return
    ids, rrows, flats = [], [], []
    for mid, blocks in pending.items():
        r = r_factor(np.vstack(blocks))
        ids.append(mid)
        rrows.append(r.shape[0])
        flats.append(r.reshape(-1))
    n_cols = np.array([widths[m] for m in ids], dtype=np.int64)
    rr = np.array(rrows, dtype=np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, type=pa.int64()), pa.array(np.full(len(ids), part), type=pa.int64()),
         pa.array([counts[m] for m in ids], type=pa.int64()), pa.array(n_cols, type=pa.int64()),
         pa.array(rr, type=pa.int64()), _list_array(pa, np.concatenate(flats), rr * n_cols),
         pa.array([flags[m] for m in ids], type=pa.list_(pa.int8()))],
        names=["matrix_id", "part", "n_rows", "n_cols", "r_rows", "r_cells", "flags"])


def _fold_stream(batches):
    """mapInArrow body over partial R's sorted by (matrix, bucket): one R per key, folded as they
    arrive, so a task holds one R and the batch at hand however many partials a key has."""
    import pyarrow as pa

    def folded(key, n_rows, blocks, flag):
        r = r_factor(np.vstack(blocks))
        n = r.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([n_rows], pa.int64()), pa.array([n], pa.int64()),
             pa.array([r.shape[0]], pa.int64()), pa.array([r.reshape(-1)], pa.list_(pa.float64())), pa.array([flag], pa.list_(pa.int8()))],
            names=["matrix_id", "part", "n_rows", "n_cols", "r_rows", "r_cells", "flags"])

    key, n_rows, blocks, held, flag = None, 0, [], 0, None
    for rb in batches:
        cols = {c: rb.column(c).to_numpy(zero_copy_only=False) for c in ("matrix_id", "bucket", "n_rows", "n_cols", "r_rows")}
        cells = rb.column("r_cells")
        offs = cells.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        vals = cells.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        marks = rb.column("flags")
        m_offs = marks.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        m_vals = marks.values.to_numpy(zero_copy_only=False)
        for i in range(rb.num_rows):
            this, n = (int(cols["matrix_id"][i]), int(cols["bucket"][i])), int(cols["n_cols"][i])
            mark = m_vals[m_offs[i]:m_offs[i + 1]]
            if this != key:
                if key is not None:
                    yield folded(key, n_rows, blocks, flag)
                key, n_rows, blocks, held, flag = this, 0, [], 0, np.zeros(n, np.int8)
            elif len(flag) != n:
                raise ValueError(f"invalid testcase {this[0]}: ragged rows")
            blocks.append(vals[offs[i]:offs[i + 1]].reshape(int(cols["r_rows"][i]), n))
            held += blocks[-1].shape[0]
            n_rows += int(cols["n_rows"][i])
            flag = np.maximum(flag, mark)
            if held >= 4 * n + 64:
                blocks = [r_factor(np.vstack(blocks))]
                held = blocks[0].shape[0]
    if key is not None:
        yield folded(key, n_rows, blocks, flag)


def _combine(partials: DataFrame, bucket) -> DataFrame:
    """One tree level: the partial R's of a bucket meet in one task and are folded in order."""
    keyed = partials.withColumn("bucket", bucket.cast("bigint"))
    met = keyed.repartition("matrix_id", "bucket").sortWithinPartitions("matrix_id", "bucket", "part")
    return met.select("matrix_id", "bucket", "n_rows", "n_cols", "r_rows", "r_cells", "flags").mapInArrow(_fold_stream, R_SCHEMA)


# Tasks whose partial R's of one matrix are folded by one task of the first tree level.
FOLD_FAN = 64


def r_factors(rows: DataFrame) -> DataFrame:
    """One R per matrix from row form (matrix_id, r, x): TSQR as partial + final aggregation.

    Nothing runs while the plan is built. The first tree level is left out where the session
    has no more cores than one task folds; the result is the same up to rounding.
    """
    partial = rows.select("matrix_id", "x").mapInArrow(_local_r, R_SCHEMA)
    spark = rows.sparkSession
    if max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) > FOLD_FAN:
        partial = _combine(partial, F.floor(F.col("part") / FOLD_FAN))
    return _combine(partial, F.lit(0))


def _jacobi_on_r(eps: float, max_sweeps: int):
    """mapInArrow body: Jacobi on each final R, stacked by (rows of R, n)."""

    def solve(batches):
        import pyarrow as pa

        for rb in batches:
            if rb.num_rows == 0:
                continue
            mids = rb.column("matrix_id").to_numpy(zero_copy_only=False)
            ms = rb.column("n_rows").to_numpy(zero_copy_only=False).astype(np.int64)
            ns = rb.column("n_cols").to_numpy(zero_copy_only=False).astype(np.int64)
            ks = rb.column("r_rows").to_numpy(zero_copy_only=False).astype(np.int64)
            cells = rb.column("r_cells")
            offs = cells.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            vals = cells.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            for i in range(rb.num_rows):
                _check_shape(int(mids[i]), int(ms[i]), int(ns[i]), int(ms[i] * ns[i]))
            marks = rb.column("flags").values.to_numpy(zero_copy_only=False)
            m_offs = rb.column("flags").offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            idx_all, sig_all, v_all, sw_all, cv_all = [], [], [], [], []
            for k, n in np.unique(np.stack([ks, ns], axis=1), axis=0):
                idx = np.flatnonzero((ks == k) & (ns == n))
                stack = vals[offs[idx][:, None] + np.arange(k * n)].reshape(len(idx), k, n)
                flags = marks[m_offs[idx][:, None] + np.arange(n)]
                stack = np.where(flags[:, None, :] > FINITE, 0.0, stack)
                r_rot, v, sweeps, conv = jacobi_stack(stack, eps, max_sweeps)
                idx_all.append(idx)
                sig_all.append(flagged_sigma(column_norms(r_rot), flags).reshape(-1))
                v_all.append(v.reshape(-1))
                sw_all.append(sweeps)
                cv_all.append(conv)
            idx = np.concatenate(idx_all)
            nn = ns[idx]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mids[idx], type=pa.int64()), pa.array(ms[idx], type=pa.int64()), pa.array(nn, type=pa.int64()),
                 _list_array(pa, np.concatenate(sig_all), nn), _list_array(pa, np.concatenate(v_all), nn * nn),
                 pa.array(np.concatenate(sw_all).astype(np.int32), type=pa.int32()),
                 pa.array(np.concatenate(cv_all), type=pa.bool_())],
                names=["matrix_id", "n_rows", "n_cols", "sigma", "v", "sweeps", "converged"])

    return solve


def tall_factors(rows: DataFrame, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS) -> DataFrame:
    """sigma, V, sweeps per matrix of a row-form DataFrame (no U)."""
    check_settings(eps, max_sweeps)
    return r_factors(rows).mapInArrow(_jacobi_on_r(eps, max_sweeps), FACTORS_SCHEMA)


# Rows per matrix in a batch from which each matrix is multiplied by itself; below, the rows of many
# matrices go through one stacked product, each with its own factors.
GROUP_ROWS = 64
# Factor cells gathered beside the rows of one stacked product.
STACK_CELLS = 1 << 20


def _factor_stacks(ids: list, flats: list) -> dict:
    """n -> (ids in rising order, sigma (k, n), V (k, n, n), fix (k, n, n)) from flat sigma, V, fix."""
    by_n: dict[int, list] = {}
    for i, flat in zip(ids, flats, strict=True):
        by_n.setdefault(round((np.sqrt(1 + 8 * len(flat)) - 1) / 4), []).append((i, flat))  # n + 2 n^2 numbers
    out = {}
    for n, items in by_n.items():
        items.sort(key=lambda item: item[0])
        cells = np.array([flat for _, flat in items], dtype=np.float64)
        out[n] = (np.array([i for i, _ in items], dtype=np.int64), cells[:, :n], cells[:, n:n + n * n].reshape(-1, n, n), cells[:, n + n * n:].reshape(-1, n, n))
    return out


def _apply_stacked(apply, at: np.ndarray, block: np.ndarray, sigma, v, fix) -> np.ndarray:
    """``apply`` on each row of ``block`` with the factors at its place ``at`` of the stacks."""
    n = block.shape[1]
    out = np.empty(block.shape)
    groups = _groups(at)
    if len(block) >= GROUP_ROWS * len(groups):
        for k, idx in groups:
            out[idx] = apply(block[idx], sigma[k], v[k], fix[k])
        return out
    step = max(1, STACK_CELLS // (n * n))
    for lo in range(0, len(block), step):
        k = at[lo:lo + step]
        out[lo:lo + step] = apply(block[lo:lo + step, None, :], sigma[k], v[k], fix[k])[:, 0, :]
    return out


def _row_batches(batches, tables):
    """(matrix ids, row keys, places, block, stacked factors) per batch and width. ``tables`` are the
    stacks by width; without them the factors arrive as the first row of each (matrix, salt) run."""
    last = None
    for rb in batches:
        if rb.num_rows == 0:
            continue
        mids = rb.column("matrix_id").to_numpy(zero_copy_only=False)
        rs = rb.column("r").to_numpy(zero_copy_only=False)
        x = rb.column("x")
        offs = x.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        vals = x.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        keys, known, rows = mids, tables, np.ones(len(mids), bool)
        if tables is None:
            head = np.asarray(rb.column("head").to_numpy(zero_copy_only=False), bool)
            runs = np.cumsum(head)  # 0: the run that the batch before left open
            heads = np.flatnonzero(head)
            flats = [vals[offs[i]:offs[i + 1]] for i in heads]
            known = _factor_stacks([*([0] if last is not None else []), *range(1, len(heads) + 1)], [*([last] if last is not None else []), *flats])
            if flats:
                last = flats[-1].copy()
            keys, rows = runs, ~head
        for n, (ids, *factors) in known.items():
            at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
            idx = np.flatnonzero(rows & (ids[at] == keys))
            if len(idx):
                wrong = idx[offs[idx + 1] - offs[idx] != n]
                if len(wrong):
                    raise ValueError(f"invalid testcase {mids[wrong[0]]}: ragged rows")
                yield mids[idx], rs[idx], at[idx], vals[offs[idx][:, None] + np.arange(n)], factors


def _mapped_rows(apply, out: str, tables):
    """mapInArrow body: ``apply(block, sigma, v, fix)`` on the rows of each batch, all with leading
    dimensions alike: (..., m, n), (..., n), (..., n, n), (..., n, n)."""

    def run(batches):
        import pyarrow as pa

        known = None if tables is None else tables.value
        for mids, rs, at, block, factors in _row_batches(batches, known):
            y = _apply_stacked(apply, at, block, *factors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mids, type=pa.int64()), pa.array(rs, type=pa.int64()),
                 _list_array(pa, y.reshape(-1), np.full(len(rs), y.shape[1]))], names=["matrix_id", "r", out])

    return run


# Rows of one matrix that share one copy of its factors when the factors are sent by shuffle.
ROWS_PER_SALT = 1 << 18


def map_rows(rows: DataFrame, factors: DataFrame, apply, out: str) -> DataFrame:
    """(matrix_id, r, out): ``apply(block, sigma, v, fix)`` on row blocks with their matrix's factors.

    ``factors`` (matrix_id, n_rows, sigma, v, fix) must be staged. Below a checked size they are
    sent to each task once; beyond it they travel in front of the rows, once for each run of
    ROWS_PER_SALT rows of a matrix. They are never attached to single rows.
    """
    key = rows.schema["r"].dataType.simpleString()
    schema = f"matrix_id bigint, r {key}, {out} array<double>"
    stats = factors.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("sigma")).alias("n")).first()
    n = int(stats["n"] or 0)
    if int(stats["k"] or 0) * (n + 2 * n * n) * 8 <= BROADCAST_FACTOR_BYTES:
        got = factors.select("matrix_id", F.concat("sigma", "v", "fix").alias("cells")).toArrow()
        flats = [c.values.to_numpy(zero_copy_only=False) for c in got.column("cells")]
        sent = rows.sparkSession.sparkContext.broadcast(_factor_stacks(got.column("matrix_id").to_pylist(), flats))
        return rows.select("matrix_id", "r", "x").mapInArrow(_mapped_rows(apply, out, sent), schema)
    salts = factors.select("matrix_id", F.ceil(F.col("n_rows") / ROWS_PER_SALT).cast("int").alias("salts"))
    salted = rows.select("matrix_id", "r", "x").join(salts, "matrix_id").select(
        "matrix_id", F.pmod(F.xxhash64("r"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("head"), "r", F.col("x").cast("array<double>").alias("x"))
    heads = factors.join(salts, "matrix_id").select(
        "matrix_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("head"),
        F.size("sigma").cast("bigint").alias("r"), F.concat("sigma", "v", "fix").alias("x"))
    stream = heads.unionByName(salted).repartition("matrix_id", "salt").sortWithinPartitions("matrix_id", "salt", F.desc("head"))
    return stream.select("matrix_id", "r", "x", "head").mapInArrow(_mapped_rows(apply, out, None), schema)


def _scaled(block, sigma, v, eps):
    """x V / sigma for the columns above the cut-off, without letting NaN or Inf cells spread."""
    sigma = sigma[..., None, :]
    keep = (sigma > eps) & np.isfinite(sigma)
    clean = np.where(np.isfinite(block), block, 0.0)
    return np.where(keep, (clean @ v) / np.where(keep, sigma, 1.0), 0.0)


# Ratio of singular values from which x V / sigma is orthogonalised once more.
REFINE_CONDITION = 1e4


def _inverse_in_order(eps: float):
    """mapInArrow body over (matrix_id, ..., sigma, v, r_rows, r_cells): ``fix``, the inverse of the
    triangular factor of x V / sigma with the columns in falling order of sigma. Large columns
    come first, so that a small one is freed of what it holds of them and not the other way."""

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            out = []
            for row in rb.to_pylist():
                sigma = np.array(row["sigma"])
                n = len(sigma)
                fix = np.eye(n)
                if row["r_cells"] is not None:
                    r = np.array(row["r_cells"]).reshape(row["r_rows"], n)
                    order = np.argsort(-sigma, kind="stable")
                    order = order[(sigma[order] > eps) & np.isfinite(sigma[order])]
                    t = np.linalg.qr(r[:, order], mode="r")
                    t = t * np.where(np.diag(t) < 0, -1.0, 1.0)[:, None]
                    fix[np.ix_(order, order)] = np.linalg.inv(t)
                out.append(fix.reshape(-1))
            keep = [rb.column(c) for c in ("matrix_id", "n_rows", "sigma", "v")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.list_(pa.float64()))], names=["matrix_id", "n_rows", "sigma", "v", "fix"])

    return run


def tall_u(rows: DataFrame, factors: DataFrame, eps: float = DEFAULT_EPS) -> DataFrame:
    """U rows = (x . V) / sigma, orthogonal at any condition.

    The error of x V / sigma in a column grows with sigma_max / sigma. Where that ratio is large
    the rows so formed go through one more QR tree, whose triangular factor is near the
    identity, and are multiplied by its inverse; only such matrices pay for the extra scan.
    """
    ident = F.flatten(F.transform(F.sequence(F.lit(0), F.size("sigma") - 1), lambda i: F.transform(
        F.sequence(F.lit(0), F.size("sigma") - 1), lambda j: F.when(i == j, F.lit(1.0)).otherwise(F.lit(0.0)))))
    factors = factors.select("matrix_id", "n_rows", "sigma", "v", ident.alias("fix"))

    def final(block, sigma, v, fix):
        return divide_infinite(_scaled(block, sigma, v, eps) @ fix, block, sigma)

    kept = F.filter("sigma", lambda s: (s > eps) & ~F.isnan(s) & (s < float("inf")))
    steep = F.coalesce(F.array_max(kept) > REFINE_CONDITION * F.array_min(kept), F.lit(False))
    some = factors.filter(steep)
    if some.isEmpty():
        return map_rows(rows, factors, final, "u")
    first = map_rows(rows.join(some.select("matrix_id"), "matrix_id", "left_semi"), some, lambda b, s, v, _: _scaled(b, s, v, eps), "x")
    r = r_factors(first).select("matrix_id", "r_rows", "r_cells")
    fixed = some.drop("fix").join(r, "matrix_id").select("matrix_id", "n_rows", "sigma", "v", "r_rows", "r_cells").mapInArrow(
        _inverse_in_order(eps), "matrix_id bigint, n_rows bigint, sigma array<double>, v array<double>, fix array<double>")
    return map_rows(rows, factors.filter(~steep).unionByName(fixed).checkpoint(), final, "u")


def svd_rows(rows: DataFrame, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS,
             with_u: bool = True):
    """Tall strategy on row form: returns (factors, u_rows or None).

    The factor table is checkpointed (it is small) so the U pass does not recompute
    the QR tree and the job survives a lost executor.
    """
    check_settings(eps, max_sweeps)
    factors = tall_factors(rows, eps, max_sweeps)
    if not with_u:
        return factors, None
    factors = factors.checkpoint()
    return factors, tall_u(rows, factors, eps)


def svd_tall(packed: DataFrame, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS,
             with_u: bool = True) -> DataFrame:
    """Tall strategy on packed input, giving the batch result schema."""
    packed = packed.select("matrix_id", "n_rows", "n_cols", "cells")
    rows = forms.packed_to_rows(packed)
    factors, u_rows = svd_rows(rows, eps, max_sweeps, with_u)
    if u_rows is None:
        return factors.select("matrix_id", "n_rows", "n_cols", F.lit(None).cast("array<double>").alias("u"),
                              "sigma", "v", "sweeps", "converged")
    u_packed = u_rows.withColumnRenamed("u", "x").transform(forms.rows_to_packed).select(
        "matrix_id", F.col("cells").alias("u"))
    return factors.join(u_packed, "matrix_id").select(
        "matrix_id", "n_rows", "n_cols", "u", "sigma", "v", "sweeps", "converged")


# ---- D7 auto ------------------------------------------------------------------------

def strategy_column(tall_min_elements: int = TALL_MIN_ELEMENTS):
    return F.when(F.col("n_rows") * F.col("n_cols") >= tall_min_elements, F.lit("tall")).otherwise(F.lit("batch"))


def svd(packed: DataFrame, strategy: str = "auto", eps: float = DEFAULT_EPS,
        max_sweeps: int = DEFAULT_MAX_SWEEPS, tall_min_elements: int = TALL_MIN_ELEMENTS,
        with_u: bool = True) -> DataFrame:
    """SVD of packed matrices: ``batch``, ``tall``, ``relational`` or ``auto`` (split by size)."""
    check_settings(eps, max_sweeps)
    if strategy == "batch":
        return svd_batch(packed, eps, max_sweeps, with_u)
    if strategy == "tall":
        return svd_tall(packed, eps, max_sweeps, with_u)
    if strategy == "relational":
        from orthoflow.operators import steps

        return steps.svd_relational_packed(packed, eps, max_sweeps)
    if strategy != "auto":
        raise ValueError(f"unknown strategy: {strategy}")
    routed = packed.withColumn("_strategy", strategy_column(tall_min_elements))
    small = routed.filter(F.col("_strategy") == "batch").drop("_strategy")
    big = routed.filter(F.col("_strategy") == "tall").drop("_strategy")
    return svd_batch(small, eps, max_sweeps, with_u).unionByName(svd_tall(big, eps, max_sweeps, with_u))


# ---- results: T3, S5/T1, D8 ---------------------------------------------------------

def spectrum(result: DataFrame) -> DataFrame:
    """(matrix_id, k, sigma): singular values in descending order, k from 0."""
    return result.select(
        "matrix_id", F.posexplode(F.sort_array("sigma", asc=False)).alias("k", "sigma")
    ).select("matrix_id", F.col("k").cast("int").alias("k"), "sigma")


def factor_cells(result: DataFrame) -> DataFrame:
    """U (m x n), Sigma (1 x n), V (n x n) per matrix as cells with an emit order."""
    parts = F.array(
        F.struct(F.lit(0).alias("part_order"), F.lit("U").alias("part"), F.col("n_cols").alias("w"), F.col("u").alias("vals")),
        F.struct(F.lit(1).alias("part_order"), F.lit("SIGMA").alias("part"), F.col("n_cols").alias("w"), F.col("sigma").alias("vals")),
        F.struct(F.lit(2).alias("part_order"), F.lit("V").alias("part"), F.col("n_cols").alias("w"), F.col("v").alias("vals")),
    )
    exploded = result.select("matrix_id", F.explode(parts).alias("p")).select(
        "matrix_id", "p.part_order", "p.part", "p.w", F.posexplode("p.vals").alias("ix", "v"))
    r, c = forms.row_major_position(F.col("ix"), F.col("w"))
    return exploded.select("matrix_id", "part_order", "part", r.alias("r"), c.alias("c"), "v")


def ordered_factor_cells(packed: DataFrame, eps: float = DEFAULT_EPS, max_sweeps: int = DEFAULT_MAX_SWEEPS,
                         counter=None) -> DataFrame:
    """Factor cells of packed matrices in emit order, by matrix, U then Sigma then V, row-major. Each
    matrix is solved once, in its place; the cells are laid out behind it without another sort."""
    return factor_cells(svd_ordered(packed, eps, max_sweeps, counter=counter))


def svd_report(result: DataFrame) -> DataFrame:
    """One-row run report: testcases, emitted matrices (3 per testcase), total sweeps, unconverged."""
    return result.agg(
        F.count(F.lit(1)).cast("bigint").alias("testcase_count"),
        (F.count(F.lit(1)) * 3).cast("bigint").alias("emitted_matrix_count"),
        F.coalesce(F.sum("sweeps"), F.lit(0)).cast("bigint").alias("total_sweeps"),
        F.coalesce(F.sum(F.when(~F.col("converged"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("unconverged_count"),
    )


def report_json(report: DataFrame) -> DataFrame:
    """The report as one JSON string."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


# ---- D7 on row form (tables) --------------------------------------------------------

# Matrices with at least this many rows count as tall.
TALL_MIN_ROWS = 600


def svd_auto_rows(rows: DataFrame, tall_min_rows: int = TALL_MIN_ROWS, eps: float = DEFAULT_EPS,
                  max_sweeps: int = DEFAULT_MAX_SWEEPS, with_u: bool = False):
    """sigma, V, sweeps and route per matrix of a row-form table, in one pass over it.

    The partial factor of a matrix decides by its own rows: few rows travel as they are and are
    solved as one block, many (a hot key may hold a third of all rows) are folded into R where they
    lie, so nothing is counted before and nothing is gathered. No job runs while the plan is built;
    with U the factors are computed once and kept, and the rows read once more.
    """
    check_settings(eps, max_sweeps)
    tall = (F.col("n_rows") >= tall_min_rows) | (F.col("n_rows") * F.col("n_cols") >= TALL_MIN_ELEMENTS)
    factors = tall_factors(rows, eps, max_sweeps).withColumn("strategy", F.when(tall, "tall").otherwise("batch"))
    if not with_u:
        return factors
    factors = factors.checkpoint()
    return factors, tall_u(rows, factors, eps)
