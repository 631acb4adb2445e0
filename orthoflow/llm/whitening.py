"""Whitening of embeddings by a matrix-free Jacobi-Davidson eigensolver.

The covariance is never formed. Its product with a few vectors is one distributed pass over the
fit list, which is staged once as blocks of packed integers; everything else (projected
Rayleigh-Ritz, inner MINRES, locking) works on d x (a few) arrays in the driver. A pass returns
d x k sums a task, added up in a second level of tasks where there are many.

Contract: rows whose vector is null or holds null or non-finite entries are dropped. An entry c
counts as the integer floor(256 c), saturated at the range of a long; a vector shorter than the
longest counts as continued with zeros (so an empty one is all zeros). Equal vectors count once in
the fit, whatever their number; rows, repeated ones and null ids included, are all returned. Extra
columns are ignored. A component without variance (fewer distinct vectors than components, or
constant ones) has ``whitened`` null and ``explained`` 0; ``deviation`` is null where it does not
fit a long; ``identity_error`` is over the components that have variance, null if none has. A table
without usable rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import prepare, stage

SCALE = 256.0
BLOCK_BYTES = 1 << 20
#: partial results of a pass that the driver adds up itself
FAN_IN = 256
_EPS = float(np.finfo(np.float64).eps)
_WIDTHS = (2, 4, 8)


# --- the fit list --------------------------------------------------------------------------


def integer_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers that stay, their x-vectors as rows of int64) of an Arrow list<double> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(~np.asarray(column.is_null()))
    lists = column.drop_null()
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    flat = lists.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)  # null entries become NaN
    owner = np.repeat(np.arange(len(rows)), sizes)
    bad = np.zeros(len(rows), bool)
    bad[owner[~np.isfinite(values)]] = True
    out = np.zeros((len(rows), dim), np.int64)
    first = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * values)
        whole = np.clip(np.nan_to_num(scaled, nan=0.0), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    whole[scaled >= 2.0**63] = np.iinfo(np.int64).max
    out[owner, np.arange(len(values)) - first[owner]] = whole
    return rows[~bad], out[~bad]


def _pack(x: np.ndarray, width: int) -> pa.Array:
    raw = np.ascontiguousarray(x.astype(f"<i{width}"))
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1] * width), len(raw), [None, pa.py_buffer(raw)])
    return fixed.cast(pa.binary())


def _packed(dim: int):
    """Vectors to their integers, in the fewest bytes that hold all entries of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = integer_vectors(batch.column(0), dim)
            width = np.full(len(x), 8)
            for w in (4, 2):
                info = np.iinfo(f"i{w}")
                width[((x >= info.min) & (x <= info.max)).all(axis=1)] = w
            for w in _WIDTHS:
                part = x[width == w]
                if len(part):
                    part = np.unique(part, axis=0) if len(part) > 1 else part
                    yield pa.RecordBatch.from_arrays([_pack(part, w)], ["x"])

    return run


def _blocks(dim: int):
    """Packed vectors to blocks of about ``BLOCK_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[bytes]] = {w: [] for w in _WIDTHS}

        def out(w: int) -> pa.RecordBatch:
            data, waiting[w] = b"".join(waiting[w]), []
            return pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([data], pa.binary())], ["width", "data"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                w = len(x) // dim
                waiting[w].append(x)
                if len(waiting[w]) * dim * w >= BLOCK_BYTES:
                    yield out(w)
        for w in _WIDTHS:
            if waiting[w]:
                yield out(w)

    return run


def _read_blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """x-vectors of staged blocks, about a megabyte of packed integers at a time."""
    for batch in batches:
        for width, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield np.frombuffer(data.as_buffer(), f"<i{width}").reshape(-1, dim)


class FitList:
    """The distinct x-vectors as a staged table of blocks, with sums over them as Spark jobs."""

    def __init__(self, vectors: DataFrame, column: str, dim: int):
        self.dim = dim
        self.passes = 0
        distinct = vectors.select(column).mapInArrow(_packed(dim), "x binary").distinct()
        self.table = stage(distinct.mapInArrow(_blocks(dim), "width int, data binary"), "whitening-blocks")
        self.parts = self.table.rdd.getNumPartitions()
        self.n, self.sums = self._sums()
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(dim)

    def _sums(self) -> tuple[int, list[int]]:
        """Number of vectors and exact sum per dimension (in two halves of 32 bits)."""
        dim = self.dim

        def run(batches):
            n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
            for x in _read_blocks(batches, dim):
                x = x.astype(np.int64)
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (n, high.tolist(), low.tolist())], ["n", "high", "low"])

        rows = self.table.mapInArrow(run, "n long, high array<long>, low array<long>")
        places = rows.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
        # decimals, as the sum over tasks may pass the range of a long
        got = places.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("h"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("l")).collect()
        sums = [0] * dim
        for r in got:
            sums[r["i"]] = (int(r["h"]) << 32) + int(r["l"])
        return (got[0]["n"] if got else 0), sums

    def total(self, term: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of ``term`` of the centred vectors, block by block: one pass over the fit list."""
        dim, mean = self.dim, self.mean
        self.passes += 1

        def run(batches):
            total = np.zeros(shape)
            for x in _read_blocks(batches, dim):
                total += term(x - mean)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

        def add(batches):
            total = np.zeros(shape)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    total += np.frombuffer(t).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["t"])

        partial = self.table.mapInArrow(run, "t binary")
        if self.parts > FAN_IN:
            partial = partial.repartition(int(self.parts**0.5)).mapInArrow(add, "t binary")
        return sum((np.frombuffer(r[0]).reshape(shape) for r in partial.collect()), np.zeros(shape))

    def product(self, b: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``b``."""
        return self.total(lambda x: x.T @ (x @ b), b.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.array([np.vdot(x, x)]), (1,))[0] / self.n)


# --- the eigensolver -----------------------------------------------------------------------


def _orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span ``t`` outside ``against``; dependent ones are left out."""
    out = np.zeros((len(t), 0))
    for j in range(t.shape[1]):
        v = t[:, j]
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            for q in (against, out):
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """MINRES for several right-hand sides in step: one call of ``apply`` serves all columns."""
    tiny = np.finfo(np.float64).tiny
    size = np.linalg.norm(b, axis=0)
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    before, now = np.zeros_like(b), b / np.maximum(size, tiny)
    beta, rest = np.zeros_like(size), size.copy()
    cos, cos_old, sin, sin_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    live = size > 0
    for _ in range(steps):
        y = apply(now) - beta * before
        alpha = (now * y).sum(axis=0)
        y = y - alpha * now
        y = y - now * (now * y).sum(axis=0)
        beta_next = np.linalg.norm(y, axis=0)
        # the new column of the tridiagonal matrix under the two last rotations, then its own
        far = sin_old * beta
        near = cos * cos_old * beta + sin * alpha
        diagonal = cos * alpha - sin * cos_old * beta
        length = np.maximum(np.hypot(diagonal, beta_next), tiny)
        cos_old, sin_old = cos, sin
        cos, sin = diagonal / length, beta_next / length
        w, w_old = (now - near * w - far * w_old) / length, w
        x = x + np.where(live, cos * rest, 0.0) * w
        rest = -sin * rest
        live = live & (np.abs(rest) > tol * size) & (beta_next > tiny)
        if not live.any():
            break
        before, now, beta = now, y / np.maximum(beta_next, tiny), beta_next
    return x


@dataclass
class Eigenpairs:
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    rounds: int


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int, *, inner: int = 5, most: int = 60, seed: int = 7) -> Eigenpairs:
    """The ``want`` largest eigenpairs of a symmetric non-negative operator given by its products.

    Each round takes Ritz pairs in the subspace outside the locked vectors, locks those from the
    top whose residual is at double precision (64 eps of the largest value), and extends the
    subspace by corrections of the others: (I - UU')(A - theta I)(I - UU') t = -r, U holding the
    locked and the wanted Ritz vectors, solved by a few steps of MINRES. The corrections of a round
    share their passes. Where rounding keeps a residual above the bar, it is taken when three
    rounds have not lowered it and it lies under 1e-11.
    """
    want = min(want, dim)
    rng = np.random.default_rng(seed)
    q = _orthonormal(rng.standard_normal((dim, min(dim, want + 2))), np.zeros((dim, 0)))
    aq = product(q)
    locked, values = np.zeros((dim, 0)), []
    worst, best, stuck, rounds = 0.0, np.inf, 0, 0
    while True:
        rounds += 1
        h = q.T @ aq
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = q @ s, aq @ s
        r = au - u * theta
        r = r - locked @ (locked.T @ r)
        need = want - len(values)
        scale = max([abs(theta[0]), *values])
        size = np.linalg.norm(r[:, :need], axis=0) / scale if scale > 0 else np.zeros(need)
        stuck = stuck + 1 if size[0] > best / 2 else 0
        best = min(best, size[0])
        lead = 0
        while lead < need and (size[lead] <= 64 * _EPS or (stuck >= 3 and size[lead] <= 1e-11)):
            worst = max(worst, size[lead])
            lead += 1
        if lead:
            locked = np.column_stack([locked, u[:, :lead]])
            values += theta[:lead].tolist()
            best, stuck = np.inf, 0
        if len(values) == want:
            break
        if rounds >= most:
            raise ArithmeticError(f"residual {size.max():.1e} after {rounds} rounds")
        u, au, theta, r, need = u[:, lead:], au[:, lead:], theta[lead:], r[:, lead:], need - lead
        if u.shape[1] > 4 * want + 8:  # thick restart
            u, au, theta = u[:, : 2 * want + 2], au[:, : 2 * want + 2], theta[: 2 * want + 2]
        q, aq = u, au
        todo = min(need, u.shape[1])
        fixed = np.column_stack([locked, u[:, :todo]])
        shift = theta[:todo]

        def outside(t: np.ndarray, fixed=fixed) -> np.ndarray:
            return t - fixed @ (fixed.T @ t)

        def corrected(t: np.ndarray, shift=shift, outside=outside) -> np.ndarray:
            return outside(product(t) - t * shift)

        t = minres(corrected, outside(-r[:, :todo]), inner, max(1e-3, 2.0 ** -(rounds + 2)))
        new = _orthonormal(t, np.column_stack([locked, q]))
        free = dim - locked.shape[1] - q.shape[1]
        if not new.shape[1] and free:
            new = _orthonormal(rng.standard_normal((dim, 1)), np.column_stack([locked, q]))
        if new.shape[1] or not q.shape[1]:
            if not q.shape[1]:
                new = _orthonormal(rng.standard_normal((dim, min(free, need))), locked)
            q, aq = np.column_stack([q, new]), np.column_stack([aq, product(new)])
        else:  # the subspace is whole: fresh products take the rounding of the old ones out
            q, _ = np.linalg.qr(q)
            aq = product(q)
    order = np.argsort(values)[::-1]
    vectors = locked[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(want)])
    return Eigenpairs(np.array(values)[order], vectors * signs, worst, rounds)


# --- the operator --------------------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted whitening: n and exact sums of the fit list, mean, components (columns), their
    eigenvalues, the trace of the covariance and the error of the identity (None: no variance)."""

    dim: int
    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    residual: float = 0.0
    passes: int = 0


def _matrix(values: np.ndarray, vectors: np.ndarray, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """(which components have variance, projection to whitened components)."""
    has = values > max(trace, 0.0) * 1e-13
    return has, vectors[:, has] / np.sqrt(values[has])


def fit_whitening(vectors: DataFrame, column: str = "embedding", components: int = 4) -> Whitening | None:
    """Fit over the distinct integer vectors of the column; None without usable rows."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(column).cast("array<double>").alias("v")).filter("v is not null")
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return None
    fit = FitList(rows, "v", dim)
    if not fit.n:
        return None
    trace = fit.trace()
    want = min(components, dim)
    if trace > 0:
        found = jacobi_davidson(fit.product, dim, want)
    else:
        found = Eigenpairs(np.zeros(want), np.eye(dim, want), 0.0, 0)
    has, w = _matrix(found.values, found.vectors, trace)
    error = None
    if has.any():
        k = int(has.sum())
        # products of the centred vectors, then of what is left of their mean
        sums = fit.total(lambda x: np.vstack([(x @ w).T @ (x @ w), (x @ w).sum(axis=0)]), (k + 1, k)) / fit.n
        error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return Whitening(dim, fit.n, fit.sums, fit.mean, np.where(has, found.values, 0.0), found.vectors, trace, error, found.residual, fit.passes)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2; in machine integers where they suffice."""
    reach = max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums)) if x.size else 0
    if reach**2 * x.shape[1] < 2**63:
        off = x * n - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [d if d < 2**63 else None for d in exact]


def whiten(vectors: DataFrame, fitted: Whitening | None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per usable row and component: the id, component, n, deviation, whitened, explained,
    identity_error."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    f = fitted
    has, matrix = _matrix(f.values, f.vectors, f.trace)
    k = len(f.values)
    explained = f.values / f.trace if f.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                stay, x = integer_vectors(batch.column(1), f.dim)
                if not len(stay):
                    continue
                white = np.full((len(x), k), np.nan)
                white[:, has] = (x - f.mean) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(stay, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, f.n, np.int64)),
                        pa.array(_deviation(x, f.n, f.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(white.ravel(), mask=np.tile(~has, len(x))),
                        pa.array(np.tile(explained, len(x))),
                        pa.array([f.identity_error] * (len(x) * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
