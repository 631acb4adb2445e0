"""Checks of a decomposition, distributed (no matrix is gathered, no n x n array beside a row).

Packed results hold all that a check needs in one row and are checked where they lie. In row form
the factors reach a task once (``svd.map_rows``), or not at all: Freivalds' check compares A w with
U (Sigma V^T w) for a few random vectors w, so only V^T w, n numbers a vector, meets the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.operators import steps, svd


def _staged(factors: DataFrame) -> DataFrame:
    """Factors as ``svd.map_rows`` takes them, computed once."""
    zero = F.transform("v", lambda x: F.lit(0.0))
    rows = F.col("n_rows") if "n_rows" in factors.columns else F.lit(svd.ROWS_PER_SALT)
    return factors.select("matrix_id", rows.cast("bigint").alias("n_rows"), "sigma", "v", zero.alias("fix")).checkpoint()


# Rows of one side that a task sorts when rows meet by (matrix_id, r).
ROWS_PER_TASK = 1 << 20


def by_row(factors: DataFrame, *sides: DataFrame) -> list[DataFrame]:
    """``sides`` dealt out alike by (matrix_id, r) for a join, over as many tasks as their rows ask for:
    the session's count is fixed, so that a task's share would grow with the table."""
    spark = factors.sparkSession
    rows = factors.agg(F.sum("n_rows")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // ROWS_PER_TASK))
    return [side.repartition(tasks, "matrix_id", "r") for side in sides]


def reconstruct_rows(u_rows: DataFrame, factors: DataFrame) -> DataFrame:
    """x_hat[c] = sum_k u[k] * sigma[k] * v[c, k] per row (V row-major n x n), as a product of blocks
    of rows with factors that a task holds once."""
    rows = u_rows.select("matrix_id", "r", F.col("u").alias("x"))
    return svd.map_rows(rows, _staged(factors), lambda u, sigma, v, _: (u * sigma[..., None, :]) @ np.swapaxes(v, -1, -2), "x_hat")


def _packed(fn, out: str):
    """mapInArrow body: ``fn(u, sigma, v)`` of each packed result, flattened."""

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            made = []
            for m, n, u, sigma, v in zip(*(rb.column(c).to_numpy(zero_copy_only=False) for c in ("n_rows", "n_cols", "u", "sigma", "v")), strict=True):
                u = None if u is None else np.asarray(u).reshape(m, n)
                made.append(np.ravel(fn(u, np.asarray(sigma), np.asarray(v).reshape(n, n))))
            yield pa.RecordBatch.from_arrays([rb.column("matrix_id"), rb.column("n_rows"), rb.column("n_cols"), pa.array(made, pa.list_(pa.float64()))], names=["matrix_id", "n_rows", "n_cols", out])

    return run


def _map_packed(result: DataFrame, fn, out: str) -> DataFrame:
    return result.select("matrix_id", "n_rows", "n_cols", "u", "sigma", "v").mapInArrow(
        _packed(fn, out), f"matrix_id bigint, n_rows bigint, n_cols bigint, {out} array<double>")


def reconstruct_packed(result: DataFrame) -> DataFrame:
    """U diag(sigma) V^T of packed results, as packed matrices."""
    return _map_packed(result, lambda u, sigma, v: (u * sigma) @ v.T, "cells")


def gram_packed(result: DataFrame, which: str) -> DataFrame:
    """U^T U or V^T V of packed results as (matrix_id, i, j, g)."""
    fn = (lambda u, sigma, v: u.T @ u) if which == "u" else (lambda u, sigma, v: v.T @ v)
    g = _map_packed(result, fn, "g").select("matrix_id", "n_cols", F.posexplode("g").alias("at", "g"))
    return g.select("matrix_id", F.floor(F.col("at") / F.col("n_cols")).cast("int").alias("i"), F.pmod("at", "n_cols").cast("int").alias("j"), "g")


def packed_u_rows(result: DataFrame) -> DataFrame:
    """U rows (matrix_id, r, u) from a packed result."""
    return result.select(
        "matrix_id", "n_cols", "u",
        F.posexplode(F.sequence(F.lit(0), (F.col("n_rows") - 1).cast("int"))).alias("_p", "r"),
    ).select("matrix_id", F.col("r").cast("bigint").alias("r"),
             F.slice("u", (F.col("r") * F.col("n_cols") + 1).cast("int"), F.col("n_cols").cast("int")).alias("u"))


def v_gram(factors: DataFrame) -> DataFrame:
    """V^T V per matrix as (matrix_id, i, j, g), computed on the small n x n arrays."""
    n = F.size("sigma").cast("bigint")
    whole = factors.select("matrix_id", n.alias("n_rows"), n.alias("n_cols"), F.lit(None).cast("array<double>").alias("u"), "sigma", "v")
    return gram_packed(whole, "v")


def u_gram(u_rows: DataFrame, n: int) -> DataFrame:
    """U^T U per matrix via the distributed Gram aggregate (A2) over U rows."""
    return steps.gram(u_rows.withColumnRenamed("u", "x"), n)


def energy(factors: DataFrame) -> DataFrame:
    """sum sigma^2 per matrix (equals the sum of squares of A)."""
    return factors.select("matrix_id", F.aggregate("sigma", F.lit(0.0), lambda a, s: a + s * s).alias("energy"))


def _random_vector(k: int, size: Column, seed: int) -> Column:
    """The k-th vector of +1 and -1, from a hash of the place alone."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), j), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def freivalds(rows: DataFrame, u_rows: DataFrame, factors: DataFrame, vectors: int = 3, seed: int = 1) -> DataFrame:
    """matrix_id, residual, size: the largest |A w - U Sigma V^T w| over rows and random vectors w of +1
    and -1, and the largest row sum of |A| to hold it against.

    A wrong product passes a vector with probability one half at most. U rows and A rows are both dealt
    out by (matrix_id, r); what joins them is one number a vector.
    """
    n = F.size("sigma")
    places = F.sequence(F.lit(0), n - 1)

    def after(i: int) -> Column:
        """Sigma V^T w of the i-th vector: V is row-major, so its k-th column is every n-th cell."""
        w = _random_vector(i, n, seed)
        column = lambda k: F.transform(places, lambda c: F.col("v")[c * n + k])
        return F.transform(places, lambda k: F.col("sigma")[k] * _dot(column(k), w))

    small = factors.select("matrix_id", F.array(*[after(i) for i in range(vectors)]).alias("z"))
    mine = F.array(*[_dot(F.col("x"), _random_vector(i, F.size("x"), seed)) for i in range(vectors)])
    left = rows.select("matrix_id", "r", mine.alias("aw"), F.aggregate("x", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("size"))
    right = u_rows.join(small, "matrix_id").select("matrix_id", "r", F.transform("z", lambda z: _dot(F.col("u"), z)).alias("uz"))
    off = F.array_max(F.zip_with("aw", "uz", lambda a, b: F.abs(a - b)))
    if "n_rows" in factors.columns:
        left, right = by_row(factors, left, right)
    both = left.join(right, ["matrix_id", "r"], "full")
    # a row that only one side has is as wrong as can be
    off = F.when(F.col("aw").isNull() | F.col("uz").isNull(), F.lit(float("inf"))).otherwise(off)
    return both.groupBy("matrix_id").agg(F.max(off).alias("residual"), F.max("size").alias("size"))
