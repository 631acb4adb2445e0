"""Matrix forms and per-matrix predicates, all as Catalyst column expressions.

packed: matrix_id, n_rows, n_cols, cells ARRAY<DOUBLE> (row-major), one row per matrix
row:    matrix_id, r, x ARRAY<DOUBLE>, one Spark row per matrix row (any size)
cell:   matrix_id, r, c, v
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default thresholds of the layout/strategy route.
BIG_MIN_COLUMNS = 16
BIG_MIN_ELEMENTS = 4096


# ---- P1: linear offsets -------------------------------------------------------------

def row_major_index(r: Column, c: Column, n_cols: Column) -> Column:
    return r * n_cols + c


def column_major_index(r: Column, c: Column, n_rows: Column) -> Column:
    return c * n_rows + r


def row_major_position(ix: Column, n_cols: Column) -> tuple[Column, Column]:
    """Inverse of row_major_index: (r, c)."""
    return F.floor(ix / n_cols).cast("bigint"), F.pmod(ix, n_cols).cast("int")


# ---- P2: conversions ----------------------------------------------------------------

def table_to_rows(df: DataFrame, group_col: str, row_key: Column, value_cols: list[str]) -> DataFrame:
    """Row form from an ordinary table: one matrix per group, one matrix row per table row.

    ``row_key`` is any unique BIGINT per row within the group; no global numbering is
    needed (a row_number over a hot group would put it in one task).
    """
    return df.select(
        F.col(group_col).cast("bigint").alias("matrix_id"),
        row_key.cast("bigint").alias("r"),
        F.array(*[F.col(c).cast("double") for c in value_cols]).alias("x"),
    )


def packed_to_rows(packed: DataFrame) -> DataFrame:
    """Row form of packed matrices; r runs 0..n_rows-1."""
    return packed.select(
        "matrix_id",
        F.posexplode(F.sequence(F.lit(0), (F.col("n_rows") - 1).cast("int"))).alias("_p", "r"),
        "n_cols",
        "cells",
    ).select(
        "matrix_id",
        F.col("r").cast("bigint").alias("r"),
        F.slice("cells", (F.col("r") * F.col("n_cols") + 1).cast("int"), F.col("n_cols").cast("int")).alias("x"),
    )


def packed_to_cells(packed: DataFrame) -> DataFrame:
    """Cell form (matrix_id, r, c, v) of packed matrices."""
    exploded = packed.select("matrix_id", "n_cols", F.posexplode("cells").alias("ix", "v"))
    r, c = row_major_position(F.col("ix"), F.col("n_cols"))
    return exploded.select("matrix_id", r.alias("r"), c.alias("c"), "v")


def rows_to_cells(rows: DataFrame) -> DataFrame:
    return rows.select("matrix_id", "r", F.posexplode("x").alias("c", "v")).select(
        "matrix_id", "r", F.col("c").cast("int").alias("c"), "v"
    )


def cells_to_packed(cells: DataFrame) -> DataFrame:
    """Packed form from cells; groups are whole matrices, so use it for bounded matrices only."""
    g = cells.groupBy("matrix_id").agg(
        (F.max("r") + 1).cast("bigint").alias("n_rows"),
        (F.max("c") + 1).cast("bigint").alias("n_cols"),
        F.array_sort(F.collect_list(F.struct(F.col("r"), F.col("c"), F.col("v")))).alias("_cells"),
    )
    return g.select("matrix_id", "n_rows", "n_cols", F.transform("_cells", lambda e: e["v"]).alias("cells"))


def rows_to_packed(rows: DataFrame, keep_row_keys: bool = False) -> DataFrame:
    """Packed form from row form, rows ordered by r; bounded matrices only. With
    ``keep_row_keys`` the ordered r values come along as ``row_keys``."""
    g = rows.groupBy("matrix_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.max(F.size("x")).cast("bigint").alias("n_cols"),
        F.array_sort(F.collect_list(F.struct(F.col("r"), F.col("x")))).alias("_rows"),
    )
    extra = [F.transform("_rows", lambda e: e["r"]).alias("row_keys")] if keep_row_keys else []
    return g.select(
        "matrix_id", "n_rows", "n_cols", F.flatten(F.transform("_rows", lambda e: e["x"])).alias("cells"), *extra
    )


# ---- P3: transpose ------------------------------------------------------------------

def transpose_packed(packed: DataFrame) -> DataFrame:
    """Row-major (m x n) -> row-major of the transpose (n x m), i.e. the column-major layout."""
    m, n = F.col("n_rows"), F.col("n_cols")
    cells = F.transform(
        F.sequence(F.lit(0).cast("bigint"), m * n - 1),
        lambda k: F.element_at(F.col("cells"), (F.pmod(k, m) * n + F.floor(k / m) + 1).cast("int")),
    )
    # cells first: a later alias named n_rows would otherwise be picked up as a lateral alias
    out = packed.select("matrix_id", n.alias("_t_rows"), m.alias("_t_cols"),
                        F.when(m * n > 0, cells).otherwise(F.array().cast("array<double>")).alias("_t_cells"))
    return out.select("matrix_id", F.col("_t_rows").alias("n_rows"), F.col("_t_cols").alias("n_cols"),
                      F.col("_t_cells").alias("cells"))


def transpose_cells(cells: DataFrame) -> DataFrame:
    return cells.select("matrix_id", F.col("c").cast("bigint").alias("r"), F.col("r").cast("int").alias("c"), "v")


# ---- P4: validation -----------------------------------------------------------------

def reject_reason(n_rows: Column, n_cols: Column, n_cells: Column | None = None) -> Column:
    """NULL for an acceptable matrix, else the reason (first failing check wins)."""
    elements = F.try_multiply(n_rows.cast("bigint"), n_cols.cast("bigint"))
    expr = (
        F.when((n_rows <= 0) | (n_cols <= 0), F.lit("zero dimension"))
        .when(elements.isNull(), F.lit("element count overflow"))
        .when(n_rows < n_cols, F.lit("rows < columns"))
    )
    if n_cells is not None:
        expr = expr.when(n_cells.cast("bigint") != elements, F.lit("size mismatch"))
    return expr


def validate_packed(packed: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split into (good, rejected). With strict=True a bad matrix fails the job instead."""
    tagged = packed.withColumn(
        "reject_reason", reject_reason(F.col("n_rows"), F.col("n_cols"), F.size("cells"))
    )
    if strict:
        good = tagged.select(
            "*",
            F.when(
                F.col("reject_reason").isNotNull(),
                F.raise_error(F.concat(F.lit("invalid testcase "), F.col("matrix_id").cast("string"),
                                       F.lit(": "), F.col("reject_reason"))),
            ).alias("_check"),
        ).filter(F.col("_check").isNull()).drop("_check", "reject_reason")  # a filter keeps the check from pruning
        return good, tagged.filter(F.lit(False))
    return (
        tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        tagged.filter(F.col("reject_reason").isNotNull()),
    )


# ---- P6: shape route ----------------------------------------------------------------

def big_matrix(n_rows: Column, n_cols: Column, mode: str = "auto",
               min_cols: int = BIG_MIN_COLUMNS, min_elems: int = BIG_MIN_ELEMENTS) -> Column:
    """Shape test of the layout switch: on / off / auto (columns and elements over thresholds)."""
    if mode == "on":
        return F.lit(True)
    if mode == "off":
        return F.lit(False)
    return (n_cols >= min_cols) & (n_rows * n_cols >= min_elems)


# ---- G13: identity ------------------------------------------------------------------

def identity_cells(sizes: DataFrame, id_col: str = "matrix_id", n_col: str = "n") -> DataFrame:
    """V = I(n) per matrix in cell form."""
    idx = F.sequence(F.lit(0), (F.col(n_col) - 1).cast("int"))
    return (
        sizes.select(F.col(id_col).alias("matrix_id"), F.explode(idx).alias("r"), idx.alias("_cs"))
        .select("matrix_id", F.col("r").cast("bigint").alias("r"), F.explode("_cs").alias("c"))
        .select("matrix_id", "r", "c", F.when(F.col("r") == F.col("c"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("v"))
    )


def with_position(df: DataFrame, order_col: str, name: str = "pos") -> DataFrame:
    """0-based position in the order of a unique column: a place inside a range, plus the rows of the
    ranges before it (a running sum over one row per range). The ranges are written once, as bounds
    sampled twice need not agree."""
    from orthoflow.session import scratch_dir

    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(order_col).sortWithinPartitions(order_col)
    ranged = ranged.select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
    path = scratch_dir(df.sparkSession, "positions")
    ranged.write.parquet(path)
    kept = df.sparkSession.read.schema(ranged.schema).parquet(path)
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return kept.join(ranges, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
