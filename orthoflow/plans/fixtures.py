"""Matrices built from the driver tables (Spark side); ``sql_*`` give the same in DuckDB SQL.

LI4  lineitem (quantity, extendedprice, discount, tax), one matrix per group
LI2  lineitem (quantity, discount) per supplier
EMB  each embedding vector as one packed matrix (16 x 4, 8 x 8 or 4 x 16)
EV   events: per day, one row per active user, one column per event type (counts)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.operators import forms

# Column sets and event types of the fixtures.
LI4_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI2_COLUMNS = ["l_quantity", "l_discount"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_rows(spark: SparkSession, sf_dir: str, key: str, columns: list[str]) -> DataFrame:
    """Row form of lineitem; matrix per supplier (``supplier``) or per return flag (``flag``).

    The row key is the Parquet row index: unique and stable, with no global numbering.
    """
    li = table(spark, sf_dir, "lineitem")
    mid = F.col("l_suppkey") if key == "supplier" else F.ascii("l_returnflag")
    return li.select(
        mid.cast("bigint").alias("matrix_id"),
        F.col("_metadata.row_index").cast("bigint").alias("r"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
    )


def embedding_packed(spark: SparkSession, sf_dir: str, n_rows: int = 16, n_cols: int = 4) -> DataFrame:
    """Each 64-float embedding as a row-major n_rows x n_cols matrix, id = vec_id."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("bigint").alias("matrix_id"),
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.lit(n_cols).cast("bigint").alias("n_cols"),
        F.col("embedding").cast("array<double>").alias("cells"),
    )


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: matrix per day (days since 2024-01-01), row per user, counts per event type."""
    ev = table(spark, sf_dir, "events")
    day = F.expr(day_index_sql("spark"))
    counts = ev.groupBy(day.cast("bigint").alias("matrix_id"), F.col("user_id").cast("bigint").alias("r")).agg(
        *[F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).cast("double").alias(t) for t in EVENT_TYPES])
    return counts.select("matrix_id", "r", F.array(*[F.col(t) for t in EVENT_TYPES]).alias("x"))


def day_index_sql(dialect: str, col: str = "ts") -> str:
    """Days since 2024-01-01 as BIGINT. ``ts`` is TIMESTAMP_NTZ, so the date cast does not
    depend on the session time zone."""
    if dialect == "spark":
        return f"CAST(datediff(CAST({col} AS DATE), DATE '2024-01-01') AS BIGINT)"
    return f"CAST(date_diff('day', DATE '2024-01-01', CAST({col} AS DATE)) AS BIGINT)"


def cells_of(packed: DataFrame) -> DataFrame:
    return forms.packed_to_cells(packed)


# ---- the same fixtures in DuckDB SQL ------------------------------------------------

def sql_lineitem_wide(key: str, columns: list[str]) -> str:
    mid = "l_suppkey" if key == "supplier" else "ascii(l_returnflag)"
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x{j}" for j, c in enumerate(columns))
    return f"SELECT CAST({mid} AS BIGINT) AS mid, {xs} FROM lineitem"


def sql_events_wide() -> str:
    cols = ", ".join(
        f"CAST(SUM(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS DOUBLE) AS x{j}"
        for j, t in enumerate(EVENT_TYPES))
    return (
        f"SELECT CAST({day_index_sql('duckdb')} AS BIGINT) AS mid, "
        f"CAST(user_id AS BIGINT) AS r, {cols} FROM events GROUP BY 1, 2"
    )


def sql_embedding_cells(n_cols: int = 4) -> str:
    """Cells of the EMB matrices: (mid, r, c, v) from the 64-float vectors."""
    return (
        "SELECT CAST(vec_id AS BIGINT) AS mid, "
        f"CAST((i - 1) // {n_cols} AS BIGINT) AS r, CAST((i - 1) % {n_cols} AS INTEGER) AS c, "
        "CAST(embedding[i] AS DOUBLE) AS v "
        "FROM embeddings, range(1, 65) AS t(i)"
    )


def sql_embedding_wide(n_cols: int = 4) -> str:
    xs = ", ".join(f"CAST(embedding[r * {n_cols} + {j + 1}] AS DOUBLE) AS x{j}" for j in range(n_cols))
    return (f"SELECT CAST(vec_id AS BIGINT) AS mid, CAST(r AS BIGINT) AS r, {xs} "
            f"FROM embeddings, range(0, {64 // n_cols}) AS t(r)")
