"""Distributed matrix dataset generators.

Every value is a pure function of (seed, file, case, r, c, draw) through a counter-based
hash, so a cell does not depend on partitioning or on the cells before it. The value
formulas are SQL expression text evaluated by Spark (``F.expr``); the same text runs in
DuckDB for the oracle. Values are distribution-equal to a Mersenne-Twister run, not
bit-equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Generator defaults and the hash modulus/multiplier.
MODULUS = 2147483647
MULTIPLIER = 48271
DEFAULT_SEED = 20260515
DEFAULT_ROWS = tuple(range(8, 65, 8))
DEFAULT_COLUMNS = tuple(range(4, 33, 4))
SHAPE_POLICIES = ("grid", "uniform", "log-uniform", "square", "tall-skinny", "wide")
VALUE_DISTRIBUTIONS = ("uniform", "normal", "log-uniform", "diagonal-dominant", "low-rank",
                       "ill-conditioned", "sparse", "zero-columns")
BENCHMARK_SIZES = (8, 12, 16, 24, 32, 48, 64, 96)


@dataclass(frozen=True)
class GenOptions:
    rows: tuple[int, ...] = DEFAULT_ROWS
    columns: tuple[int, ...] = DEFAULT_COLUMNS
    shape_distribution: str = "grid"
    value_distribution: str = "uniform"
    seed: int = DEFAULT_SEED
    min_value: float = -1.0
    max_value: float = 1.0
    mean: float = 0.0
    stddev: float = 1.0
    sparsity: float = 0.9
    rank: int = 4
    condition: float = 1.0e8
    allow_wide: bool = False
    hash_fn: str = "xxhash64"

    def check(self) -> None:
        if self.max_value < self.min_value:
            raise ValueError("max_value must be >= min_value")
        if self.stddev <= 0:
            raise ValueError("stddev must be positive")
        if self.condition < 1:
            raise ValueError("condition must be >= 1")
        if self.shape_distribution not in SHAPE_POLICIES:
            raise ValueError(f"unknown shape distribution {self.shape_distribution}")
        if self.hash_fn not in HASH_FUNCTIONS:
            raise ValueError(f"unknown hash function {self.hash_fn}")
        if self.value_distribution not in VALUE_DISTRIBUTIONS:
            raise ValueError(f"unknown value distribution {self.value_distribution}")


# ---- hash (shared SQL text) ---------------------------------------------------------

HASH_BITS = 52


HASH_FUNCTIONS = ("xxhash64", "md5")


def hash_sql(seed: str, *inputs: str, dialect: str = "spark", fn: str = "md5") -> str:
    """Counter-based hash to a 52-bit integer.

    ``md5``: first 52 bits of md5 over 'seed:input:...' (portable; DuckDB recomputes it).
    ``xxhash64``: Spark's codegen'd xxhash64 over the BIGINT inputs (about 10x cheaper).
    """
    if fn == "xxhash64":
        if dialect != "spark":
            raise ValueError("xxhash64 generation is Spark-only; use md5 to reproduce elsewhere")
        args = ", ".join(f"CAST(({x}) AS BIGINT)" for x in (seed, *inputs))
        return f"pmod(xxhash64({args}), {1 << HASH_BITS}L)"
    key = "concat_ws(':', " + ", ".join(f"CAST(({x}) AS STRING)" for x in (seed, *inputs)) + ")"
    hexpart = f"substr(md5({key}), 1, {HASH_BITS // 4})"
    if dialect == "duckdb":
        return f"CAST('0x' || {hexpart} AS BIGINT)"
    return f"CAST(conv({hexpart}, 16, 10) AS BIGINT)"


def uniform_sql(seed: str, *inputs: str, dialect: str = "spark", fn: str = "md5") -> str:
    """u in (0, 1), exact in double (52-bit integer + 0.5 over 2^52)."""
    return f"((CAST({hash_sql(seed, *inputs, dialect=dialect, fn=fn)} AS DOUBLE) + 0.5) / {float(1 << HASH_BITS)!r})"


def normal_sql(seed: str, *inputs: str, dialect: str = "spark", fn: str = "md5") -> str:
    """Box-Muller on two hashed draws."""
    u1 = uniform_sql(seed, *inputs, "101", dialect=dialect, fn=fn)
    u2 = uniform_sql(seed, *inputs, "202", dialect=dialect, fn=fn)
    return f"(SQRT(-2.0 * LN({u1})) * COS(2.0 * PI() * {u2}))"


def _lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def value_sql(o: GenOptions, dialect: str = "spark", r: str = "r", c: str = "c") -> str:
    """Cell value as SQL over seed_key, file_index, case_index, n_rows, n_cols and the row and
    column expressions ``r`` and ``c`` (column names, or lambda expressions)."""
    key = ("file_index", "case_index", r, c)
    s = "seed_key"

    def uni(draw: int) -> str:
        return f"({_lit(o.min_value)} + ({_lit(o.max_value)} - {_lit(o.min_value)}) * {uniform_sql(s, *key, str(draw), dialect=dialect, fn=o.hash_fn)})"

    smooth = f"(0.05 * SIN(0.013 * (({r}) + 1) * (({c}) + 1)))"
    d = o.value_distribution
    if d == "uniform":
        return f"({uni(0)} + {smooth})"
    if d == "normal":
        return f"({_lit(o.mean)} + {_lit(o.stddev)} * {normal_sql(s, *key, '0', dialect=dialect, fn=o.hash_fn)} + {smooth})"
    if d == "log-uniform":
        lo = max(min(abs(o.min_value), abs(o.max_value)), 1e-300)
        hi = max(abs(o.min_value), abs(o.max_value), lo)
        mag = f"EXP(LN({_lit(lo)}) + (LN({_lit(hi)}) - LN({_lit(lo)})) * {uniform_sql(s, *key, '0', dialect=dialect, fn=o.hash_fn)})"
        return f"((CASE WHEN {uniform_sql(s, *key, '1', dialect=dialect, fn=o.hash_fn)} < 0.5 THEN {mag} ELSE -{mag} END) + {smooth})"
    if d == "diagonal-dominant":
        scale = max(abs(o.max_value), abs(o.min_value), 1.0)
        noise = f"(0.01 * {uni(0)})"
        return f"(CASE WHEN ({r}) = ({c}) THEN {_lit(scale)} + ABS({uni(1)}) + {noise} ELSE {noise} END)"
    if d == "sparse":
        return f"(CASE WHEN {uniform_sql(s, *key, '0', dialect=dialect, fn=o.hash_fn)} < {_lit(o.sparsity)} THEN 0.0 ELSE {uni(1)} END)"
    if d == "zero-columns":
        return f"(CASE WHEN ({c}) % GREATEST(2, CAST(FLOOR(n_cols / 4) AS BIGINT)) = 0 THEN 0.0 ELSE {uni(0)} END)"
    raise ValueError(f"{d} is a factor-product distribution")


def factor_terms_sql(o: GenOptions, dialect: str = "spark", r: str = "r", c: str = "c",
                     k: str = "k") -> tuple[str, str, str, str]:
    """(left factor L[r,k], right factor R[k,c], scale_k, noise) SQL for low-rank / ill-conditioned."""
    s = "seed_key"
    left = normal_sql(s, "file_index", "case_index", r, k, "11", dialect=dialect, fn=o.hash_fn)
    right = normal_sql(s, "file_index", "case_index", k, c, "12", dialect=dialect, fn=o.hash_fn)
    if o.value_distribution == "low-rank":
        sd = _lit(o.stddev)
        return (f"({sd} * {left})", f"({sd} * {right})", "1.0",
                f"(1.0e-6 * {sd} * {normal_sql(s, 'file_index', 'case_index', r, c, '2', dialect=dialect, fn=o.hash_fn)})")
    scale = f"POWER({_lit(o.condition)}, -CAST({k} AS DOUBLE) / GREATEST(rank_eff - 1, 1))"
    return left, right, scale, f"(1.0e-12 * {normal_sql(s, 'file_index', 'case_index', r, c, '2', dialect=dialect, fn=o.hash_fn)})"


# ---- G1 shape candidates, G2 choice, W2 / J5 ----------------------------------------

def shape_candidates(spark, o: GenOptions) -> DataFrame:
    """Candidate shapes in row-major parameter order, filtered by the policy."""
    o.check()
    df = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(r) for r in o.rows])).alias("ri", "n_rows")
    ).select("ri", "n_rows", F.posexplode(F.array(*[F.lit(c) for c in o.columns])).alias("ci", "n_cols"))
    cond = F.lit(True) if o.allow_wide else F.col("n_rows") >= F.col("n_cols")
    pol = o.shape_distribution
    if pol == "square":
        cond = cond & (F.col("n_rows") == F.col("n_cols"))
    elif pol == "tall-skinny":
        cond = cond & (F.col("n_rows") >= 2 * F.col("n_cols"))
    elif pol == "wide":
        cond = cond & (F.col("n_rows") < F.col("n_cols"))
    kept = df.filter(cond)
    w = Window.orderBy("ri", "ci")
    out = kept.select(
        (F.row_number().over(w) - 1).alias("shape_ix"),
        F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_cols").cast("bigint").alias("n_cols"),
        (F.lit(1.0) / F.sqrt((F.col("n_rows") * F.col("n_cols")).cast("double"))).alias("weight"))
    return out


def with_prefix(cands: DataFrame) -> DataFrame:
    """Running weight prefix over the (small) candidate table."""
    w = Window.orderBy("shape_ix").rowsBetween(Window.unboundedPreceding, 0)
    return cands.select("*", F.sum("weight").over(w).alias("prefix"),
                        F.sum("weight").over(Window.partitionBy()).alias("total"),
                        F.count(F.lit(1)).over(Window.partitionBy()).alias("n_cands"))


def candidate_count(o: GenOptions) -> int:
    """Number of candidates (a function of the options only); empty is an error."""
    n = 0
    for r in o.rows:
        for c in o.columns:
            ok = o.allow_wide or r >= c
            pol = o.shape_distribution
            ok = ok and (pol != "square" or r == c) and (pol != "tall-skinny" or r >= 2 * c) and (pol != "wide" or r < c)
            n += int(ok)
    if n == 0:
        raise ValueError("shape options produced no valid matrix shapes")
    return n


def choose_shapes(cases: DataFrame, cands: DataFrame, o: GenOptions) -> DataFrame:
    """A shape per case, without any join.

    The candidate table is a parameter table (|rows| x |columns| options), computed with its
    running weights (W2) in Spark and read back as literals; each case then picks by index:
    grid / square / tall / wide by case_index mod k, uniform by one hashed draw, log-uniform
    (J5) as the first candidate whose prefix reaches u * total, which is the number of
    prefixes below it (prefixes increase), falling back to case_index mod k.
    """
    k = candidate_count(o)
    table = with_prefix(cands).orderBy("shape_ix").select("n_rows", "n_cols", "prefix", "total").collect()
    if len(table) != k:
        raise ValueError("candidate table does not match the options")
    rows_arr = F.array(*[F.lit(int(t["n_rows"])) for t in table]).cast("array<bigint>")
    cols_arr = F.array(*[F.lit(int(t["n_cols"])) for t in table]).cast("array<bigint>")
    base = cases.withColumn("seed_key", F.lit(o.seed).cast("bigint"))
    pol = o.shape_distribution
    u = F.expr(uniform_sql("seed_key", "file_index", "case_index", "-1", "-1", "7", fn=o.hash_fn))
    if pol == "uniform":
        pick = F.least(F.floor(u * k).cast("bigint"), F.lit(k - 1).cast("bigint"))
    elif pol == "log-uniform":
        prefixes = F.array(*[F.lit(float(t["prefix"])) for t in table])
        threshold = u * F.lit(float(table[0]["total"]))
        below = F.size(F.filter(prefixes, lambda p: p < threshold)).cast("bigint")
        pick = F.when(below < k, below).otherwise(F.pmod(F.col("case_index"), F.lit(k)))
    else:
        pick = F.pmod(F.col("case_index"), F.lit(k))
    base = base.withColumn("_pick", pick + 1)
    return base.select(*[c for c in base.columns if c != "_pick"],
                       F.element_at(rows_arr, F.col("_pick").cast("int")).alias("n_rows"),
                       F.element_at(cols_arr, F.col("_pick").cast("int")).alias("n_cols"))


# ---- G3-G10 values ------------------------------------------------------------------

def spread(cases: DataFrame, *keys: str) -> DataFrame:
    """Cases dealt out over tasks before they grow into cells. A table of cases is a few bytes each, so
    neither its files nor an adaptive exchange would split it; the count is therefore given."""
    spark = cases.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return cases.repartition(tasks, *keys)


def generate_cells(shaped: DataFrame, o: GenOptions) -> DataFrame:
    """(file_index, case_index, n_rows, n_cols, r, c, v) for every case of ``shaped``."""
    shaped = spread(shaped, "file_index", "case_index")
    d = o.value_distribution
    if d in ("low-rank", "ill-conditioned"):
        # both factors are drawn once per case, (n_rows + n_cols) * rank draws, and a cell is the sum
        # over k of the products of their entries, inside the row: no regrouping
        left, right, scale, noise = factor_terms_sql(o)
        ks = "sequence(0L, rank_eff - 1)"
        drawn = shaped.withColumn("rank_eff", F.least(F.lit(o.rank).cast("bigint"), F.col("n_rows"), F.col("n_cols"))).select(
            "file_index", "case_index", "seed_key", "n_rows", "n_cols",
            F.expr(f"transform(sequence(0L, n_rows - 1), r -> transform({ks}, k -> {scale} * {left}))").alias("_left"),
            F.expr(f"transform(sequence(0L, n_cols - 1), c -> transform({ks}, k -> {right}))").alias("_right"))
        case = ["file_index", "case_index", "seed_key", "n_rows", "n_cols"]
        # outer: no factor is empty, and an inner explode would have them drawn once more for a filter before the exchange
        by_row = drawn.select(*case, "_right", F.posexplode_outer("_left").alias("r", "_l"))
        cells = by_row.select(*case, F.col("r").cast("bigint").alias("r"), "_l", F.posexplode_outer("_right").alias("c", "_r"))
        cells = cells.withColumn("c", F.col("c").cast("bigint"))
        val = f"aggregate(zip_with(_l, _r, (a, b) -> a * b), CAST(0.0 AS DOUBLE), (acc, t) -> acc + t) + {noise}"
        return cells.select("file_index", "case_index", "n_rows", "n_cols", "r", "c", F.expr(val).alias("v"))
    cells = shaped.select(
        "file_index", "case_index", "seed_key", "n_rows", "n_cols",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") * F.col("n_cols") - 1)).alias("ix"))
    cells = cells.select("*", F.floor(F.col("ix") / F.col("n_cols")).cast("bigint").alias("r"),
                         F.pmod(F.col("ix"), F.col("n_cols")).cast("bigint").alias("c")).drop("ix")
    return cells.select("file_index", "case_index", "n_rows", "n_cols", "r", "c", F.expr(value_sql(o)).alias("v"))


def generate_packed(shaped: DataFrame, o: GenOptions) -> DataFrame:
    """Packed matrices (matrix_id = file_index * 1e6 + case_index), one projection per case:
    the cell array is built by ``transform`` over the row-major positions, so there is no
    explode and no shuffle."""
    r, c = "CAST(FLOOR(ix / n_cols) AS BIGINT)", "(ix % n_cols)"
    if o.value_distribution in ("low-rank", "ill-conditioned"):
        left, right, scale, noise = factor_terms_sql(o, r=r, c=c, k="k")
        val = (f"aggregate(sequence(0L, rank_eff - 1), CAST(0.0 AS DOUBLE), "
               f"(acc, k) -> acc + {scale} * {left} * {right}) + {noise}")
    else:
        val = value_sql(o, r=r, c=c)
    cells = F.expr(f"transform(sequence(0L, n_rows * n_cols - 1), ix -> CAST({val} AS DOUBLE))")
    with_rank = shaped.withColumn("rank_eff", F.least(F.lit(o.rank).cast("bigint"), F.col("n_rows"), F.col("n_cols")))
    return with_rank.select((F.shiftleft(F.col("file_index").cast("bigint"), FILE_SHIFT) + F.col("case_index")).cast("bigint").alias("matrix_id"),
                            "n_rows", "n_cols", cells.alias("cells"))


# A matrix id holds the case in its low 40 bits and the file above them.
FILE_SHIFT = 40


def benchmark_cells(sizes: DataFrame) -> DataFrame:
    """sin(0.013(r+1)(c+1)) + cos(0.017(r+3)(c+5)) on 2n x n per case."""
    cells = spread(sizes, "case_index").select("case_index", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col("n") * F.col("n") - 1)).alias("ix"))
    cells = cells.select("case_index", (2 * F.col("n")).cast("bigint").alias("n_rows"), F.col("n").cast("bigint").alias("n_cols"),
                         F.floor(F.col("ix") / F.col("n")).cast("bigint").alias("r"), F.pmod(F.col("ix"), F.col("n")).cast("bigint").alias("c"))
    return cells.select("*", F.expr(BENCHMARK_SQL).alias("v"))


BENCHMARK_SQL = "(SIN(0.013 * (r + 1) * (c + 1)) + COS(0.017 * (r + 3) * (c + 5)))"
