"""Shared helpers: staged tables, bounded Arrow batches and vectorised word arithmetic.

The word helpers work on the raw UTF-8 buffer of an Arrow string column, a few megabytes at a
time, so a task's memory does not depend on the partition's size. Both word classes used here
are decided byte by byte, because every byte of a multi-byte character belongs to a word.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.session import ensure_checkpoint_dir, ship_package

BATCH_BYTES = 8 << 20
SLICE_BYTES = 2 << 20

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and bound Arrow batches by bytes (whole texts are rows)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder; it is deleted when the JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-tables/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop_path)
    return path


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


_SCOPES: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage is cut, the work is
    done once, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside go at the end, as do the shuffle files behind them; those staged by the
    function that it yields stay. What is returned must read no others."""
    _SCOPES.append([])
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_SCOPES[-1].pop())
        return out

    try:
        yield keep
    finally:
        for path in _SCOPES.pop():
            hadoop_path, files = _hadoop(spark, path)
            files.delete(hadoop_path, True)
        if _SCOPES:
            _SCOPES[-1].extend(kept)
        release(spark)


def drop_staged(spark: SparkSession, *names: str) -> None:
    """Delete the tables of these names that the innermost ``scratch`` has staged, and let go of
    shuffle files. Nothing that is still to be computed may read them."""
    gone = [path for path in _SCOPES[-1] if path.rsplit("/", 1)[1].rsplit("-", 1)[0] in names]
    for path in gone:
        _SCOPES[-1].remove(path)
        hadoop_path, files = _hadoop(spark, path)
        files.delete(hadoop_path, True)
    release(spark)


def small(df: DataFrame, row_bytes: int, limit: int = 8 << 20, rows: int | None = None) -> DataFrame:
    """A staged table as the small side of a join: broadcast when its rows stay under ``limit``
    bytes, left to a shuffled join otherwise. The result is the same. ``rows``: the most rows it can
    have; where that is too many, or not known, they are counted."""
    if rows is None or rows * row_bytes > limit:
        rows = df.count()
    return F.broadcast(df) if rows * row_bytes <= limit else df


FEW_ROWS, FILE_ROWS = 1 << 19, 1 << 15


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows. If these are few, partitions that are worth a task: 8, and
    one more for each ``FILE_ROWS`` rows, however finely a shuffle dealt them; the driver keeps
    something of every task. Many rows stay as they are dealt."""
    return df.coalesce(8 + rows // FILE_ROWS) if rows <= FEW_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let the cluster drop shuffle files that no table needs any more: Spark removes them when
    the driver collects the objects that stand for them."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER_ASCII, LOWER_ASCII)


# --- words ---------------------------------------------------------------------------------

_BYTES = np.arange(256)
#: words [^\x20\x09-\x0D]+
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (lower-cased text)
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_M64 = (1 << 64) - 1
#: two lanes each: seeds of the word hashes, odd multipliers of the hashes of (short) word sequences
_WORD_P = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_SEQ_P = (0xC2B2AE3D27D4EB4F, 0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(p: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < size."""
    have = _POWERS.get(p)
    if have is None or len(have[0]) < size:
        size = max(size, 1 << 16)
        pair = []
        for q in (p, pow(p, -1, 1 << 64)):
            a = np.full(size, np.uint64(q))
            a[0] = 1
            pair.append(np.cumprod(a, dtype=np.uint64))
        have = _POWERS[p] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: places in a word whose values come from a table
_PLACES = 64
_TABLES: dict[int, np.ndarray] = {}


def _value_of(code: np.ndarray, lane: int) -> np.ndarray:
    """A random value of (place, byte), the place above bit 8."""
    return mix(mix(code.astype(np.uint64) + np.uint64(_WORD_P[lane])) ^ np.uint64(_WORD_P[lane]))


def _byte_values(lane: int) -> np.ndarray:
    if lane not in _TABLES:
        _TABLES[lane] = _value_of(np.arange(_PLACES << 8), lane)
    return _TABLES[lane]


class Words:
    """Words of a run of rows: byte bounds in ``buf`` and, per row, the range of word numbers.

    buf: the (lower-cased) bytes; start, end: byte bounds of each word; first: word number at
    which each row begins, with the total at the end; rows: number of rows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.base = int(offsets[0])
        buf = data[self.base : int(offsets[-1])]
        self.buf = LOWER[buf] if lower else buf
        rel = offsets.astype(np.int64) - self.base
        n = len(buf)
        word = table[self.buf]
        start = word.copy()
        start[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = rel[1:-1]
        cut = cut[(cut > 0) & (cut < n)]  # a word never crosses two rows
        start[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, rel)
        self.rows = len(offsets) - 1
        self.offsets = rel

    def hashes(self, lane: int = 0, block: int = 1 << 16) -> np.ndarray:
        """A 64-bit hash of each word's bytes: the sum of a random value per (byte, place in the word).
        Unlike a polynomial it has no strings of a regular build that collide."""
        table = _byte_values(lane)
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            j = max(i + 1, int(np.searchsorted(self.end, int(self.start[i]) + block, side="right")))
            lo = int(self.start[i])
            start = (self.start[i:j] - lo).astype(np.int32)
            size = (self.end[i:j] - lo).astype(np.int32) - start
            first = np.cumsum(size, dtype=np.int32) - size
            place = np.arange(int(first[-1] + size[-1]), dtype=np.int32)
            at = place + np.repeat(start - first, size)
            place -= np.repeat(first, size)
            code = (place << 8) | self.buf[lo : int(self.end[j - 1])].take(at)
            if size.max() > _PLACES:
                far = place >= _PLACES
                value = table.take(np.where(far, 0, code))
                value[far] = _value_of((place[far].astype(np.int64) << 8) | (code[far] & 255), lane)
            else:
                value = table.take(code)
            out[i:j] = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
            i = j
        return out

    def row_of(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def text(self, word: int) -> bytes:
        return self.buf[self.start[word] : self.end[word]].tobytes()


class Sequences:
    """Hashes of word sequences by prefix sums, for sequences of a few words: in constant time each. Their
    polynomial modulo 2^64 is no hash of long ones, which can be built to collide."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        power, self.inverse = _powers(_SEQ_P[lane], len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=self.total[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (np.asarray(end) - np.asarray(first)).astype(np.uint64)
        return mix((self.total[end] - self.total[first]) * self.inverse[first] + size * np.uint64(_WORD_P[1]))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word numbers at which a window of ``n`` words of one row begins."""
    many = np.maximum(np.diff(first) - n + 1, 0)
    total = int(many.sum())
    if not total:
        return np.empty(0, np.int64)
    skipped = np.concatenate(([0], np.cumsum(many)[:-1]))
    return np.arange(total) + np.repeat(first[:-1] - skipped, many)


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), rows


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes of text, one row at least."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, lo + 20_000, rows)
        yield lo, hi
        lo = hi


def word_runs(batches: Iterator[pa.RecordBatch], text: str, table: np.ndarray, lower: bool) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the input batches, each with the words of its text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = string_buffer(batch.column(text))
        for lo, hi in slices(offsets):
            yield batch.slice(lo, hi - lo), Words(data, offsets[lo : hi + 1], table, lower)


def list_array(values: np.ndarray | pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))
