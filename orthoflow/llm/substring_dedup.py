"""Substring dedup (operator 8): repeated word windows, found level by level.

Method: level-wise doubling. Windows of half the wanted length are judged first; only where one of
them repeats in another document is it extended to the full length and judged again. When nothing
repeats at a level, no candidate survives and the search ends there.

The half level looks at anchors: of the half windows inside a full window, the one
with the smallest hash. Equal windows choose equal anchors, so a window that repeats has an anchor
that repeats, and a quarter of the positions is enough. The anchors that repeat go into a Bloom
filter of bounded size, which spares work and decides nothing.

Copies of a whole document are set aside by its hash first (the largest groups, by a bounded
table), and keys that hold more than one in 65536 of all rows (65536 of them at most) are counted
before they are joined, so no key's rows meet in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.llm.bloom import Bloom, bloom
from orthoflow.llm.common import SPACED, Sequences, Words, prepare, scratch, stage, window_starts, word_runs

HOT_KEYS = 1 << 16
COPY_GROUPS = 100_000
_MARK = 24  # bits of a text's hash kept beside each place, to tell apart texts of one id


def _anchors(seq: Sequences, total: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Per window of ``length`` words, the smallest hash of the half windows in it."""
    half = (length + 1) // 2
    first = np.arange(max(0, total - half + 1))
    low = seq.of(first, first + half)
    span, have = length - half + 1, 1
    while have < span:  # minimum over ``span`` neighbours, by doubling
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low[starts]


def _text_keys(words: Words) -> list[bytes]:
    """A 128-bit digest of each row's whole word sequence."""
    buf, at = words.buf, words.offsets
    # bytes.split() cuts at the very white space that ends a word
    return [hashlib.blake2b(b" ".join(buf[a:b].tobytes().split()), digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _marks(keys: list[bytes]) -> np.ndarray:
    """A few bits of each text's digest."""
    return np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)[:, 0].astype(np.uint64) >> np.uint64(64 - _MARK)


class _Copies:
    """Rows known to repeat a whole text of a smaller id."""

    def __init__(self, rows: list):
        self.ids = {bytes(r["text"]): r["id"] for r in rows}

    def of(self, keys: list[bytes], ids: list) -> np.ndarray:
        """Whether each row is a later copy."""
        if not self.ids:
            return np.zeros(len(keys), bool)
        least = [self.ids.get(k) for k in keys]
        return np.array([low is not None and (i is None or i > low) for low, i in zip(least, ids, strict=True)], bool)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words in word_runs(batches, "text", SPACED, lower=False):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_text_keys(words), pa.binary()), pa.array(np.diff(words.first))], ["id", "text", "words"])


def _level_rows(length: int, sent):
    """Places (key, id) of one level: anchors when no filter is given, else the whole windows whose
    anchor passes it, with their place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, passing, hot = sent.value
        for batch, words in word_runs(batches, "text", SPACED, lower=False):
            h = words.hashes()
            seq = Sequences(h)
            texts = _text_keys(words)
            starts = window_starts(words.first, length)
            row = np.searchsorted(words.first, starts, side="right") - 1
            ids = batch.column("id")
            own = ~copies.of(texts, ids.to_pylist())[row]
            starts, row = starts[own], row[own]
            key = _anchors(seq, len(h), starts, length)
            if passing is None:
                new = np.ones(len(key), bool)  # neighbouring windows mostly share their anchor
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[new])), _long(key[new])], ["id", "key"])
                continue
            go = passing.has(key)
            starts, row, key = starts[go], row[go], key[go]
            full = seq.of(starts, starts + length)
            more = Sequences(words.hashes(lane=1), lane=1).of(starts, starts + length)
            mark = _marks(texts)[row]
            place = (mark << np.uint64(32)) | (starts - words.first[row]).astype(np.uint64)
            at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
            many = hot[at] == key if len(hot) else np.zeros(len(key), bool)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), _long(full), pa.array((more >> np.uint64(32)).astype(np.uint32).view(np.int32)), _long(place), pa.array(many)],
                ["id", "key", "key2", "place", "hot"],
            )

    return rows


def repeated_windows(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, _Copies]:
    """Windows that also start in a row with a smaller id: (id, place); and the copies
    set aside. ``place`` is the word number with a mark of the text above bit 32."""
    spark = docs.sparkSession
    prepare(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    texts = stage(rows.mapInArrow(_text_rows, f"id {id_type}, text binary, words long"), "substring-texts")
    groups = texts.filter(F.col("words") >= length).groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    largest = groups.filter("n > 1 and id is not null").orderBy(F.desc("n"), "text").limit(COPY_GROUPS)
    copies = _Copies(largest.select("text", "id").collect())  # COPY_GROUPS rows at most; the others go the long way

    # the half level: anchors that occur in two rows of different ids
    sent = spark.sparkContext.broadcast((copies, None, None))
    anchors = rows.mapInArrow(_level_rows(length, sent), f"id {id_type}, key long")
    counted = anchors.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n"), F.count("id").alias("known"))
    repeated = stage(counted.filter("low != high or (known > 0 and known < n)").select("key", "n"), "substring-anchors")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    if not total:  # no candidate survives
        return spark.createDataFrame([], f"id {id_type}, place long"), copies
    hot = repeated.filter(F.col("n") > max(1, total // HOT_KEYS)).select("key").collect()  # HOT_KEYS rows at most
    hot = np.sort(np.array([r["key"] for r in hot], np.int64).view(np.uint64))
    passing: Bloom = bloom(repeated, "key")

    # the full level: windows with such an anchor
    sent = spark.sparkContext.broadcast((copies, passing, hot))
    windows = rows.mapInArrow(_level_rows(length, sent), f"id {id_type}, key long, key2 int, place long, hot boolean")
    later = F.coalesce(F.col("id") > F.col("low"), F.col("low").isNotNull())  # a null id is later than any
    group = Window.partitionBy("key", "key2")
    cold = windows.filter("not hot").withColumn("low", F.min("id").over(group)).filter(later).select("id", "place")
    if not len(hot):
        return cold, copies
    # rows of hot keys are aggregated and the staged minima joined back, which Spark can split
    many = stage(windows.filter("hot").drop("hot"), "substring-hot")
    firsts = stage(many.groupBy("key", "key2").agg(F.min("id").alias("low")), "substring-firsts")
    both = many.join(firsts, ["key", "key2"]).filter(later).select("id", "place")
    return cold.unionAll(both), copies


def _digest_rows(length: int, sent, joined: bool):
    """Kept words of each row. ``joined``: the input has a row's places; else only rows whose id
    the filter does not know are reported, and they keep all (copies: nothing)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, affected = sent.value
        for batch, words in word_runs(batches, "text", SPACED, lower=False):
            texts = _text_keys(words)
            marks = _marks(texts)
            copy = copies.of(texts, batch.column("id").to_pylist()) & (np.diff(words.first) >= length)
            places = batch.column("places").to_pylist() if joined else [None] * words.rows
            told = np.ones(words.rows, bool) if joined else copy | ~affected.has(batch.column("id_hash").to_numpy().view(np.uint64))
            out = []
            for r in np.flatnonzero(told).tolist():
                first, n = int(words.first[r]), int(words.first[r + 1] - words.first[r])
                gone = np.zeros(n + 1, np.int64)
                if copy[r]:
                    gone[0] = 1
                elif places[r]:
                    at = np.array(places[r], np.int64)
                    at = np.unique(at[(at >> 32) == int(marks[r])] & 0xFFFFFFFF)
                    at = at[at + length <= n]
                    gone[at] += 1
                    np.subtract.at(gone, at + length, 1)
                keep = np.cumsum(gone[:n]) == 0 if n else np.zeros(0, bool)
                out.append((n, int(n - keep.sum()), hashlib.sha256(_kept_text(words, first, keep)).hexdigest()))
            ids = batch.column("id").take(pa.array(np.flatnonzero(told)))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows


def _kept_text(words: Words, first: int, keep: np.ndarray) -> bytes:
    """The kept words, joined by one space."""
    start, end = words.start[first : first + len(keep)][keep], words.end[first : first + len(keep)][keep]
    return b" ".join([words.buf[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)])


def substring_dedup(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one
    space).

    Words are [^\\x20\\x09-\\x0D]+ as they stand. A word goes when a window of ``length`` words that
    covers it also starts in a row with a smaller id; windows are judged on the input. Null and
    empty texts have no words; texts shorter than a window lose nothing. Rows of one id never
    remove each other's words. A null id counts as later than any id, two of them as equal.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    with scratch(spark) as keep:
        repeats, copies = repeated_windows(docs, length, id_col, text_col)
        places = keep(repeats.groupBy("id").agg(F.collect_list("place").alias("places")), "substring-places")
    affected = bloom(places.select(F.xxhash64("id").alias("id_hash")), "id_hash")
    sent = spark.sparkContext.broadcast((copies, affected))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col)).alias("id_hash"))
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string"
    whole = rows.mapInArrow(_digest_rows(length, sent, joined=False), schema)
    cut = rows.mapInArrow(_passing_rows(sent, length), rows.schema)
    cut = cut.join(places.withColumnRenamed("id", "place_id"), F.col("id").eqNullSafe(F.col("place_id")), "left").select("id", "text", "id_hash", "places")
    return whole.unionAll(cut.mapInArrow(_digest_rows(length, sent, joined=True), schema))


def _passing_rows(sent, length: int):
    """The rows that the other branch does not report."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, affected = sent.value
        for batch, words in word_runs(batches, "text", SPACED, lower=False):
            known = affected.has(batch.column("id_hash").to_numpy().view(np.uint64))
            if not known.any():
                continue
            texts = _text_keys(words)
            copy = copies.of(texts, batch.column("id").to_pylist()) & (np.diff(words.first) >= length)
            yield batch.filter(pa.array(known & ~copy))

    return rows
