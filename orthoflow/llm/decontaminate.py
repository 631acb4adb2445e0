"""Benchmark decontamination (operator 2): Wu-Manber search for benchmark passages.

Method: the symbols are words. For patterns of one length m, a table over hashed blocks of two
words holds how far a cursor may move on: m-1 when the block is in no pattern, less by its last
place in any pattern. A shift of 0 means that a pattern may end here; the bucket of the suffix
block names the patterns to try, and their words are compared directly. Many cursors, one per
stretch of text, move at once in numpy.

The patterns are the windows of the benchmark's items. They are sent to the tasks in blocks of a
bounded number of words; a benchmark beyond one block is searched block by block over the
documents, and the places found are joined per document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import ALNUM, Sequences, Words, fresh, list_array, mix, prepare, string_buffer, word_runs

TABLE_BITS = 16
STRETCH = 512

FOUND = {"n_words": "long", "hits": "array<struct<first:int,end:int>>", "items": "array<string>"}


class PatternTable:
    """Shift table, suffix buckets and words of the patterns of one length."""

    def __init__(self, m: int, patterns: list[tuple[bytes, ...]], owners: list[set[str]]):
        self.m, self.block = m, min(2, m)
        self.patterns, self.owners = patterns, owners
        flat = [w for p in patterns for w in p]
        data = np.frombuffer(b"".join(flat), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in flat]))).astype(np.int64)
        h = Words(data, offsets, ALNUM, lower=False).hashes()
        first = np.arange(len(patterns)) * m
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, np.int64)
        for end in range(self.block - 1, m):  # the block whose last word has number ``end`` in its pattern
            np.minimum.at(self.shift, self.slot(h, first + end), m - 1 - end)
        suffix = self.slot(h, first + m - 1)
        self.bucket = defaultdict(list)
        for k, s in enumerate(suffix.tolist()):
            self.bucket[s].append(k)
        self.whole = np.sort(Sequences(h).of(first, first + m))

    def slot(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Table place of the block that ends with word ``at``."""
        x = h[at] if self.block == 1 else mix(h[at] + h[at - 1] * np.uint64(3))
        return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: Words, h: np.ndarray, seq: Sequences) -> Iterator[tuple[int, set[str]]]:
        """(first word, owners) of every occurrence of a pattern within a row."""
        lo, hi = words.first[:-1] + self.m - 1, words.first[1:]
        rows = np.flatnonzero(hi > lo)
        if not len(rows):
            return
        many = -(-(hi[rows] - lo[rows]) // STRETCH)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(lo[rows], many) + nth * STRETCH
        end = np.minimum(at + STRETCH, np.repeat(hi[rows], many))
        found = []
        while len(at):
            slot = self.slot(h, at)
            step = self.shift[slot]
            zero = step == 0
            if zero.any():
                found.append(np.stack((at[zero], slot[zero])))
            at = at + np.maximum(step, 1)
            go = at < end
            at, end = at[go], end[go]
        if not found:
            return
        last, slot = np.concatenate(found, axis=1)
        first = last - self.m + 1
        key = seq.of(first, last + 1)
        near = np.minimum(np.searchsorted(self.whole, key), len(self.whole) - 1)
        for f, s in zip(first[self.whole[near] == key].tolist(), slot[self.whole[near] == key].tolist(), strict=True):
            text = tuple(words.text(f + k) for k in range(self.m))
            for k in self.bucket[s]:
                if self.patterns[k] == text:
                    yield f, self.owners[k]


def pattern_tables(items: list[tuple[str, str]], window: int) -> list[PatternTable]:
    """One table per pattern length: windows of ``window`` words, shorter items whole."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        data, offsets = string_buffer(pa.array([text], pa.string()))
        w = Words(data, offsets, ALNUM, lower=True)
        n = len(w.start)
        words = [w.text(i) for i in range(n)]
        for i in range(max(1, n - window + 1) if n else 0):
            owners[tuple(words[i : i + window])].add(item)
    by_length = defaultdict(list)
    for p in owners:
        by_length[len(p)].append(p)
    return [PatternTable(m, ps, [owners[p] for p in ps]) for m, ps in sorted(by_length.items())]


def _union(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searcher(tables, text: str, prefix: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = tables.value
        for batch, words in word_runs(batches, text, ALNUM, lower=True):
            h = words.hashes()
            seq = Sequences(h)
            hits: dict[int, list] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            for table in patterns:
                for first, owners in table.search(words, h, seq):
                    row = int(np.searchsorted(words.first, first, side="right")) - 1
                    at = first - int(words.first[row])
                    hits[row].append((at, at + table.m))
                    items[row] |= owners
            spans = [_union(hits[r]) if r in hits else [] for r in range(words.rows)]
            flat = np.array([x for s in spans for x in s], np.int32).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["first", "end"])
            names = [sorted(items[r]) if r in items else [] for r in range(words.rows)]
            found = [pa.array(np.diff(words.first).astype(np.int64)), list_array(pairs, np.array([len(s) for s in spans])), pa.array(names, pa.list_(pa.string()))]
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*batch.schema.names, *[prefix + n for n in FOUND]])

    return search


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_words: int = 500_000, prefix: str = "",
) -> DataFrame:
    """All columns of ``docs`` with n_words, hits (disjoint word ranges inside occurrences) and
    items (ids, as sorted strings, of the items with an occurring window).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts
    have no words and no hits; so do items, which then match nothing. Rows that repeat are kept.
    A null item id is named "null". ``block_words`` bounds the benchmark words sent to the tasks
    at once. ``prefix`` goes before the three new names; columns of ``docs`` that still have one of
    them are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*[prefix + n for n in FOUND])
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("words")
    )
    size = items.agg(F.sum(F.length("words") / 2 + 1)).first()[0] or 0  # at least the number of words
    blocks = max(1, -(-int(size) // block_words))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += "".join(f", {prefix}{n} {kind}" for n, kind in FOUND.items())
    parts = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        tables = spark.sparkContext.broadcast(pattern_tables([(r.item, r.words) for r in rows], window))
        parts.append(docs.mapInArrow(_searcher(tables, text_col, prefix), schema))
    if blocks == 1:
        return parts[0]
    return _joined(parts, docs.columns, blocks, prefix)


def _joined(parts: list[DataFrame], names: list[str], blocks: int, prefix: str) -> DataFrame:
    """The places of all blocks per row; whole repeats of a row are counted and restored."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    hits, items = f"{prefix}hits", f"{prefix}items"
    copies, copy = fresh(both, "_rows", "_row")
    grouped = both.groupBy(*[F.col(f"`{n}`") for n in names], f"{prefix}n_words").agg(
        F.array_sort(F.flatten(F.collect_list(hits))).alias(hits), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
        (F.count(F.lit(1)) / blocks).cast("int").alias(copies),
    )
    merge = f"""aggregate({hits}, cast(array() as array<struct<first:int,end:int>>), (a, h) ->
        if(size(a) > 0 and h.first <= a[size(a) - 1].end,
           concat(slice(a, 1, size(a) - 1), array(named_struct('first', a[size(a) - 1].first, 'end', greatest(h.end, a[size(a) - 1].end)))),
           concat(a, array(h))))"""
    out = grouped.withColumn(hits, F.expr(merge)).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return out.drop(copy, copies)


def contamination(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``find_passages`` rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["end"] - h["first"])
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


