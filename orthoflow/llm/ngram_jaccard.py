"""N-gram Jaccard join (operator 1): size-aware, heavy and light, components of similar texts.

Method. A document is its set of word shingles; sets that are equal are one node from the start.

* Light sets (few shingles) enumerate subsets: two sets of sizes n and m are similar exactly when
  they share a subset of the overlap that these sizes need, so every such subset becomes a key and
  equal keys are links. Nothing needs to be verified.
* Heavy sets scan inverted lists: similar sets share one of the first n - ceil(0.8 n) + 1 shingles
  of any one order of all shingles. The order puts frequent shingles last, by a sketch of fixed
  size that counts all shingles; its result only steers the work, any order is right.
* The boundary between the two is the size at which enumerating costs more rows than scanning.

Links are not made for all pairs of a list. Each list first hangs its members on one of them; what
is verified forms components; then only pairs of different components are left to compare. A pair
is verified by its prefixes first (an upper bound of the overlap), by its whole sets if they
pass. Only components are reported, so no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.llm.bloom import bloom
from orthoflow.llm.common import SPACED, Sequences, Words, drop_staged, few_files, list_array, mix, prepare, release, scratch, small, stage, window_starts, word_runs
from orthoflow.llm.components import components

SKETCH_BITS = 20
_BLOCK = 4096
LIGHT_LIMIT = 32  # sizes above are never light
COPY_GROUPS = 100_000
RARE_PASSES = 4  # parts of the rare shingles, so that the disk holds the shuffle of one
#: a shingle is 60 bits of hash below 3 bits of its frequency class, so it sorts by the order
_CLASS_BITS = 60


def need(n: int, m: int, percent: int = 80) -> int:
    """Least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int = 80) -> range:
    """Sizes that a similar set can have."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subsets_of(n: int, boundary: int, percent: int = 80) -> int:
    """Subsets that a set of n enumerates when all sizes up to the boundary are light."""
    return sum(comb(n, need(n, m, percent)) for m in partners(n, percent) if m <= boundary and not need(n, m, percent) == n == m)


def choose_boundary(sizes: dict[int, int], percent: int = 80) -> int:
    """The size up to which sets enumerate subsets, by rows: subsets against prefix and, for the
    verification that light sets are spared, the set itself."""

    def cost(boundary: int) -> int:
        reach = -(-percent * (boundary + 1) // 100)  # light sets that may have a heavy partner scan lists too
        total = 0
        for n, count in sizes.items():
            if n <= boundary:
                total += count * subsets_of(n, boundary, percent)
            if n >= reach:
                total += count * (n - -(-percent * n // 100) + 1 + n)
        return total

    return min(range(LIGHT_LIMIT + 1), key=lambda b: (cost(b), b))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles; a row of fewer words, but not none, is one shingle."""
    seq = Sequences(words.hashes())
    start = window_starts(words.first, k)
    row = np.searchsorted(words.first, start, side="right") - 1
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    hashes = np.concatenate((seq.of(start, start + k), seq.of(words.first[short], words.first[short] + count[short])))
    return np.concatenate((row, short)), hashes


def row_sets(words: Words, k: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in order, and where each row's begin."""
    row, h = shingles(words, k)
    token = (classes[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(_CLASS_BITS)) | (h >> np.uint64(64 - _CLASS_BITS))
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    return token, np.searchsorted(row, np.arange(words.rows + 1))


def set_keys(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, from sums over its members."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A35)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix((tokens & np.uint64((1 << _CLASS_BITS) - 1)) ^ salt))))
        out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)))
    return out[0], out[1]


# --- passes over the texts -------------------------------------------------------------------


def _count(k: int):
    """Counts of shingles by the sketch's cells, in blocks, and of rows by small sizes (block -1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        sizes = np.zeros(_BLOCK, np.int64)
        for _, words in word_runs(batches, "text", SPACED, lower=True):
            _, h = shingles(words, k)
            cells += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
            n = np.diff(words.first)
            sizes += np.bincount(np.minimum(np.where(n >= k, n - k + 1, np.minimum(n, 1)), _BLOCK - 1), minlength=_BLOCK)
        blocks = [*cells.astype(np.uint32).reshape(-1, _BLOCK), sizes.astype(np.uint32)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(blocks) - 1), -1], pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "counts"])

    return count


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(_BLOCK, np.int64))
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[block] += np.frombuffer(counts, np.uint32)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["block", "counts"])


def shingle_classes(texts: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int]]:
    """Frequency class (0 to 7) of every cell of the sketch, and how many rows have each size."""
    counted = texts.mapInArrow(_count(k), "block int, counts binary").repartition("block").mapInArrow(_add, "block int, counts binary")
    cells = np.zeros((1 << SKETCH_BITS) // _BLOCK * _BLOCK, np.int64).reshape(-1, _BLOCK)
    sizes = np.zeros(_BLOCK, np.int64)
    for r in counted.coalesce(8).toLocalIterator():  # a fixed number of blocks; a job for each partition
        (sizes if r["block"] < 0 else cells[r["block"]])[:] += np.frombuffer(r["counts"], np.int64)
    usual = max(16.0, 4.0 * cells.mean())
    classes = np.clip(np.ceil(np.log2(np.maximum(cells.ravel(), 1) / usual)), 0, 7).astype(np.uint8)
    return classes, {n: int(c) for n, c in enumerate(sizes.tolist()) if n and c}


def _subset_keys(tokens: list[int], boundary: int, percent: int) -> Iterator[tuple[bytes, bool, bool]]:
    """(key, whether this set has the smaller size, the larger size) of the subsets of a light set."""
    n = len(tokens)
    for m in partners(n, percent):
        overlap = need(n, m, percent)
        if m > boundary or overlap == n == m:  # the latter are equal sets
            continue
        tag = f"{min(n, m)} {max(n, m)} ".encode()
        for chosen in combinations(tokens, overlap):
            yield hashlib.blake2b(tag + np.array(chosen, np.uint64).tobytes(), digest_size=16).digest(), n <= m, n >= m


SETS = "n long, set long, set2 long, rare array<long>, common array<long>, light array<struct<key:binary,small:boolean,large:boolean>>"


def _sets(k: int, percent: int, boundary: int, sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sent.value
        light_type = pa.list_(pa.struct([("key", pa.binary()), ("small", pa.bool_()), ("large", pa.bool_())]))
        reach = -(-percent * (boundary + 1) // 100)
        for batch, words in word_runs(batches, "text", SPACED, lower=True):
            tokens, first = row_sets(words, k, classes)
            n = np.diff(first)
            one, two = set_keys(tokens, first)
            many = np.where(n >= reach, n - -(-percent * n // 100) + 1, 0) * (n > 0)
            at = np.arange(int(many.sum())) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
            prefix = tokens[at].view(np.int64)
            row = np.repeat(np.arange(words.rows), many)
            seldom = prefix < 1 << _CLASS_BITS
            lists = [list_array(prefix[part], np.bincount(row[part], minlength=words.rows)) for part in (seldom, ~seldom)]
            light = [[] for _ in range(words.rows)]
            for r in np.flatnonzero((n > 0) & (n <= boundary)).tolist():
                light[r] = [{"key": x, "small": s, "large": g} for x, s, g in _subset_keys(tokens[first[r] : first[r + 1]].tolist(), boundary, percent)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *lists, pa.array(light, light_type)],
                ["id", "n", "set", "set2", "rare", "common", "light"],
            )

    return rows


def _whole_sets(k: int, sent):
    """The whole sets of the nodes that the filter knows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, wanted = sent.value
        for batch, words in word_runs(batches, "text", SPACED, lower=True):
            tokens, first = row_sets(words, k, classes)
            one, two = set_keys(tokens, first)
            n = np.diff(first)
            go = (n > 0) & wanted.has(one)
            part = tokens[np.repeat(go, n)].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(go)), pa.array(one[go].view(np.int64)), pa.array(two[go].view(np.int64)), list_array(part, n[go])], ["id", "set", "set2", "members"])

    return rows


# --- candidates and links --------------------------------------------------------------------


def _similar(a: Column, b: Column, overlap: Column, percent: int) -> Column:
    return overlap * (100 + percent) >= (a + b) * percent


def _posting(place: str) -> Column:
    """Place in the prefix above bit 32, n below: the least has the fewest members before it."""
    return (F.shiftleft(F.col(place).cast("bigint"), 32) + F.col("n")).alias("where")


def _pair_filter(percent: int) -> Column:
    """Whether the sizes and the places of a shared shingle leave room for enough overlap."""
    i, j = F.shiftright("x_where", 32), F.shiftright("y_where", 32)
    n, m = F.expr("x_where & 4294967295"), F.expr("y_where & 4294967295")
    return _similar(n, m, F.least(n - i, m - j), percent)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _by_prefix(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes allow enough overlap. Of the set whose prefix ends first in the order all
    shared members up to there are shared by the prefixes, so the overlap is at most what they
    share and what that set has left. The prefixes travel as 15 bits of each member: members that
    share them within a prefix are added to the count, so it is never too low."""
    rows = 2 * pairs.count()
    ends = stage(few_files(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), rows), "jaccard-brief-ends")
    brief = stage(few_files(prefixes.join(small(ends, 16, rows=rows), "node").dropDuplicates(["node"]), rows), "jaccard-brief")
    one, two = (brief.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "p", "bits")]) for c in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b")
    double = F.least(*[F.col(f"{c}_p") - F.size(f"{c}_bits") for c in ("a", "b")])
    left = F.greatest(*[F.col(f"{c}_n") - F.col(f"{c}_p") for c in ("a", "b")])
    shared = F.size(F.array_intersect("a_bits", "b_bits")) + double
    return both.filter(_similar(F.col("a_n"), F.col("b_n"), shared + left, percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets are similar. The larger table travels once, by b, then by a."""
    one, two = (sets.select(F.col("node").alias(c), F.col("members").alias(f"{c}_m")) for c in ("a", "b"))
    both = pairs.join(two, "b").join(one, "a")
    return both.filter(_similar(F.size("a_m"), F.size("b_m"), F.size(F.array_intersect("a_m", "b_m")), percent)).select("a", "b")


class _Join:
    """The steps of one join over one input; staged tables as attributes."""

    def __init__(self, rows: DataFrame, k: int, percent: int):
        self.rows, self.k, self.percent = rows, k, percent
        self.spark = rows.sparkSession
        self.classes, sizes = shingle_classes(rows, k)
        self.boundary = choose_boundary(sizes, percent)
        self.sent = self.spark.sparkContext.broadcast(self.classes)

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """(id, n, node) of every row; the prefixes and subsets of the nodes' rows."""
        id_type = self.rows.schema["id"].dataType.simpleString()
        sets = stage(self.rows.mapInArrow(_sets(self.k, self.percent, self.boundary, self.sent), f"id {id_type}, {SETS}"), "jaccard-sets")
        groups = sets.filter("n > 0").groupBy("set").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("set2").alias("low"), F.max("set2").alias("high")
        )
        groups = stage(groups.filter("copies > 1"), "jaccard-copies")
        release(self.spark)
        # sets that share a 64-bit key (hardly ever) get keys of their own
        self.shared = stage(groups.filter("low != high").select("set").withColumn("shared", F.lit(True)), "jaccard-shared")
        sets = self._named(sets)
        # later copies of the most copied sets are left out; fewer copies of a set do no harm
        most = groups.filter("low = high and least is not null").orderBy(F.desc("copies"), "set").limit(COPY_GROUPS).select(F.col("set").alias("node"), "least")
        self.most = stage(most, "jaccard-most")
        members = stage(sets.select("id", "n", "node"), "jaccard-members")
        first = self._firsts(sets.filter("n > 0"))
        return members, first

    def _named(self, sets: DataFrame) -> DataFrame:
        named = sets.join(F.broadcast(self.shared) if self.shared.count() < 100_000 else self.shared, "set", "left")
        return named.withColumn("node", F.when(F.col("shared"), F.xxhash64("set", "set2")).otherwise(F.col("set"))).drop("shared")

    def _firsts(self, sets: DataFrame) -> DataFrame:
        return sets.join(F.broadcast(self.most), "node", "left").filter(F.col("least").isNull() | (F.col("id") == F.col("least"))).drop("least")

    def light_links(self, first: DataFrame) -> DataFrame:
        keys = first.filter(F.size("light") > 0).select("node", F.explode("light").alias("s")).select("node", "s.key", "s.small", "s.large")
        groups = keys.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other"), F.max("small").alias("small"), F.max("large").alias("large"))
        groups = groups.filter("center != other and small and large").select("key", "center")
        return keys.join(groups, "key").filter("node != center").select(*_ordered("node", "center")).distinct()

    def postings(self, first: DataFrame) -> DataFrame:
        """token, node, where, center (node and place) of every list that holds two nodes.

        The center is the node with the fewest shingles before this one. Among edited copies of
        one text that is the one nearest to the original: edits add shingles that no other
        copy has, and those come first in the order.
        """
        rare = first.select("node", "n", F.posexplode("rare").alias("i", "token")).select("token", "node", _posting("i"))
        common = first.select("node", "n", F.size("rare").alias("skip"), F.posexplode("common").alias("i", "token")).withColumn("i", F.col("i") + F.col("skip"))
        common = common.select("token", "node", _posting("i"))
        # lists of rare shingles are short (the sketch bounds them); those of common ones are
        # aggregated first and the staged heads joined back, so that Spark can split long lists
        whole = Window.partitionBy("token")
        head = F.struct("where", "node")
        lists = []
        for i in range(RARE_PASSES):
            part = rare.filter(F.pmod("token", F.lit(RARE_PASSES)) == i)
            part = part.withColumn("center", F.min(head).over(whole)).withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole))
            lists.append(stage(part.filter("low != high").drop("low", "high"), "jaccard-postings"))
            release(self.spark)
        heads = common.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("where").alias("least"))
        heads = stage(heads.filter("low != high").select("token", "least"), "jaccard-heads")
        common = stage(common.join(small(heads, 16), "token"), "jaccard-common")
        at_head = stage(common.filter("where = least").groupBy("token").agg(F.min("node").alias("head")), "jaccard-centers")
        common = common.join(small(at_head, 16), "token").select("token", "node", "where", F.struct(F.col("least").alias("where"), F.col("head").alias("node")).alias("center"))
        lists.append(stage(common, "jaccard-postings"))
        drop_staged(self.spark, "jaccard-heads", "jaccard-common", "jaccard-centers")
        return reduce(DataFrame.unionAll, lists)

    def prefixes(self, first: DataFrame) -> DataFrame:
        """node, n, p (size of the prefix) and bits (15 of each of its members) of the sets that scan
        lists; all that is needed of the prefixes once the lists are there."""
        prefix = F.concat("rare", "common")
        short = F.array_distinct(F.transform(prefix, lambda x: x.bitwiseAND(F.lit(0x7FFF)).cast("smallint")))
        return stage(first.filter(F.size("rare") + F.size("common") > 0).select("node", "n", F.size(prefix).alias("p"), short.alias("bits")), "jaccard-prefixes")

    def star_pairs(self, postings: DataFrame) -> DataFrame:
        pairs = postings.filter("node != center.node").select("node", F.col("where").alias("x_where"), F.col("center.node").alias("center"), F.col("center.where").alias("y_where"))
        return stage(pairs.filter(_pair_filter(self.percent)).select(*_ordered("node", "center")).distinct(), "jaccard-stars")

    def cross_pairs(self, postings: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs of different components that share a list and were not compared yet."""
        named = postings.select("token", "node", "where").join(small(labels, 16), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        named = stage(named, "jaccard-labelled")
        mixed = stage(named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("token"), "jaccard-tokens")
        named = stage(named.join(small(mixed, 8), "token"), "jaccard-mixed")
        drop_staged(self.spark, "jaccard-postings", "jaccard-labelled", "jaccard-tokens")
        x, y = (named.select("token", F.col("node").alias(f"{c}"), F.col("where").alias(f"{c}_where"), F.col("label").alias(f"{c}_label")) for c in "xy")
        pairs = x.join(y, "token").filter((F.col("x") < F.col("y")) & (F.col("x_label") != F.col("y_label")) & _pair_filter(self.percent))
        pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        crossing = stage(pairs.join(small(done, 16), ["a", "b"], "left_anti"), "jaccard-crossing")
        drop_staged(self.spark, "jaccard-mixed", "jaccard-stars")
        return crossing

    def verify(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        near = stage(_by_prefix(pairs, prefixes, self.percent).distinct(), "jaccard-near")
        drop_staged(self.spark, "jaccard-brief", "jaccard-brief-ends")
        rows = 2 * near.count()
        ends = stage(few_files(near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct(), rows), "jaccard-ends")
        wanted = bloom(ends, "node") if not self.shared.count() else bloom(ends.unionAll(self.shared.select(F.col("set").alias("node"))), "node")
        sent = self.spark.sparkContext.broadcast((self.classes, wanted))
        id_type = self.rows.schema["id"].dataType.simpleString()
        sets = self.rows.mapInArrow(_whole_sets(self.k, sent), f"id {id_type}, set long, set2 long, members array<long>")
        sets = self._firsts(self._named(sets)).select("node", "members")
        sets = stage(sets.join(small(ends, 8, rows=rows), "node", "left_semi"), "jaccard-whole")
        release(self.spark)
        links = stage(_verified(near, sets, self.percent).distinct(), "jaccard-links")
        drop_staged(self.spark, "jaccard-near", "jaccard-ends", "jaccard-whole")
        return links

    def labels(self, links: DataFrame) -> DataFrame:
        found = stage(components(links), "jaccard-labels")
        drop_staged(self.spark, "links", "links-least")
        return found


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a set is the distinct shingles of ``k``
    words, the whole sequence when there are fewer. Two rows link when 100 times their overlap is
    at least ``percent`` times their union. Null, empty and blank texts have no set and link with
    nothing, not even with each other. Rows that repeat a text are of one component, as are rows
    that repeat id and text. A null id is reachable but never the smallest, except alone: then the
    component is null. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch(docs.sparkSession) as keep:
        join = _Join(rows, k, percent)
        members, first = join.nodes()
        light = stage(join.light_links(first), "jaccard-light")
        postings = join.postings(first)
        prefixes = join.prefixes(first)
        drop_staged(docs.sparkSession, "jaccard-sets", "jaccard-copies")
        stars = join.star_pairs(postings)
        links = light.unionAll(join.verify(stars, prefixes))
        labels = join.labels(links)
        crossing = join.cross_pairs(postings, labels, stars)
        if not crossing.isEmpty():
            links = links.unionAll(join.verify(crossing, prefixes))
            labels = join.labels(links)
        label = F.coalesce("component", "node")
        named = keep(members.join(small(labels, 16), "node", "left").select("id", "n", label.alias("label")), "jaccard-named")
        smallest = keep(named.filter("n > 0").groupBy("label").agg(F.min("id").alias("component_id")), "jaccard-smallest")
    out = named.filter("n > 0").join(smallest, "label").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(named.filter("n = 0").select("id", "n", "id"))
