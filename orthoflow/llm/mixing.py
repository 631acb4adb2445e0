"""Mixing sources to target weights (operator 9), DataFrame functions only.

Method: systematic sampling. Within each source the expected copies of its documents are summed
in one fixed order, one random offset is added, and a document is emitted once for each integer
boundary that its share of the sum crosses. The order goes by size, so that short and long documents are
taken in proportion and the words come near the target.

The running sum of a source is split over buckets of that order: bucket totals first (one small
row per bucket), then a running count inside each bucket. No task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthoflow.llm.common import small, stage

#: fractional bits of a rate; rates and offsets are integers, so reruns agree to the last copy
RATE_BITS = 24
#: random offsets of a source to choose from
OFFSETS = 16


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> the same with ``target``: shares of all sizes by weight, none above
    ``most`` times its source's size, the excess reshared by weight.

    Weights repeat over the sources in order of code points, null last. The reshared solution is
    a water level: sources whose cap is low for their weight are full, all others get weight times
    level. One row per source, so the running sums over all sources are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("full_before", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_before", F.sum("w").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    )
    level = (F.col("total") - F.coalesce("full_before", F.lit(0))) / (F.col("all_w") - F.coalesce("w_before", F.lit(0)))
    # the first source, in order of cap/weight, that the level does not fill sets the level
    t = t.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    t = t.withColumn("rank", F.row_number().over(by_level))
    t = t.withColumn("first_open", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(everything))
    target = F.when(F.col("rank") >= F.col("first_open.rank"), F.col("w") * F.col("first_open.level")).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix emits the document, ``taken`` copies times size; a rate of at
    most ``most`` means no document exceeds ``most`` copies. The order inside a source hangs on
    size and on a hash of the id, the offset on a hash of the source, so reruns agree. Rows that
    repeat id and text get the same places in either order. A null id sorts by an empty hash, a
    null source is a source of its own, a null or empty text has size 0 and nothing is taken.
    A table without words has target 0 everywhere; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    bits = F.length(F.bin("size"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # size class: length in bits and the next three bits; monotone in size
    rows = stage(
        rows.withColumn("class", bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int"))
        .withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, 3)),
        "mix-rows",
    )
    buckets = rows.groupBy("source", "class", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    buckets = stage(buckets, "mix-buckets")
    per_source = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    unit = 1 << RATE_BITS
    per_source = per_source.withColumn(
        "rate", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * unit)).otherwise(0).cast("bigint")
    )
    # totals of the buckets before, in the order of class and bucket; then back by equal keys
    before = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.join(per_source, placed["source"].eqNullSafe(per_source["source"])).select(
        placed["source"], "class", "bucket", "before", "source_size", "target", "rate"
    )
    inside = Window.partitionBy("source", "class", "bucket").orderBy("size", "digest", "doc_id")
    ranked = rows.withColumn("inside", F.row_number().over(inside))
    keys = ranked["source"].eqNullSafe(placed["source"]) & (ranked["class"] == placed["class"]) & (ranked["bucket"] == placed["bucket"])
    places = stage(
        ranked.join(placed, keys).select("doc_id", ranked["source"], "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("k"), "rate"),
        "mix-places",
    )
    chosen = small(_offsets(places, seed).withColumnRenamed("source", "_source"), 64)
    out = places.join(chosen, F.col("source").eqNullSafe(F.col("_source")))
    out = out.withColumn("copies", _crossed(F.col("offset")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _crossed(offset: Column) -> Column:
    """Integer boundaries between the running sums, with the offset, before and after a document."""
    after = F.shiftright(F.col("k") * F.col("rate") + offset, RATE_BITS)
    return after - F.shiftright((F.col("k") - 1) * F.col("rate") + offset, RATE_BITS)


def _offsets(places: DataFrame, seed: str) -> DataFrame:
    """source, offset: of ``OFFSETS`` random offsets, the one whose words come nearest the target.
    Without a choice, one very long document can carry a small source far from it."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit(""))), 256)
    drawn = [F.conv(F.substring("digest", 1 + 3 * j, RATE_BITS // 4), 16, 10).cast("bigint") for j in range(OFFSETS)]
    sums = places.withColumn("digest", digest).groupBy("source", "digest").agg(
        F.max("target").alias("target"), *[F.sum(F.col("size") * _crossed(drawn[j])).alias(f"t{j}") for j in range(OFFSETS)]
    )
    nearest = F.least(*[F.struct(F.abs(F.col(f"t{j}") - F.col("target")).alias("off"), F.lit(j).alias("j"), drawn[j].alias("offset")) for j in range(OFFSETS)])
    return stage(sums.select("source", nearest["offset"].alias("offset")), "mix-offsets")
