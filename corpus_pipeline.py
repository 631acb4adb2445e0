"""A corpus pipeline: toxicity, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever else these
are called. Rows are judged one by one: rows that share an id, or have none, are told apart by
their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthoflow.llm import decontaminate, exact_dedup, mixing, ngram_jaccard, toxicity
from orthoflow.llm.common import fresh, prepare, scratch_path, small, stage
from orthoflow.llm.queries import held_out

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score at or above the threshold go. The model learns from the
    labelled rows that are not held out; labels decide about no document directly."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.train_toxicity(docs, labels, held_out=held_out())
    (score,) = fresh(docs, "_toxicity")
    return toxicity.score_toxicity(docs, weights, column=score).filter(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts, the row with the largest id stays, once."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component of similar texts, the document with the smallest id stays (of equal
    ids the one whose text has the smaller hash; a null id only if there is no other). Texts without
    words are similar to none."""
    key, gone_key = fresh(docs, "_key", "_gone")
    # a row is its id (none: beyond all) and 40 bits of its text, as one number that sorts by the id
    number = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")) * F.lit(1 << 40).cast("decimal(13,0)")
    mark = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 40)).cast("decimal(13,0)")
    keyed = docs.withColumn(key, (number + mark).cast("decimal(38,0)"))
    found = stage(ngram_jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text")), "pipeline-near").filter("n_shingles > 0")
    same = F.col(key).eqNullSafe(F.col(gone_key))
    gone = stage(found.filter("not doc_id <=> component_id").select(F.col("doc_id").alias(gone_key)).distinct(), "pipeline-gone")
    rest = keyed.join(small(gone, 32), same, "left_anti")
    twice = found.filter("doc_id <=> component_id").groupBy(F.col("doc_id").alias(gone_key)).count().filter("count > 1").select(gone_key)
    twice = stage(twice, "pipeline-twice")
    if twice.isEmpty():
        return rest.drop(key)
    once = rest.join(twice, same, "left_semi").dropDuplicates([key])
    return rest.join(twice, same, "left_anti").unionByName(once).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with a passage of a benchmark item go."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix=prefix)
    return found.filter(F.size(f"{prefix}hits") == 0).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: a row for each copy that the mix takes, numbered from 1 in column ``copy``."""
    docs = docs.drop("copy")
    id_, source, size, words, turn, nth, copies = fresh(docs, "_id", "_source", "_size", "_words", "_turn", "_nth", "_copies")
    keys = [id_, source, size]
    mixed = mixing.mix_sources(docs).select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies))
    mixed = stage(mixed, "pipeline-mix")
    rows = docs.withColumn(words, mixing.words(F.col("text")))
    here: list[Column] = [F.col("doc_id"), F.col("source"), F.col(words)]
    if mixed.groupBy(*keys).count().filter("count > 1").isEmpty():
        rows, mixed = rows.withColumn(turn, F.lit(1)), mixed.withColumn(nth, F.lit(1))
    else:  # rows that share id, source and size take their places in turn
        rows = rows.withColumn(turn, F.row_number().over(Window.partitionBy(*here).orderBy(F.xxhash64("text"))))
        mixed = mixed.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(copies)))
    taken = small(stage(mixed.filter(F.col(copies) > 0), "pipeline-taken"), 64)
    same = F.col(turn) == F.col(nth)
    for place, key in zip(here, keys, strict=True):
        same &= place.eqNullSafe(F.col(key))
    both = rows.join(taken, same)
    return both.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("copy"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix)]

#: Learned scores have no SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
