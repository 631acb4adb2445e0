"""Exact dedup (operator 3), DataFrame functions only.

Method: group by a 128-bit content hash, keep one row by its stable id, and compare bytes inside
groups to exclude collisions. Only ids, hashes and sizes are shuffled for all rows; texts move
only for rows whose hash occurs more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import ascii_lower, fresh, small, stage


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` names
    the id that stays: "largest" or "smallest". Rows that repeat an id within a group are all
    members (group_size counts them); those with the kept id are all marked kept. A null id
    stays only if its group has no other. An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    best = F.max if keep == "largest" else F.min
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    rows = stage(
        texts.select("doc_id", F.unhex(F.md5("body")).alias("key"), F.sha2("body", 256).alias("text_sha256")),
        "exact-rows",
    )
    groups = rows.groupBy("key").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stage(groups, "exact-groups")

    # Bytes are compared inside groups of two and more: each row against the kept row's text.
    several = stage(groups.filter("group_size > 1").select("key", "keep_id"), "exact-several")
    hashed = texts.withColumn("key", F.unhex(F.md5("body")))
    members = stage(hashed.join(small(several, 48), "key"), "exact-members")
    kept_text = (
        members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("key").agg(best("body").alias("kept_body"))  # repeated ids: one text stands for the group
    )
    differs = members.join(kept_text, "key").filter("body != kept_body").select("key", "doc_id", "body")
    differs = stage(differs, "exact-collisions")
    plain = rows.join(groups, "key").select("doc_id", "keep_id", "group_size", _kept(), "text_sha256")
    if differs.isEmpty():
        return plain
    return _with_collisions(hashed, differs, best)


def _kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")


def _with_collisions(hashed: DataFrame, differs: DataFrame, best) -> DataFrame:
    """The same result, with the groups whose hash stands for several texts told apart by text."""
    bad = differs.select("key").distinct()
    by = ["key", "part"]
    # rows of a colliding group are keyed by their whole text as well, all others by the hash alone
    parts = hashed.join(bad.withColumn("hit", F.lit(True)), "key", "left").withColumn(
        "part", F.when(F.col("hit"), F.col("body")).otherwise(F.lit(""))
    )
    groups = parts.groupBy(*by).agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return parts.join(groups, by).select("doc_id", "keep_id", "group_size", _kept(), F.sha2("body", 256).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row per distinct text (see ``exact_dedup``), all columns as they are.

    Rows that repeat the kept id and its text are dropped but for one of them.
    """
    found = stage(exact_dedup(docs, id_col, text_col, keep).select("doc_id", "text_sha256", "kept"), "exact-judged")
    # a row is known by its id and text; a null id by the empty string
    sha, known_id, known_sha = fresh(docs, "_sha", "_id", "_gone")
    rows = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    names = F.col("doc_id").alias(known_id), F.col("text_sha256").alias(known_sha)
    same = F.col(id_col).eqNullSafe(F.col(known_id)) & (F.col(sha) == F.col(known_sha))
    gone = stage(found.filter("not kept").select(*names).distinct(), "exact-gone")
    rest = rows.join(small(gone, 100), same, "left_anti")
    twice = found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").select(*names)
    twice = stage(twice, "exact-twice")
    if twice.isEmpty():
        return rest.drop(sha)
    once = rest.join(twice, same, "left_semi").dropDuplicates([id_col, sha])
    return rest.join(twice, same, "left_anti").unionByName(once).drop(sha)
