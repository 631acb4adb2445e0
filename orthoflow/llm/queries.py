"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.llm import conversations, decontaminate, exact_dedup, html_extract, license_scan, line_dedup, mixing, ngram_jaccard, secret_scan, substring_dedup, toxicity, warc, whitening
from orthoflow.llm.common import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Spark's and DuckDB's spelling of the word classes
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(len(ws), 5) - 1), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS root, doc_id FROM n UNION SELECT root, b FROM reach JOIN links ON links.a = reach.doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.low, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT root AS doc_id, min(doc_id) AS low FROM reach GROUP BY root) r USING (doc_id)"""
)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their shingles of five words."""
    return ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


@_query(
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n),
places AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM spots),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN wins USING (win, n)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, _table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found)


@_query(
    f"""
WITH t AS (SELECT doc_id, {_LOWER} AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)"""
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents; the largest id stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


@_query()
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near lines of all documents; the first occurrence stays."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


@_query()
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.page_report(warc.read_warc(spark, path))


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@_query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"), held_out=held_out())
    scored = toxicity.score_toxicity(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@_query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with ownership over the corpus: a document's source is its owner,
    source and language its repository."""
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"), owner="source", repository=F.struct("source", "lang"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "n_copied", "n_live"
    )


@_query(
    rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
v AS (SELECT *, row_number() OVER o AS rank,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)),
f AS (SELECT min(rank) AS first_open, arg_min(level, rank) AS open_level FROM v WHERE level * w <= cap),
t AS (SELECT source, source_size, CASE WHEN rank >= first_open THEN w * open_level ELSE CAST(cap AS DOUBLE) END AS target FROM v, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS rate,
  sha256('mix' || coalesce(':' || source, '')) AS digest FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, digest, doc_id) AS k FROM (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class, substr(digest, 1, 3) AS bucket
  FROM (SELECT *, md5('mix' || CAST(doc_id AS VARCHAR)) AS digest FROM d))),
o AS (SELECT source, source_size, target, rate, j, CAST('0x' || substr(digest, 1 + 3 * j, 6) AS BIGINT) AS off FROM r, (SELECT unnest(range(16)) AS j)),
c AS (SELECT k.doc_id, k.source, k.size, o.source_size, o.target, o.j, CAST(((k * rate + off) >> 24) - (((k - 1) * rate + off) >> 24) AS BIGINT) AS copies
  FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source),
near AS (SELECT source, arg_min(j, (off_by, j)) AS j FROM (SELECT source, j, abs(sum(size * copies) - any_value(target)) AS off_by FROM c GROUP BY source, j) GROUP BY source)
SELECT c.doc_id, c.source, c.size, c.source_size, c.target, c.copies, CAST(c.size * c.copies AS BIGINT) AS taken
FROM c JOIN near ON c.source IS NOT DISTINCT FROM near.source AND c.j = near.j"""
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of the sources by weight."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@_query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License names, notices and identifier expressions of every document."""
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base_labels").alias("base_labels"), join("labels").alias("labels"), "score", "permitted")


@_query(
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS ws FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
wins AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS win FROM spots),
firsts AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM wins JOIN firsts USING (win) WHERE doc_id > low),
gone_list AS (SELECT doc_id, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, coalesce(n_removed, 0) AS n_removed, len(ws) AS n_words,
  CASE WHEN n_removed IS NULL THEN array_to_string(ws, ' ')
  ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]), ' ') END AS body
  FROM w LEFT JOIN gone_list USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM kept"""
)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 13 words of all documents; the smallest id keeps them."""
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


@_query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four leading components of their whitening."""
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


@_query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after a fixed damage."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(rows, conversations.damage(rows))


@_query()
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the templates of their sites."""
    return html_extract.text_report(html_extract.extract_text(_table(spark, sf_dir, "pages")))
