"""The pipeline's stages, each against brute force on the rows that its predecessor kept."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orthoflow.llm import mixing
from orthoflow.llm.common import scratch_path
from test_operators import ALNUM, jaccard_brute, low, passages_brute, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hits string, kept string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    root = str(tmp_path_factory.mktemp("corpus"))
    base, leak = prose(1, 80), prose(77, 30)
    rows = []
    for i in range(160):
        w = prose(500 + i, int(rng.integers(20, 60)))
        if i % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), ["awful", "nasty", "vile"][int(rng.integers(3))])
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:40] + [f"n{i}"] + base[41:])) for i in range(8)]
    rows += [(220 + i, ("Copied " if i % 2 else "copied ") + "words of a text that stands here several times over and over") for i in range(7)]
    rows += [(240 + i, " ".join(prose(900 + i, 15) + leak[5:20] + prose(950 + i, 15))) for i in range(4)]
    rows += [(260, None), (261, ""), (None, "a row without an id but with words")]
    docs = [(i, t, "en", None if (i or 0) % 9 == 0 else f"s{(i or 0) % 4}", 0, "x", "y", "z") for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, "short one")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns
        path = scratch_path(spark, "pipeline-test")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        at[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
        assert name == "mixing" or not set(at[name][1]) - set(at[name][0])  # rows are kept or dropped, not changed

    ids = lambda rows: {r[0] for r in rows}
    before, after = at["toxicity"]
    bad = {"awful", "nasty", "vile"}
    toxic = {r[0] for r in before if bad & set(ALNUM.findall(low(r[1])))}
    dropped = ids(before) - ids(after)
    assert len(dropped & toxic) >= 0.9 * len(toxic) and len(dropped - toxic) <= 2

    before, after = at["exact dedup"]
    groups = collections.defaultdict(list)
    for r in before:
        groups[low(r[1])].append(r[0])
    assert ids(after) == {max(g, key=lambda i: -1 if i is None else i) for g in groups.values()} and len(after) == len(groups)

    before, after = at["near dedup"]
    known = jaccard_brute([(r[0], r[1]) for r in before if r[0] is not None])
    assert ids(after) == {i for i, (_, c) in known.items() if i == c} | {None}

    before, after = at["decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = passages_brute([r[:2] for r in before], bench)
    assert ids(after) == {i for i, f in found.items() if not f[4]} and len(ids(before) - ids(after)) == 4

    before, after = at["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(before, SCHEMA)).collect()}
    assert collections.Counter(r[0] for r in after) == collections.Counter({i: n for i, n in copies.items() if n})
    assert all(sorted(r[-1] for r in after if r[0] == i) == list(range(1, n + 1)) for i, n in copies.items())


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, sf_dir).count() == 0


def test_repeated_ids_in_the_mix(spark, sf_dir):
    """Rows that share id, source and size get the copies of their group between them."""
    rows = [(1, f"one two t{i}", "en", "s", 0, "x", "y", "z") for i in range(6)] + [(2, "a b c d", "en", "t", 0, "x", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.mix(spark, docs, sf_dir)
    want = mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == want and out.columns == [*docs.columns, "copy"]


CLASHING = ["_id", "_words", "_hits", "_sha", "_toxicity", "_gone", "_KEY", "_source", "_size", "_turn", "_nth", "_copies", "_rows", "_row", "_n_words", "label", "key", "body", "copies", "hits", "items", "n", "set"]


def test_clashing_columns(spark, sf_dir):
    """Columns with any name pass all stages unchanged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("size", "hits", "kept")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    for name, step in corpus_pipeline.STAGES:
        path = scratch_path(spark, "pipeline-clash")
        step(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns + (["copy"] if name == "mixing" else [])
        assert out.count() > 0 and out.select(*CLASHING).distinct().count() == 1
        assert list(out.select(*CLASHING).first()) == list(range(len(CLASHING)))
        docs = out


def test_near_copies_by_row(spark, sf_dir):
    """Rows that share an id are judged by their own texts; rows without one are dropped like others;
    identical rows of a component leave one."""
    base = prose(3, 60)
    near = [" ".join(base[:20] + [f"x{i}"] + base[21:]) for i in range(6)]
    clean = " ".join(prose(4, 50))
    rows = [(1, near[0]), (5, near[1]), (5, clean), (None, near[2]), (7, near[3]), (7, near[4]), (8, clean.upper()), (1, near[0]), (9, None), (9, None), (9, " ")]
    rows += [(None, " ".join(prose(6, 40))), (None, " ".join(prose(6, 40)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect())
    assert got == collections.Counter({(1, near[0]): 1, (5, clean): 1, (9, None): 2, (9, " "): 1, (None, rows[-1][1]): 1})
