"""Round trips, save modes, stream errors and generator determinism."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflow.operators import generate as gen
from orthoflow.operators import steps
from orthoflow.plans import fixtures as fx
from orthoflow.session import scratch_dir
from orthoflow.sources import matstream, storage, streams


def _cells(df):
    return sorted((r["seq"], tuple(r["cells"])) for r in df.collect())


def test_mat_roundtrip_bit_exact(spark, sf):
    packed = fx.embedding_packed(spark, sf, 16, 4)
    out = scratch_dir(spark, "t-mat")
    streams.write_mat(packed, out, parts=3)
    back = streams.with_stream_index(streams.read_mat(spark, out, chunk_bytes=2048, split_min_bytes=0))
    whole = streams.with_stream_index(streams.read_mat(spark, out))
    assert sorted(map(tuple, whole.select("matrix_id", "cells").collect())) == \
        sorted(map(tuple, back.select("matrix_id", "cells").collect()))
    a = {r["matrix_id"]: r["cells"] for r in packed.collect()}
    order = sorted(a)
    b = {r["matrix_id"]: r["cells"] for r in back.collect()}
    assert [a[k] for k in order] == [b[i] for i in range(len(order))]


def test_save_mode_refuses_existing(spark, sf):
    packed = fx.embedding_packed(spark, sf, 16, 4).limit(3)
    out = scratch_dir(spark, "t-mode")
    streams.write_mat(packed, out, parts=1)
    with pytest.raises(Exception):
        streams.write_mat(packed, out, parts=1)
    streams.write_mat(packed, out, mode="overwrite", parts=1)


def test_truncated_file_fails_in_reader(spark, tmp_path):
    d = tmp_path / "mats"
    d.mkdir()
    (d / "a.mat").write_bytes(struct.pack(">QQ", 2, 2) + struct.pack(">4d", 1, 2, 3, 4) + b"\x00" * 5)
    with pytest.raises(Exception, match="Truncated header"):
        streams.read_mat(spark, str(d)).collect()


@pytest.mark.parametrize("whole", [False, True])
def test_text_reader_quirks(spark, tmp_path, whole):
    d = tmp_path / "txt"
    d.mkdir()
    (d / "a.txt").write_text("\n\n1 0\n0 1\n\n\n \t\n2 0 0\r\n0 3 0\n0 0 4")
    got = streams.read_txt(spark, str(d / "*.txt"), whole_files=whole).orderBy("seq").collect()
    assert [(r["seq"], r["n_rows"], r["n_cols"]) for r in got] == [(0, 2, 2), (1, 3, 3)]
    assert got[1]["cells"] == [2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 4.0]
    (d / "a.txt").write_text("1 2\n3\n")
    with pytest.raises(Exception):
        streams.read_txt(spark, str(d / "*.txt"), whole_files=whole).collect()
    (d / "a.txt").write_text("1 x\n")
    with pytest.raises(Exception):
        streams.read_txt(spark, str(d / "*.txt"), whole_files=whole).collect()


def test_text_lines_across_splits(spark, tmp_path):
    """Many matrices in one file read with tiny splits: blocks cross split boundaries."""
    rng = np.random.default_rng(2)
    mats = [rng.normal(size=(int(rng.integers(1, 6)), int(rng.integers(1, 4)))) for _ in range(60)]
    text = "\n\n".join("\n".join(" ".join(repr(float(v)) for v in row) for row in m) for m in mats)
    d = tmp_path / "big"
    d.mkdir()
    (d / "m.txt").write_text("\n" + text + "\n\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = streams.read_txt(spark, str(d / "*.txt")).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(mats)
    for r, m in zip(got, mats):
        assert (r["n_rows"], r["n_cols"]) == m.shape and r["cells"] == m.ravel().tolist()


def test_generator_independent_of_partitioning(spark, sf):
    o = gen.GenOptions(value_distribution="low-rank")
    cases = spark.range(0, 12).select(F.lit(0).cast("bigint").alias("file_index"), F.col("id").alias("case_index"))
    shaped = gen.choose_shapes(cases, gen.shape_candidates(spark, o), o)
    a = gen.generate_cells(shaped, o).orderBy("case_index", "r", "c").collect()
    b = gen.generate_cells(shaped.repartition(7), o).orderBy("case_index", "r", "c").collect()
    assert a == b


def test_low_rank_has_rank(spark):
    o = gen.GenOptions(value_distribution="low-rank", rows=(32,), columns=(16,))
    cases = spark.range(0, 3).select(F.lit(0).cast("bigint").alias("file_index"), F.col("id").alias("case_index"))
    packed = gen.generate_packed(gen.choose_shapes(cases, gen.shape_candidates(spark, o), o), o)
    for r in packed.collect():
        s = np.linalg.svd(np.array(r["cells"]).reshape(32, 16), compute_uv=False)
        assert s[4] / s[0] < 1e-5


def test_gen_uniform_svd_matches_numpy(spark, sf):
    from orthoflow.plans import q_generate
    from orthoflow.operators import svd

    o = gen.GenOptions()
    packed = gen.generate_packed(q_generate._shaped(spark, sf, o), o)
    res = {r["matrix_id"]: r["sigma"] for r in svd.svd(packed, strategy="batch", with_u=False).collect()}
    for r in packed.collect():
        a = np.array(r["cells"]).reshape(r["n_rows"], r["n_cols"])
        assert np.allclose(sorted(res[r["matrix_id"]], reverse=True), np.linalg.svd(a, compute_uv=False), rtol=1e-9)


def test_factor_sink_and_report_sinks(spark, sf):
    from orthoflow.operators import logs, svd

    res = svd.svd(fx.embedding_packed(spark, sf, 16, 4).filter(F.col("matrix_id") < 5), strategy="batch")
    fp = streams.factor_packed(res).withColumnRenamed("seq", "matrix_id")
    out = scratch_dir(spark, "t-factors")
    streams.write_mat(fp, out, parts=2)
    back = streams.with_stream_index(streams.read_mat(spark, out)).orderBy("matrix_id").collect()
    assert [(r["n_rows"], r["n_cols"]) for r in back[:3]] == [(16, 4), (1, 4), (4, 4)]
    assert len(back) == 15
    rep = svd.svd_report(res)
    d = scratch_dir(spark, "t-report")
    logs.write_records(res.select("matrix_id", "sigma", "sweeps"), d)
    logs.write_summary_csv(rep, d)
    assert spark.read.json(d + "/records").count() == 5
    assert spark.read.option("header", "true").csv(d + "/summary").first()["testcase_count"] == "5"


def test_format_and_paths_guard(spark):
    df = spark.createDataFrame([("a/b.MAT",), ("c.txt",), ("d.bin",)], "p string")
    got = [r[0] for r in df.select(streams.resolve_format(F.col("p"))).collect()]
    assert got == ["mat", "txt", None]
    with pytest.raises(Exception, match="unknown matrix format"):
        df.select(streams.resolve_format(F.col("p"), strict=True)).collect()


def test_generate_packed_has_no_exchange_or_join(spark):
    """Scale guard: generation is one projection per case (no shuffle, no join)."""
    o = gen.GenOptions(shape_distribution="log-uniform", value_distribution="low-rank")
    cases = spark.range(0, 50).select(F.lit(0).cast("bigint").alias("file_index"), F.col("id").alias("case_index"))
    plan = gen.generate_packed(gen.choose_shapes(cases, gen.shape_candidates(spark, o), o), o)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def _three(spark):
    mats = [np.arange(6.0).reshape(3, 2), np.ones((4, 3)), np.arange(4000.0).reshape(1000, 4)]
    return mats, spark.createDataFrame([(i, a.shape[0], a.shape[1], a.ravel().tolist()) for i, a in enumerate(mats)],
                                       "matrix_id long, n_rows long, n_cols long, cells array<double>")


def test_missing_stream_is_an_error(spark, tmp_path):
    matstream.register(spark)
    for path in (str(tmp_path / "none"), str(tmp_path / "*.mat"), "zzz://bucket/x"):
        with pytest.raises(Exception, match="not found|no matrix stream|no file system"):
            spark.read.format("matstream").load(path).count()


def test_failed_overwrite_keeps_the_old_output(spark, tmp_path):
    mats, df = _three(spark)
    out = str(tmp_path / "out")
    streams.write_mat(df, out, parts=2)
    bad = df.withColumn("n_rows", F.when(F.col("matrix_id") == 2, F.lit(7)).otherwise(F.col("n_rows")))
    with pytest.raises(Exception, match="size mismatch"):
        streams.write_mat(bad, out, mode="overwrite", parts=2)
    assert spark.read.format("matstream").load(out).count() == 3
    assert len(storage.folders(out)) == 1
    streams.write_mat(df.filter("matrix_id = 1"), out, mode="overwrite", parts=1)
    assert spark.read.format("matstream").load(out).count() == 1


def test_row_form_splits_a_record(spark, tmp_path):
    mats, df = _three(spark)
    out = str(tmp_path / "out")
    streams.write_mat(df, out, parts=1)
    rows = streams.read_mat(spark, out, chunk_bytes=4096, split_min_bytes=1, form="rows")
    assert rows.rdd.getNumPartitions() > 5
    got = {}
    for r in rows.collect():
        got.setdefault(r.seq, {})[r.r] = r.x
    assert {k: len(v) for k, v in got.items()} == {0: 3, 1: 4, 2: 1000}
    assert all(np.array_equal([got[k][i] for i in range(len(a))], a) for k, a in enumerate(mats))


def test_case_ids_do_not_meet(spark):
    plan = spark.createDataFrame([(0, 1_000_000), (1, 0)], "file_index long, case_index long")
    o = gen.GenOptions()
    ids = [r.matrix_id for r in gen.generate_packed(gen.choose_shapes(plan, gen.shape_candidates(spark, o), o), o).select("matrix_id").collect()]
    assert len(set(ids)) == 2


def test_wide_exact_gram_stays_exact(spark):
    rows = spark.createDataFrame([(1, 0, [str(j) for j in range(34)]), (1, 1, ["1"] * 34)], "matrix_id long, r long, x array<string>")
    g = steps.gram(rows.withColumn("x", F.col("x").cast("array<decimal(10,2)>")), 34)
    assert g.schema["g"].dataType.typeName() == "decimal"
    assert {(r.i, r.j): int(r.g) for r in g.collect()} == {(i, j): i * j + 1 for i in range(34) for j in range(i, 34)}


def test_runs_of_a_split_log(spark, tmp_path):
    """One log over two batches is one record with the command of the first."""
    from orthoflow import streaming

    schema = "source_log string, line_no long, line string"
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    parts = [[("c/timing/run_1.log", 0, "$ app x"), ("c/timing/run_2.log", 0, "$ app y")], [("c/timing/run_1.log", 1, "Error: bad")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        out = {r.source_log: (r.command, r.status) for r in streaming.stream_runs(stream, sink, ckpt).collect()}
    assert out == {"c/timing/run_1.log": ("app x", "failed"), "c/timing/run_2.log": ("app y", "ok")}


@pytest.mark.parametrize("dist", ["low-rank", "ill-conditioned", "uniform"])
def test_cells_of_few_cases_are_dealt_out(spark, dist):
    """Cases that lie in one partition are generated by many tasks, and the cells equal the packed ones."""
    o = gen.GenOptions(value_distribution=dist, hash_fn="md5")
    plan = spark.range(60, numPartitions=1).select((F.col("id") % 2).alias("file_index"), F.col("id").alias("case_index"))
    shaped = gen.choose_shapes(plan, gen.shape_candidates(spark, o), o)
    cells = gen.generate_cells(shaped, o)
    assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    got = {(x.file_index, x.case_index, x.r, x.c): x.v for x in cells.collect()}
    packed = gen.generate_packed(shaped, o).collect()
    assert len(got) == sum(x.n_rows * x.n_cols for x in packed)
    for x in packed:
        f, k = x.matrix_id >> gen.FILE_SHIFT, x.matrix_id & ((1 << gen.FILE_SHIFT) - 1)
        assert np.allclose([got[f, k, i // x.n_cols, i % x.n_cols] for i in range(x.n_rows * x.n_cols)], x.cells, rtol=1e-12, atol=1e-15)


def test_benchmark_cells_are_dealt_out(spark):
    sizes = spark.range(40, numPartitions=1).select(F.col("id").alias("case_index"), (8 + F.col("id") % 3).alias("n"))
    cells = gen.benchmark_cells(sizes)
    assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert cells.count() == sum(2 * (8 + i % 3) ** 2 for i in range(40))
