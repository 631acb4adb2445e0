"""Matrix streams: index, runs and pointer, ranges, streaming, refusals."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthoflow import streaming
from orthoflow.sources import matstream, storage, stream_index, streams

SCHEMA = "matrix_id long, n_rows long, n_cols long, cells array<double>"


def record(a):
    return struct.pack(">QQ", *a.shape) + a.astype(">f8").tobytes()


def hostile(rng):
    """Matrices whose payloads look like headers, hold zeros, or nothing."""
    kind = rng.randrange(5)
    if kind == 0:
        return np.zeros((rng.randrange(6), rng.randrange(6)))
    if kind == 1:  # pairs that read as headers of small records
        pairs = np.array([[rng.randrange(3), rng.randrange(4)] for _ in range(rng.randrange(1, 9))], ">u8")
        return pairs.view(">f8").astype(float) if False else pairs.view(">f8")
    if kind == 2:
        return np.zeros((0, 7))
    return np.random.default_rng(rng.randrange(10**6)).standard_normal((rng.randrange(1, 40), rng.randrange(1, 5)))


def boundaries(raw):
    out, place = [], 0
    while place < len(raw):
        rows, cols = struct.unpack_from(">QQ", raw, place)
        out.append(place)
        place += 16 + 8 * rows * cols
    return out


@pytest.mark.parametrize("seed", range(6))
def test_chains_against_hopping(seed):
    rng = random.Random(seed)
    raw = b"".join(record(hostile(rng)) for _ in range(40))
    size = len(raw)

    def hop(place, until):
        n = 0
        while place < until:
            if place + 16 > size:
                return None
            rows, cols = struct.unpack_from(">QQ", raw, place)
            place, n = place + 16 + 8 * rows * cols, n + 1
            if place > size:
                return None
        return place, n

    for chunk in (64, 1024, 1 << 20):
        for lo in range(0, size, chunk):
            hi = min(lo + chunk, size)
            places, behind, many = stream_index.chains(raw[lo : hi + 8], lo, hi, size)
            got = dict(zip(places.tolist(), zip(behind.tolist(), many.tolist(), strict=True), strict=True))
            want = {p: hop(p, hi) for p in range(lo, hi, 8) if hop(p, hi)}
            assert got == want


def test_boundaries_in_parallel(spark, tmp_path, monkeypatch):
    """Record places of hostile files, found without a header read in the driver."""
    rng = random.Random(11)
    for k in range(3):
        (tmp_path / f"f{k}.mat").write_bytes(b"".join(record(hostile(rng)) for _ in range(120)))
    (tmp_path / "none.mat").write_bytes(b"")
    big = record(np.arange(30_000.0).reshape(10_000, 3))  # spans many ranges
    (tmp_path / "long.mat").write_bytes(record(np.ones((2, 2))) + big + record(np.ones((1, 1))))
    files = [e for e, _ in matstream.list_files(str(tmp_path))]
    monkeypatch.setattr(matstream, "hop", None)  # the driver's copy; tasks have their own
    found = stream_index.stream_boundaries(spark, files, 1024).collect()
    by_file = {}
    for r in found:
        by_file.setdefault(os.path.basename(r["path"]), []).append((r["place"], r["seq"]))
    for name, known in by_file.items():
        raw = (tmp_path / name).read_bytes()
        places = boundaries(raw)
        known.sort()
        assert known[-1] == (len(raw), len(places))
        first = {}
        for i, p in enumerate(places):
            first.setdefault(p // 1024, (p, i))
        assert known[:-1] == sorted(first.values()), name
    assert set(by_file) == {"f0.mat", "f1.mat", "f2.mat", "none.mat", "long.mat"}


@pytest.mark.parametrize("tail, match", [(b"\x00" * 7, "Truncated header"), (struct.pack(">QQd", 2, 2, 1.0), "Truncated payload"), (struct.pack(">QQ", 1 << 60, 8), "overflow|Truncated"), (struct.pack(">QQ", 1 << 62, 1 << 62), "overflow")])
def test_broken_streams_fail(spark, tmp_path, tail, match):
    (tmp_path / "a.mat").write_bytes(b"".join(record(np.ones((3, 3))) for _ in range(50)) + tail)
    with pytest.raises(Exception, match=match):
        streams.read_mat(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match=match + "|Broken"):
        stream_index.index_streams(spark, str(tmp_path), chunk=256).collect()


def matrices(spark, n=60, cols=3):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, i % 7 + 1, cols, rng.standard_normal((i % 7 + 1) * cols).tolist()) for i in range(n)], SCHEMA)


def read_back(df):
    return {r["matrix_id"]: (r["n_rows"], r["n_cols"], tuple(r["cells"])) for r in df.collect()}


def test_ranges_of_a_foreign_file(spark, tmp_path):
    """A file without an index is indexed once, outside of its folder, and cut into ranges."""
    rng = random.Random(2)
    mats = [hostile(rng) for _ in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.mat").write_bytes(b"".join(record(m) for m in mats))
    df = streams.read_mat(spark, str(folder), chunk_bytes=2048, split_min_bytes=1)
    assert df.rdd.getNumPartitions() > 10
    got = {r["seq"]: r for r in df.collect()}
    assert sorted(got) == list(range(300)) and df.count() == 300
    for i, m in enumerate(mats):
        assert (got[i]["n_rows"], got[i]["n_cols"]) == m.shape
        assert np.array(got[i]["cells"], ">f8").tobytes() == m.astype(">f8").tobytes()
    assert os.listdir(folder) == ["a.mat"]
    counts = streams.mat_counts(spark, str(folder)).collect()
    assert [(r["records"], r["indexed"]) for r in counts] == [(300, True)]
    # a file that has changed since is not read by its old index
    with open(folder / "a.mat", "ab") as out:
        out.write(record(np.ones((2, 2))))
    assert [(r["records"], r["indexed"]) for r in streams.mat_counts(spark, str(folder)).collect()] == [(301, False)]
    assert streams.read_mat(spark, str(folder), chunk_bytes=2048, split_min_bytes=1).count() == 301


def test_row_form_cuts_between_rows(spark, tmp_path):
    mats = [np.arange(12.0).reshape(4, 3), np.zeros((0, 5)), np.arange(50_000.0).reshape(10_000, 5), np.arange(300.0).reshape(300, 1)]
    (tmp_path / "a.mat").write_bytes(b"".join(record(m) for m in mats))
    df = streams.read_mat(spark, str(tmp_path), chunk_bytes=1000, split_min_bytes=1, form="rows")
    got = {}
    for r in df.collect():
        assert (r["seq"], r["r"]) not in got
        got[r["seq"], r["r"]] = r["x"]
    assert got == {(i, j): row.tolist() for i, m in enumerate(mats) for j, row in enumerate(m)}


def test_counts_read_no_payload(spark, tmp_path):
    """The index of a written stream tells its records: one row a file, whatever the payloads."""
    out = str(tmp_path / "out")
    df = matrices(spark)
    streams.write_mat(df, out, parts=3)
    counts = streams.mat_counts(spark, out)
    rows = counts.collect()
    assert len(rows) == 3 and sum(r["records"] for r in rows) == 60 and all(r["indexed"] for r in rows)
    folder = matstream.current_run(out)
    for r in rows:  # payloads that cannot be read as records any more; length and time as before
        now = os.stat(r["path"])
        with open(r["path"], "r+b") as fh:
            fh.write(b"\xff" * r["size"])
        os.utime(r["path"], ns=(now.st_atime_ns, now.st_mtime_ns))
    assert sum(r["records"] for r in streams.mat_counts(spark, out).collect()) == 60
    assert folder and "matstream" not in str(streams.with_stream_index(df.withColumn("path", F.lit("x")).withColumn("seq", F.lit(0)), counts.limit(0))._jdf.queryExecution().analyzed()).split("Join")[0]


def test_index_gives_global_positions(spark, tmp_path):
    out = str(tmp_path / "out")
    df = matrices(spark)
    streams.write_mat(df, out, parts=4)
    back = streams.with_stream_index(streams.read_mat(spark, out, chunk_bytes=256, split_min_bytes=1), streams.mat_counts(spark, out))
    assert read_back(back) == read_back(df)
    plain = streams.with_stream_index(streams.read_mat(spark, out))
    assert read_back(plain) == read_back(df)


def test_commit_cut_off_half_way(spark, tmp_path):
    """A commit that dies leaves the old output whole, before and after the parts are there."""
    out = str(tmp_path / "out")
    old, new = matrices(spark), matrices(spark, 20, 5)
    streams.write_mat(old, out, parts=3)
    writer = matstream.MatStreamWriter({"path": out}, True)
    messages = [writer.write(r.asDict() for r in new.collect())]
    assert read_back(streams.with_stream_index(streams.read_mat(spark, out))) == read_back(old)
    publish = storage.publish

    def dies(path, content):
        raise OSError("driver lost")

    storage.publish = dies
    try:
        with pytest.raises(OSError, match="lost"):
            writer.commit(messages)
    finally:
        storage.publish = publish
    assert read_back(streams.with_stream_index(streams.read_mat(spark, out))) == read_back(old)
    # the pointer is there, what it replaces is not gone yet
    remove = storage.remove_folder
    storage.remove_folder = dies_quietly = lambda path: (_ for _ in ()).throw(OSError("driver lost"))
    try:
        with pytest.raises(OSError, match="lost"):
            writer.commit(messages)
    finally:
        storage.remove_folder = remove
    assert dies_quietly is not remove
    assert read_back(streams.with_stream_index(streams.read_mat(spark, out))) == read_back(new)
    streams.write_mat(old, out, mode="overwrite", parts=2)
    assert read_back(streams.with_stream_index(streams.read_mat(spark, out))) == read_back(old)
    assert len(storage.folders(out)) == 1 and len(storage.names(out)) == 1


def test_attempts_that_were_not_committed(tmp_path):
    """What a lost task left in the run goes when the run is committed."""
    writer = matstream.MatStreamWriter({"path": str(tmp_path / "out")}, False)
    row = {"matrix_id": 0, "n_rows": 1, "n_cols": 1, "cells": [1.0]}
    message = writer.write([row])
    with storage.open_write(writer.folder + "/part-0000000-99.mat") as fh:
        fh.write(b"torn")
    writer.commit([message])
    assert sorted(storage.names(writer.folder)) == [os.path.basename(message.path), os.path.basename(message.path) + ".idx"]


def test_output_is_not_the_input(spark, tmp_path):
    out = str(tmp_path / "out")
    streams.write_mat(matrices(spark), out, parts=2)
    for source in (out, "file:" + out, out + "/*/*.mat"):
        again = streams.with_stream_index(streams.read_mat(spark, source))
        for path in (out, out + "/", "file://" + out):
            with pytest.raises(ValueError, match="same path"):
                streams.write_mat(again, path, mode="overwrite")
    text = str(tmp_path / "text")
    streams.write_txt(matrices(spark), text, parts=2)
    again = streams.with_stream_index(streams.read_txt(spark, text))
    with pytest.raises(ValueError, match="same path"):
        streams.write_txt(again, text, mode="overwrite")
    streams.write_txt(streams.with_stream_index(streams.read_mat(spark, out)), str(tmp_path / "other"))
    assert read_back(streams.with_stream_index(streams.read_txt(spark, str(tmp_path / "other")))) == read_back(matrices(spark))


def test_text_has_17_digits(spark, tmp_path):
    cells = [0.1, 1.0, 1e300, -2.5e-7, 123456789012345680.0, 1 / 3]
    out = str(tmp_path / "text")
    streams.write_txt(spark.createDataFrame([(0, 2, 3, cells)], SCHEMA), out, parts=1)
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert lines[:2] == [" ".join("%.17g" % c for c in row) for row in (cells[:3], cells[3:])]
    assert streams.read_txt(spark, out).first()["cells"] == cells


@pytest.mark.parametrize("token", ["1d", "2f", "1.0D", "0x1p3", "1_0", "--1", "1e", "e5", "."])
@pytest.mark.parametrize("whole", [False, True])
def test_text_numbers_have_no_suffix(spark, tmp_path, token, whole):
    (tmp_path / "a.txt").write_text(f"1 2\n3 {token}\n")
    with pytest.raises(Exception, match="bad token"):
        streams.read_txt(spark, str(tmp_path / "*.txt"), whole_files=whole).collect()


def test_stream_of_a_growing_file(spark, tmp_path):
    """Two batches: a file grows between them, its last record still cut off in the first."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()
    rng = random.Random(4)
    a, b = [hostile(rng) for _ in range(50)], [hostile(rng) for _ in range(30)]
    raw = b"".join(record(m) for m in a)
    last = record(np.arange(60.0).reshape(20, 3))
    cut = len(raw) + len(last) - 100
    whole = raw + last
    (folder / "a.mat").write_bytes(whole[:cut])
    stream = streaming.matrix_stream(spark, str(folder), chunk_bytes=512).select("path", "seq", "n_rows", "n_cols", "cells")
    first = streaming.run_to_table(stream, out, checkpoint)
    assert first.count() == 50
    (folder / "a.mat").write_bytes(whole)
    (folder / "b.mat").write_bytes(b"".join(record(m) for m in b))
    second = streaming.run_to_table(stream, out, checkpoint).collect()
    got = {(os.path.basename(r["path"]), r["seq"]): ((r["n_rows"], r["n_cols"]), np.array(r["cells"], ">f8").tobytes()) for r in second}
    assert len(got) == len(second) == 81
    want = {("a.mat", i): (m.shape, m.astype(">f8").tobytes()) for i, m in enumerate([*a, np.arange(60.0).reshape(20, 3)])}
    want |= {("b.mat", i): (m.shape, m.astype(">f8").tobytes()) for i, m in enumerate(b)}
    assert got == want
    assert streaming.run_to_table(stream, out, checkpoint).count() == 81  # nothing new


def test_stream_over_runs_of_the_sink(spark, tmp_path):
    """Files of the sink are taken by their index; the next run's files are new ones."""
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    streams.write_mat(matrices(spark), folder, parts=2)
    stream = streaming.matrix_stream(spark, folder)
    assert streaming.run_to_table(stream, out, checkpoint).count() == 60
    streams.write_mat(matrices(spark, 25), folder, mode="overwrite", parts=1)
    assert streaming.run_to_table(stream, out, checkpoint).count() == 85
    shrunk = str(tmp_path / "shrunk")
    os.mkdir(shrunk)
    reader = matstream.MatStreamStreamReader({"path": shrunk})
    assert reader.latestOffset() == {"files": {}}
    with open(shrunk + "/a.mat", "wb") as fh:
        fh.write(record(np.ones((4, 4))))
    assert reader.latestOffset() == {"files": {shrunk + "/a.mat": [144, 1]}}
    with open(shrunk + "/a.mat", "wb") as fh:
        fh.write(record(np.ones((1, 1))))
    with pytest.raises(ValueError, match="shrunk"):
        reader.latestOffset()


def test_ordered_emit_solves_once(spark, tmp_path):
    """The factors leave in order, and each matrix is solved once for it."""
    from orthoflow.operators import svd

    rng = np.random.default_rng(3)
    rows = [(int(i), m, n, rng.standard_normal(m * n).tolist()) for i, (m, n) in enumerate([(4, 2), (9, 3), (5, 5), (8, 2)] * 125)]
    table = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1))
    solved = spark.sparkContext.accumulator(0)
    cells = svd.ordered_factor_cells(table, counter=solved).collect()
    assert solved.value == 500
    keys = [(r["matrix_id"], r["part_order"], r["r"], r["c"]) for r in cells]
    assert keys == sorted(keys) and len(set(k[0] for k in keys)) == 500
    for text in (False, True):
        out = str(tmp_path / f"out{text}")
        streams.write_factors(table, out, parts=3, text=text)
        if text:
            back = sorted((r["path"], r["seq"], r["cells"]) for r in streams.read_txt(spark, out).collect())
        else:
            back = sorted((r["path"], r["seq"], r["cells"]) for r in streams.read_mat(spark, out).collect())
        assert len(back) == 1500
        for i, (_, m, n, a) in enumerate(rows):
            s = np.sort(back[3 * i + 1][2])[::-1]
            assert len(back[3 * i][2]) == m * n and len(back[3 * i + 2][2]) == n * n
            assert np.allclose(s, np.linalg.svd(np.array(a).reshape(m, n), compute_uv=False))


def test_positions_in_order(spark):
    from orthoflow.operators import forms

    ids = [int(x) for x in np.random.default_rng(5).permutation(3000) * 7]
    table = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r["id"]: r["pos"] for r in forms.with_position(table, "id").collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
