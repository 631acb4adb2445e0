"""Record boundaries of matrix streams without an index, found in parallel.

A stream has no sync marks: where a record begins follows only from the headers before it. So every
range of a file first answers, for all places at which a record could begin (all multiples of 8),
where the chain of headers from there leaves the range. Chains run together, so few different places
come out. These, and byte 0, are the only entries that a range need answer for; each is an edge from
an entry to the place where its chain leaves the range. The edges on the way from byte 0 are found by
pointer doubling. No header is read in the driver, no file by one task, and payloads that look like
headers only add edges that the way from byte 0 does not take.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoflow.session import scratch_dir
from orthoflow.sources import matstream, storage

_FILES = "path string, size bigint, time bigint"
_RANGES = _FILES + ", lo bigint"


def chains(raw: bytes, lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, where the chain from there leaves the range, records until then) for the places of a
    range whose chain does leave it; ``raw`` holds the bytes from ``lo`` to ``hi`` + 8."""
    words = np.frombuffer(raw[: len(raw) // 8 * 8], ">u8").astype(np.uint64)
    slots = min((hi - lo + 7) // 8, max(len(words) - 1, 0))
    rows, cols = words[:slots], words[1 : slots + 1]
    fits = (cols == 0) | (rows <= np.uint64(size // 8) // np.maximum(cols, np.uint64(1)))
    at = np.flatnonzero(fits)
    behind = lo + 8 * at + 16 + 8 * (rows[at] * cols[at]).astype(np.int64)
    keep = behind <= size
    at, behind = at[keep], behind[keep]
    place = lo + 8 * at
    nth = np.full(slots, -1, np.int64)
    nth[at] = np.arange(len(at))
    many = np.ones(len(at), np.int64)
    # pointer doubling inside the range; -1: the chain meets no record
    end = min(hi, size)
    nth = np.append(nth, -1)  # a place too near to the end of the file for a header
    follow = np.where(behind < end, nth[np.minimum((behind - lo) // 8, slots)], -2)
    while (follow >= 0).any():
        go = np.flatnonzero(follow >= 0)
        next_ = follow[go]
        many[go] += many[next_]
        behind[go] = behind[next_]
        follow[go] = follow[next_]
    whole = follow == -2
    return place[whole], behind[whole], many[whole]


def _range_bytes(path: str, lo: int, hi: int) -> bytes:
    with storage.open_read(path) as fh:
        fh.seek(lo)
        return fh.read(hi + 8 - lo)


def _exits(chunk: int):
    """Of each range, the places inside the file at which chains leave it."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                hi = min(r["lo"] + chunk, r["size"])
                _, behind, _ = chains(_range_bytes(r["path"], r["lo"], hi), r["lo"], hi, r["size"])
                out = np.unique(behind[behind < r["size"]])
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(out), pa.string()), pa.array(out, pa.int64())], ["path", "entry"])

    return run


def _edges(chunk: int):
    """Of each range (path, size, lo, entries), the edge from each entry; without a way out, what is
    wrong at the end of its chain."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lo, size = r["lo"], r["size"]
                hi = min(lo + chunk, size)
                entries = np.array(sorted(r["entries"]), np.int64)
                behind = np.full(len(entries), -1, np.int64)
                many = np.zeros(len(entries), np.int64)
                wrong: list[str | None] = [None] * len(entries)
                if len(entries) > 64:  # few chains are followed by their headers alone
                    places, ends, counts = chains(_range_bytes(r["path"], lo, hi), lo, hi, size)
                    i = np.searchsorted(places, entries)
                    hit = (i < len(places)) & (places[np.minimum(i, max(len(places) - 1, 0))] == entries) if len(places) else np.zeros(len(entries), bool)
                    behind[hit], many[hit] = ends[i[hit]], counts[i[hit]]
                with storage.open_read(r["path"]) as fh:
                    for k in np.flatnonzero(behind < 0).tolist() if len(entries) <= 64 else []:
                        behind[k], many[k], wrong[k] = _follow(fh, r["path"], size, int(entries[k]), hi)
                n = len(entries)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * n, pa.string()), pa.array([size] * n, pa.int64()), pa.array(entries), pa.array(behind), pa.array(many), pa.array(wrong, pa.string())],
                    ["path", "size", "entry", "behind", "many", "wrong"],
                )

    return run


def _follow(fh, path: str, size: int, place: int, until: int) -> tuple[int, int, str | None]:
    """(place behind, records, what is wrong) of the chain from a place."""
    many, behind = 0, place
    try:
        for _, _, _, _, behind in matstream.hop(fh, path, size, 0, place, until):
            many += 1
    except ValueError as wrong:
        return -1, many, str(wrong)
    return behind, many, None


def stream_boundaries(spark: SparkSession, files: list[storage.Entry], chunk: int = matstream.GRANULE_BYTES) -> DataFrame:
    """path, size, time, seq, place: the first record that begins in each range of ``chunk`` bytes, and
    last of each file the number of its records at its end. A broken stream fails the job."""
    if chunk % 8:
        raise ValueError("ranges are cut at multiples of 8 bytes")
    work = scratch_dir(spark, f"stream-index-{uuid.uuid4().hex[:8]}")
    counter = iter(range(1 << 30))

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{work}/{name}-{next(counter)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    listed = spark.createDataFrame([(f.path, f.size, f.time) for f in files], _FILES)
    ranges = listed.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(chunk))).alias("lo"))
    ranges = keep(ranges.repartition("path", "lo"), "ranges")
    entries = ranges.mapInArrow(_exits(chunk), "path string, entry bigint").unionByName(
        listed.filter("size > 0").select("path", F.lit(0).cast("bigint").alias("entry"))).distinct()
    entries = entries.withColumn("lo", F.col("entry") - F.col("entry") % chunk)
    asked = ranges.join(entries.groupBy("path", "lo").agg(F.collect_list("entry").alias("entries")), ["path", "lo"])
    edges = keep(asked.select("path", "size", "lo", "entries").mapInArrow(
        _edges(chunk), "path string, size bigint, entry bigint, behind bigint, many bigint, wrong string"), "edges")

    # jump: from an entry 2^k edges on; reached: entries within 2^k edges of byte 0, and their record number
    jump = edges.filter("behind >= 0 and behind < size").select("path", "entry", "behind", "many")
    steps = [jump]
    longest = ranges.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    while 2 ** len(steps) < longest + 1:
        a, b = steps[-1].alias("a"), steps[-1].alias("b")
        twice = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.behind") == F.col("b.entry")))
        steps.append(keep(twice.select("a.path", "a.entry", "b.behind", (F.col("a.many") + F.col("b.many")).alias("many")), "jump"))
    reached = listed.filter("size > 0").select("path", F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("seq"))
    for step in reversed(steps):
        on = reached.join(step, ["path", "entry"]).select("path", F.col("behind").alias("entry"), (F.col("seq") + F.col("many")).alias("seq"))
        reached = keep(reached.unionByName(on), "reached")
    way = keep(reached.join(edges, ["path", "entry"]).join(listed.select("path", "time"), "path"), "way")
    broken = F.when(F.col("behind") < 0, F.raise_error(F.coalesce("wrong", F.concat(F.lit("Broken record chain in "), "path", F.lit(" from byte "), F.col("entry").cast("string")))))
    checked = way.select("path", "size", "time", F.coalesce(broken.cast("bigint"), "seq").alias("seq"), F.col("entry").alias("place"), "behind", "many")
    starts = checked.select("path", "size", "time", "seq", "place")
    ends = checked.filter("behind = size").select("path", "size", "time", (F.col("seq") + F.col("many")).alias("seq"), F.col("size").alias("place"))
    empty = listed.filter("size = 0").select("path", "size", "time", F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("place"))
    return starts.unionByName(ends).unionByName(empty)


def _write_sidecars(index_dir: str | None):
    """Files with their boundaries to sidecars: beside the file, or in a folder for sidecars."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                known = sorted((b["place"], b["seq"]) for b in r["known"])
                index = matstream.StreamIndex(r["size"], r["time"], known[-1][1], np.array([k[1] for k in known[:-1]], np.int64), np.array([k[0] for k in known[:-1]], np.int64))
                at = storage.join(index_dir, matstream.apart_name(r["path"])) if index_dir else r["path"] + matstream.INDEX_SUFFIX
                storage.publish(at, index.to_bytes())
                done.append((r["path"], index.records))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return run


def index_streams(spark: SparkSession, path: str, suffix: str = ".mat", chunk: int = matstream.GRANULE_BYTES, min_bytes: int = 0, index_dir: str | None = None) -> DataFrame:
    """path, records of the files of a path that have no sidecar of their present state; the sidecars
    are written beside them, or to ``index_dir`` where their folder is not to be written to.

    A sidecar holds one entry per range of its file, and is put together by one task.
    """
    if index_dir:
        storage.make_folder(index_dir)
    listed = matstream.list_files(path, suffix, index_dir)
    files = [e for e, indexed in listed if e.size >= min_bytes and not (indexed and matstream.index_fits(e, index_dir))]
    schema = "path string, records bigint"
    if not files:
        return spark.createDataFrame([], schema)
    found = stream_boundaries(spark, files, chunk)
    # an empty file has one boundary, its end, as any other file has at its end
    by_file = found.groupBy("path", "size", "time").agg(F.collect_list(F.struct("place", "seq")).alias("known"))
    done = scratch_dir(spark, "stream-index-done")
    by_file.mapInArrow(_write_sidecars(index_dir), schema).write.parquet(done)
    return spark.read.schema(schema).parquet(done)
