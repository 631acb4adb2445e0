"""Binary matrix streams as a Spark data source: ``spark.read.format("matstream")``.

A stream is records back to back: 16-byte header (rows, columns as big-endian u64) then
rows*columns big-endian IEEE doubles, row-major. EOF exactly at a record boundary ends a
stream; anything else is a truncated header or payload.

Index: the format has no sync marks, so a file is cut only with the help of a sidecar
(``<file>.idx``): its length and change time, the number of records and, about every
``granule`` bytes, the number and place of a record. The sink writes it; ``stream_index`` builds
it for files from elsewhere, in parallel. A sidecar that does not fit its file is not used.

Reading: a file with a sidecar, of at least ``splitMinBytes``, is dealt out in byte ranges of
``chunkBytes``. The planner opens no file: a task looks up the record at which its range begins.
Other files are one partition. Truncation is found where it is read.

Writing: each task writes one part file of the rows it holds, in the order it holds them, and its
sidecar; sort by the order column and range-partition first, so the parts in name order are one
ordered stream. The parts of a write lie in a folder of their own, ``run-<id>``; the pointer
``_current.<generation>``, published last, names it, and readers follow the pointer of the highest
generation. Until then they see the old output whole.

Streaming: offsets hold, per file, the byte and the record up to which it has been read; a file may
grow between batches, records not yet whole are left for a later one.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from orthoflow.sources import storage

# Fixed values of the format.
HEADER_BYTES = 16
HEADER = struct.Struct(">QQ")
MAX_ELEMENTS = (1 << 63) // 8

DEFAULT_CHUNK_BYTES = 32 << 20
DEFAULT_SPLIT_MIN_BYTES = 64 << 20
GRANULE_BYTES = 4 << 20
# Payload bytes gathered for one Arrow batch.
BATCH_BYTES = 16 << 20
INDEX_SUFFIX = ".idx"
POINTER = "_current."
#: files whose counts one task looks up
COUNT_FILES = 32

SCHEMA = "path string, seq bigint, n_rows bigint, n_cols bigint, cells array<double>"
ROWS_SCHEMA = "path string, seq bigint, n_rows bigint, n_cols bigint, r bigint, x array<double>"
COUNT_SCHEMA = "path string, size bigint, records bigint, indexed boolean"
_SCHEMAS = {"packed": SCHEMA, "rows": ROWS_SCHEMA, "counts": COUNT_SCHEMA}


def form_of(options) -> str:
    """``packed`` (a record is a row), ``rows`` (a matrix row is a row, for records of any size) or
    ``counts`` (a file is a row; no payload is read)."""
    form = options.get("form", "packed")
    if form not in _SCHEMAS:
        raise ValueError(f"unknown form of matrix stream: {form}")
    return form


# --- files and runs ------------------------------------------------------------------------


def current_run(folder: str) -> str | None:
    """Folder of the newest committed run, None where the folder was not written by the sink."""
    pointers = [n for n in storage.names(folder) if n.startswith(POINTER)]
    if not pointers:
        return None
    newest = max(pointers, key=lambda n: int(n[len(POINTER) :]))
    content = storage.read_small(storage.join(folder, newest))
    if content is None:  # replaced while we looked
        return current_run(folder)
    return storage.join(folder, content.decode().strip())


def list_files(path: str, suffix: str = ".mat", index_dir: str | None = None) -> list[tuple[storage.Entry, bool]]:
    """(file, has a sidecar) of a path: a file, a folder (the files of its newest run, else all
    ``*suffix`` below it) or a glob. A path that is not there, or a glob that matches nothing, is an
    error."""
    if storage.has_wildcard(path):
        found = storage.expand(path)
        if not found:
            raise FileNotFoundError(f"no matrix stream matches {path}")
        found = [e for e in found if not e.path.endswith(INDEX_SUFFIX)]
        beside = {e.path for e in found if storage.stat(e.path + INDEX_SUFFIX)}
    elif storage.is_folder(path):
        every = storage.walk(current_run(path) or path)
        found = [e for e in every if e.path.endswith(suffix)]
        beside = {e.path[: -len(INDEX_SUFFIX)] for e in every if e.path.endswith(suffix + INDEX_SUFFIX)}
    else:
        one = storage.stat(path)
        if one is None:
            raise FileNotFoundError(f"matrix stream not found: {path}")
        found = [one]
        beside = {path} if storage.stat(path + INDEX_SUFFIX) else set()
    apart = set(storage.names(index_dir)) if index_dir else set()
    return [(e, e.path in beside or apart_name(e.path) in apart) for e in found]


def apart_name(path: str) -> str:
    """Name of a file's sidecar in a folder for sidecars."""
    return hashlib.sha256(path.encode()).hexdigest()[:32] + INDEX_SUFFIX


# --- index ---------------------------------------------------------------------------------


@dataclass
class StreamIndex:
    """Records of a file, and the number and place of some of them, ascending."""

    size: int
    time: int
    records: int
    seqs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    _HEAD = struct.Struct(">6sQqQQ")
    _MAGIC = b"MSIX1\n"

    def to_bytes(self) -> bytes:
        pairs = np.column_stack([self.seqs, self.places]).astype(">i8")
        return self._HEAD.pack(self._MAGIC, self.size, self.time, self.records, len(pairs)) + pairs.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | None) -> StreamIndex | None:
        """None for anything that is not a whole sidecar."""
        if raw is None or len(raw) < cls._HEAD.size or not raw.startswith(cls._MAGIC):
            return None
        _, size, time, records, many = cls._HEAD.unpack_from(raw)
        if len(raw) != cls._HEAD.size + 16 * many:
            return None
        pairs = np.frombuffer(raw, ">i8", offset=cls._HEAD.size).reshape(-1, 2).astype(np.int64)
        return cls(size, time, records, pairs[:, 0], pairs[:, 1])

    def before(self, byte: int) -> tuple[int, int]:
        """(record, place) of the last known record that begins at the byte or before it."""
        i = bisect_right(self.places, byte) - 1
        return (int(self.seqs[i]), int(self.places[i])) if i >= 0 else (0, 0)


def load_index(entry: storage.Entry, index_dir: str | None = None) -> StreamIndex | None:
    """A file's sidecar, if it is there and of the file as it is now."""
    for at in (entry.path + INDEX_SUFFIX, storage.join(index_dir, apart_name(entry.path)) if index_dir else None):
        found = StreamIndex.from_bytes(storage.read_small(at)) if at else None
        if found and (found.size, found.time) == (entry.size, entry.time):
            return found
    return None


def index_fits(entry: storage.Entry, index_dir: str | None = None) -> bool:
    """Whether a sidecar is of the file as it is now, by its head alone."""
    head = StreamIndex._HEAD
    for at in (entry.path + INDEX_SUFFIX, storage.join(index_dir, apart_name(entry.path)) if index_dir else None):
        if at and storage.stat(at):
            with storage.open_read(at) as fh:
                raw = fh.read(head.size)
            if len(raw) == head.size and head.unpack(raw)[:3] == (StreamIndex._MAGIC, entry.size, entry.time):
                return True
    return False


def check_header(rows: int, cols: int, path: str, place: int) -> int:
    """Payload bytes of a record."""
    if cols and rows > MAX_ELEMENTS // cols:
        raise ValueError(f"Element count overflow in {path} at byte {place}")
    return rows * cols * 8


def hop(fh, path: str, size: int, seq: int, place: int, until: int):
    """(seq, place, rows, cols, place behind) of the records that begin before ``until``, by their
    headers alone."""
    while place < min(until, size):
        fh.seek(place)
        raw = fh.read(HEADER_BYTES)
        if len(raw) < HEADER_BYTES:
            raise ValueError(f"Truncated header in {path} at byte {place}")
        rows, cols = HEADER.unpack(raw)
        behind = place + HEADER_BYTES + check_header(rows, cols, path, place)
        if behind > size:
            raise ValueError(f"Truncated payload in {path} at byte {place}")
        yield seq, place, rows, cols, behind
        seq, place = seq + 1, behind


# --- batch reader --------------------------------------------------------------------------


@dataclass
class MatRange(InputPartition):
    """Records (in row form: rows) that begin from byte ``start`` to ``end`` of a file of ``size``
    bytes; record ``seq`` begins at byte ``known``."""

    entry: storage.Entry
    start: int
    end: int
    seq: int = 0
    known: int = 0


@dataclass
class CountFiles(InputPartition):
    entries: list[storage.Entry]


def cut(entry: storage.Entry, chunk: int, start: int = 0, end: int | None = None, seq: int = 0) -> list[MatRange]:
    """Byte ranges of a file from a known record on."""
    end = entry.size if end is None else end
    return [MatRange(entry, lo, min(lo + chunk, end), seq, start) for lo in range(start, end, chunk)]


def read_records(p: MatRange, form: str, index_dir: str | None = None):
    """(seq, rows, columns, cells, first row) of a range's records, or in row form blocks of rows."""
    entry = p.entry
    with storage.open_read(entry.path) as fh:
        seq, place = p.seq, p.known
        if p.start > p.known:
            found = load_index(entry, index_dir)
            if found:
                seq, place = max((seq, place), found.before(p.start))
        for seq, place, rows, cols, behind in hop(fh, entry.path, entry.size, seq, place, p.end):
            body = place + HEADER_BYTES
            if form == "packed":
                if place < p.start:
                    continue
                first, last, step = 0, rows, max(rows, 1)
            else:
                if behind <= p.start or not rows * cols:
                    continue
                width = cols * 8
                first = max(0, -(-(p.start - body) // width))
                last = min(rows, max(0, -(-(p.end - body) // width))) if behind > p.end else rows
                step = max(1, BATCH_BYTES // width)
            for r in range(first, last, step) or ([0] if form == "packed" else []):
                count = (min(r + step, last) - r) * cols
                fh.seek(body + r * cols * 8)
                payload = fh.read(count * 8)
                if len(payload) < count * 8:
                    raise ValueError(f"Truncated payload in {entry.path} at byte {place}")
                yield seq, rows, cols, np.frombuffer(payload, dtype=">f8").astype(np.float64), r


def read_batches(p: MatRange, form: str, index_dir: str | None = None):
    """Arrow batches of a range."""
    import pyarrow as pa

    make = _rows_batch if form == "rows" else _to_batch
    held, size = [], 0
    for rec in read_records(p, form, index_dir):
        held.append(rec)
        size += rec[3].nbytes
        if size >= BATCH_BYTES:
            yield make(p.entry.path, held, pa)
            held, size = [], 0
    if held:
        yield make(p.entry.path, held, pa)


def count_records(entry: storage.Entry, index_dir: str | None = None) -> tuple[int, bool]:
    """(records of a file, told by its sidecar): else by hopping over its headers."""
    found = load_index(entry, index_dir)
    if found:
        return found.records, True
    with storage.open_read(entry.path) as fh:
        return sum(1 for _ in hop(fh, entry.path, entry.size, 0, 0, entry.size)), False


class MatStreamReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.form = form_of(options)
        # a whole number of doubles, so that rows of one column are not cut
        self.chunk = max(8, int(options.get("chunkBytes", DEFAULT_CHUNK_BYTES)) // 8 * 8)
        self.split_min = int(options.get("splitMinBytes", DEFAULT_SPLIT_MIN_BYTES))
        self.suffix = options.get("suffix", ".mat")
        self.index_dir = options.get("indexDir")

    def partitions(self):
        files = list_files(self.path, self.suffix, self.index_dir)
        if self.form == "counts":
            entries = [e for e, _ in files]
            return [CountFiles(entries[i : i + COUNT_FILES]) for i in range(0, len(entries), COUNT_FILES)] or [CountFiles([])]
        parts: list[MatRange] = []
        for entry, indexed in files:
            if indexed and entry.size >= self.split_min:
                parts += cut(entry, self.chunk)
            elif entry.size:
                parts.append(MatRange(entry, 0, entry.size))
        return parts or [CountFiles([])]

    def read(self, partition):
        import pyarrow as pa

        if isinstance(partition, CountFiles):
            if partition.entries:
                counts = [count_records(e, self.index_dir) for e in partition.entries]
                columns = [[e.path for e in partition.entries], [e.size for e in partition.entries], [c[0] for c in counts], [c[1] for c in counts]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "size", "records", "indexed"])
            return
        yield from read_batches(partition, self.form, self.index_dir)


def _lists(blocks, lengths, pa):
    """A list column whose offsets cannot wrap: a batch holds BATCH_BYTES and one record more."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))])
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a record of 2^31 elements and more is no packed row; read it with option form=rows")
    values = np.concatenate(blocks) if blocks else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=pa.float64()))


def _to_batch(path, recs, pa):
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(recs), type=pa.string()), *[pa.array([r[i] for r in recs], type=pa.int64()) for i in range(3)],
         _lists([r[3] for r in recs], [len(r[3]) for r in recs], pa)],
        names=["path", "seq", "n_rows", "n_cols", "cells"])


def _rows_batch(path, recs, pa):
    many = np.array([len(r[3]) // r[2] if r[2] else 0 for r in recs])
    keys = [np.repeat(np.array([r[i] for r in recs], dtype=np.int64), many) for i in range(3)]
    nth = np.concatenate([r[4] + np.arange(k) for r, k in zip(recs, many)]) if recs else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * int(many.sum()), type=pa.string()), *[pa.array(k) for k in keys], pa.array(nth.astype(np.int64)),
         _lists([r[3] for r in recs], keys[2], pa)],
        names=["path", "seq", "n_rows", "n_cols", "r", "x"])


# --- streaming reader ----------------------------------------------------------------------


class MatStreamStreamReader(DataSourceStreamReader):
    """Records as they land. An offset is {"files": {path: [byte, record]}}, the byte always that of a
    record boundary: of a file with a sidecar its end, of another (which may still grow) the end of its
    last whole record, found by hopping over the headers that are new. Files are taken as they are
    under the path; a folder of the sink shows the run that is current, and a later run adds its
    files. A file that shrinks below what was read is an error."""

    def __init__(self, options):
        self.path = options.get("path")
        self.form = form_of(options)
        if self.form == "counts":
            raise ValueError("counts are not read as a stream")
        self.chunk = max(8, int(options.get("chunkBytes", DEFAULT_CHUNK_BYTES)) // 8 * 8)
        self.suffix = options.get("suffix", ".mat")
        self.index_dir = options.get("indexDir")
        self.reached: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _files(self) -> list[tuple[storage.Entry, bool]]:
        try:
            return list_files(self.path, self.suffix, self.index_dir)
        except FileNotFoundError:
            return []  # nothing has landed yet

    def latestOffset(self) -> dict:
        for entry, indexed in self._files():
            place, seq = self.reached.get(entry.path, [0, 0])
            if entry.size < place:
                raise ValueError(f"{entry.path} has shrunk from {place} bytes read to {entry.size}")
            found = load_index(entry, self.index_dir) if indexed else None
            if found:
                self.reached[entry.path] = [entry.size, found.records]
            elif entry.size > place:
                self.reached[entry.path] = self._whole(entry, place, seq)
        return {"files": {k: list(v) for k, v in sorted(self.reached.items()) if v[0]}}

    @staticmethod
    def _whole(entry: storage.Entry, place: int, seq: int) -> list[int]:
        """Behind the last whole record of a file that may be growing."""
        with storage.open_read(entry.path) as fh:
            while place + HEADER_BYTES <= entry.size:
                fh.seek(place)
                rows, cols = HEADER.unpack(fh.read(HEADER_BYTES))
                behind = place + HEADER_BYTES + check_header(rows, cols, entry.path, place)
                if behind > entry.size:
                    break
                place, seq = behind, seq + 1
        return [place, seq]

    def partitions(self, start: dict, end: dict):
        before = start["files"]
        # after a restart the stream goes on from the offset of its log
        self.reached = {**{k: list(v) for k, v in end["files"].items()}, **self.reached}
        parts = []
        for path, (place, _) in sorted(end["files"].items()):
            first, seq = before.get(path, [0, 0])
            if place > first:
                now = storage.stat(path)
                if now is None:
                    raise FileNotFoundError(f"{path} is gone; the batch up to byte {place} cannot be read")
                # the time must be the file's own: a sidecar is held against it
                entry = storage.Entry(path, place, now.time)
                parts += cut(entry, self.chunk, first, place, seq)
        return parts or [CountFiles([])]

    def read(self, partition):
        if isinstance(partition, MatRange):
            yield from read_batches(partition, self.form, self.index_dir)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


# --- writer --------------------------------------------------------------------------------


@dataclass
class PartWritten(WriterCommitMessage):
    path: str
    records: int


class IndexMaker:
    """Sidecar of a file while it is written."""

    def __init__(self, granule: int = GRANULE_BYTES):
        self.granule, self.place, self.records = granule, 0, 0
        self.known: list[tuple[int, int]] = []

    def add(self, size: int) -> None:
        if not self.known or self.place >= self.known[-1][1] + self.granule:
            self.known.append((self.records, self.place))
        self.place += size
        self.records += 1

    def write(self, path: str) -> None:
        entry = storage.stat(path)
        if entry.size != self.place:
            raise ValueError(f"{path} holds {entry.size} bytes of {self.place} written")
        pairs = np.array(self.known, np.int64).reshape(-1, 2)
        made = StreamIndex(entry.size, entry.time, self.records, pairs[:, 0], pairs[:, 1])
        storage.publish(path + INDEX_SUFFIX, made.to_bytes())


class MatStreamWriter(DataSourceWriter):
    """Parts of a run lie in its folder; the pointer to it is published when all of them are there.
    Attempts write under names of their own, and the committed ones are listed in the run."""

    def __init__(self, options, overwrite: bool):
        import uuid

        self.path = options.get("path")
        self.suffix = options.get("suffix", ".mat")
        self.granule = int(options.get("granuleBytes", GRANULE_BYTES))
        if storage.anything_in(self.path) and not overwrite and not empty_folder(self.path):
            raise FileExistsError(f"output already exists: {self.path} (use mode('overwrite'))")
        self.run = f"run-{uuid.uuid4().hex[:12]}"
        self.folder = storage.join(self.path, self.run)
        storage.make_folder(self.folder)

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part, attempt = (ctx.partitionId(), ctx.taskAttemptId()) if ctx else (0, 0)
        target = storage.join(self.folder, f"part-{part:07d}-{attempt}{self.suffix}")
        index = IndexMaker(self.granule)
        with storage.open_write(target) as out:
            for row in iterator:
                cells = np.asarray(row["cells"], dtype=">f8")
                if len(cells) != row["n_rows"] * row["n_cols"]:
                    raise ValueError(f"size mismatch in testcase {row['matrix_id']}")
                out.write(HEADER.pack(int(row["n_rows"]), int(row["n_cols"])))
                out.write(cells.tobytes())
                index.add(HEADER_BYTES + cells.nbytes)
        index.write(target)
        return PartWritten(target, index.records)

    def commit(self, messages):
        kept = {m.path.rsplit("/", 1)[-1] for m in messages if m is not None}
        for name in storage.names(self.folder):  # attempts that were not committed
            if name not in kept and name.removesuffix(INDEX_SUFFIX) not in kept:
                storage.remove_file(storage.join(self.folder, name))
        pointers = [n for n in storage.names(self.path) if n.startswith(POINTER)]
        generation = max((int(n[len(POINTER) :]) for n in pointers), default=0) + 1
        storage.publish(storage.join(self.path, f"{POINTER}{generation:010d}"), self.run.encode())
        # from here on readers see the new run; what it replaces can go
        for name in pointers:
            storage.remove_file(storage.join(self.path, name))
        for name in storage.folders(self.path):
            if name.startswith("run-") and name != self.run:
                storage.remove_folder(storage.join(self.path, name))
        for name in storage.names(self.path):  # output of a sink without runs
            if name.startswith("part-"):
                storage.remove_file(storage.join(self.path, name))

    def abort(self, messages):
        storage.remove_folder(self.folder)


def empty_folder(path: str) -> bool:
    """A folder without committed output: runs that no pointer names were never finished."""
    if not storage.is_folder(path):
        return False
    return not storage.names(path) and all(n.startswith("run-") for n in storage.folders(path))


class MatStreamSource(DataSource):
    @classmethod
    def name(cls):
        return "matstream"

    def schema(self):
        return _SCHEMAS[form_of(self.options)]

    def reader(self, schema):
        return MatStreamReader(self.options)

    def streamReader(self, schema):
        return MatStreamStreamReader(self.options)

    def writer(self, schema, overwrite):
        return MatStreamWriter(self.options, overwrite)


def register(spark) -> None:
    from orthoflow.session import ship_package

    ship_package(spark)
    spark.dataSource.register(MatStreamSource)
