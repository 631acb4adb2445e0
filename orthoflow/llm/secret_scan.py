"""Secret scans (operator 7): patterns per document, ownership frequency over the corpus.

Method: a scan finds credentials by pattern and, besides, long mixed tokens of high entropy. The
hash of each candidate's value is then counted over the whole corpus by distinct repositories and
owners. A value seen with many owners, or with more than one in many repositories, is a copied
example; a live-looking value of few owners, or of one however many repositories that one has, is a
credential of its owner and becomes a span of kind ``live`` even where no pattern names it.
Values leave the tasks only as hashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import LOWER, prepare, slices, small, stage, string_buffer

#: Fixed patterns; the third field is the least length, of group 2 for assignments.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so short ones need not be matched first
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "live")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_ALPHA = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_TOKEN = _DIGIT | _ALPHA | np.isin(_B, list(b"+/_-"))
_HEXES = _DIGIT | ((_B >= 97) & (_B <= 102))

FOUND = "n_assign long, n_access long, n_hex long, base array<struct<kind:string,start:int,end:int,key:binary>>, extra array<struct<kind:string,start:int,end:int,key:binary>>"


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base patterns, in order of start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _runs(mask: np.ndarray, least: int, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of ``least`` or more true bytes; a run ends at each border of two rows."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    first[border] = mask[border]
    last[border - 1] = mask[border - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= least
    return start[long], end[long]


def _key(value: str) -> bytes:
    return hashlib.sha256(value.encode()).digest()[:16]


def scan_rows(buf: np.ndarray, offsets: np.ndarray, min_token: int, min_entropy: float) -> tuple[list[list], list[list]]:
    """Base spans and extra candidates of each row; rows without any trace are never decoded."""
    rows = len(offsets) - 1
    flagged: set[int] = set()
    row_at = lambda at: np.searchsorted(offsets, at, side="right") - 1
    low = LOWER[buf].tobytes()
    for word, hay in [(k, low) for k in KEYWORDS] + [(b"AKIA", buf.tobytes())]:
        at = hay.find(word)
        while at >= 0:
            flagged.add(row := int(row_at(at)))
            at = hay.find(word, int(offsets[row + 1]))  # on with the next row
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(buf))]
    starts, _ = _runs(_HEXES[buf], LEAST["hex"], border)
    flagged.update(row_at(starts).tolist())
    begin, end = _runs(_TOKEN[buf], min_token, border)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf], dtype=np.int64)))
    mixed = digits[end] > digits[begin]
    candidates = set(row_at(begin[mixed]).tolist())
    found: list[list] = [[] for _ in range(rows)]
    extra: list[list] = [[] for _ in range(rows)]
    pattern = re.compile(rf"[A-Za-z0-9+/_-]{{{min_token},}}")
    for r in sorted(flagged | candidates):
        text = buf[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
        base = base_spans(text) if r in flagged else []
        found[r] = [{"kind": KINDS[k], "start": s, "end": e, "key": _key(v)} for s, k, e, v in base]
        if r in candidates:
            for m in pattern.finditer(text):
                value = m[0]
                if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= min_entropy and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
                    extra[r].append({"kind": "live", "start": m.start(), "end": m.end(), "key": _key(value)})
    return found, extra


def _scanner(text: str, min_token: int, min_entropy: float):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.binary())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = string_buffer(batch.column(text))
            at = batch.schema.names.index(text)
            for lo, hi in slices(offsets):
                base = int(offsets[lo])
                found, extra = scan_rows(data[base : int(offsets[hi])], offsets[lo : hi + 1] - base, min_token, min_entropy)
                counts = [pa.array([sum(s["kind"] == k for s in f) for f in found], pa.int64()) for k in KINDS[:3]]
                part = batch.slice(lo, hi - lo)
                kept = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, *counts, pa.array(found, span), pa.array(extra, span)], [*names, "n_assign", "n_access", "n_hex", "base", "extra"])

    return scan


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source", repository: Column | str | None = None,
    min_token: int = 20, min_entropy: float = 3.5, copied_owners: int = 3, copied_repositories: int = 5,
) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base (spans found by pattern),
    spans (those and the ``live`` ones), n_copied (candidates whose value has ``copied_owners``
    owners or more, or two and more in ``copied_repositories`` repositories or more) and n_live (other
    candidates).

    A candidate is the value of a pattern, or a token of ``min_token`` characters and more, with
    letters and digits, of at least ``min_entropy`` bits a character, outside the patterns. Null
    and empty texts have no spans. A null owner or repository is one of its own. Repeated rows
    are reported each; they count once as owners. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    owner_col = F.col(owner) if isinstance(owner, str) else owner
    repo_col = owner_col if repository is None else F.col(repository) if isinstance(repository, str) else repository
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(owner_col).alias("owner"), F.xxhash64(repo_col).alias("repository"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    scanned = rows.mapInArrow(_scanner("text", min_token, min_entropy), f"doc_id {id_type}, owner long, repository long, {FOUND}")
    scanned = stage(scanned.withColumn("row", F.monotonically_increasing_id()), "secrets")
    both = scanned.filter("size(base) + size(extra) > 0").select("row", "owner", "repository", F.explode(F.concat("base", "extra")).alias("span"))
    # how many repositories and owners hold each value: two partial distinct counts, hot values included
    held = both.select(F.col("span.key").alias("key"), "owner", "repository").groupBy("key").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    spread = (F.col("owners") > 1) & (F.col("repositories") >= copied_repositories)
    copied = stage(held.filter((F.col("owners") >= copied_owners) | spread).select("key", "owners", "repositories"), "secrets-copied")
    judged = both.join(small(copied, 48), both["span.key"] == copied["key"], "left").select("row", "span", F.col("owners").isNotNull().alias("copied"))
    per_row = judged.groupBy("row").agg(
        F.sum(F.col("copied").cast("bigint")).alias("n_copied"), F.sum((~F.col("copied")).cast("bigint")).alias("n_live"),
        F.collect_list(F.when((F.col("span.kind") == "live") & ~F.col("copied"), F.struct("span.kind", "span.start", "span.end"))).alias("added"),
    )
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    bare = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = scanned.join(per_row, "row", "left")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", bare.alias("base"), F.concat(bare, F.coalesce("added", empty)).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end in order of start, then kind as listed, comma-joined."""
    place = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
