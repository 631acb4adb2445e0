"""Repair of the turn structure of conversations by a run-length dynamic programme.

Rows become symbols (role initial x fault). Equal consecutive symbols are one run; a run of length
L moves the vector of least costs by the L-th min-plus power of its symbol's transition, put
together from cached binary powers. Walking the other way, the cheapest letters are read off
(unrolled) as the audit.

Scale: the texts stay where they are. A skeleton of 16-byte keys is grouped (identical rows become
one with a count), dealt into ranges of (conversation, turn, role, key) and cut into pieces of at
most ``PIECE`` rows, so no conversation passes through one task. Pieces give 4 x 4 matrices; those
of a conversation's pieces inside one range are multiplied first, then those of its ranges (no more
than there are ranges). Only turns that stay meet their texts again, and only for the repaired
conversation. The repaired rows keep an order (part, piece, place) that sorts within a conversation.

Contract: a null role or text counts as one space, a null conversation id is a conversation, a null
turn comes first. Rows of equal turn are taken in the order of role and key of the text (identical
rows are adjacent). Extra columns are ignored. Without rows there are no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import prepare, small, stage

PIECE = 4096
BLOB_BYTES = 1 << 20
INF = 1 << 60

# --- costs, states and symbols -------------------------------------------------------------

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: states of (s?(ua)+)?: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: the role that a rerole or an insert gives in each state, and the state behind it
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
#: state behind a kept row by its role initial (o: any other)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: symbols: the initial of a sound row, its capital for a truncated one, x for a row that must go
SYMBOLS = "suaoSUAOx"

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(INF, *(x + y for x, y in zip(row, col, strict=True))) for col in zip(*b, strict=True)) for row in a)


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(INF, *(x + y for x, y in zip(row, v, strict=True))) for row in a)


UNIT: Matrix = tuple(tuple(0 if i == j else INF for j in range(STATES)) for i in range(STATES))
_ONE_INSERT: Matrix = tuple(tuple(INSERT if NEXT_STATE[i] == j else INF for j in range(STATES)) for i in range(STATES))
#: any number of inserts; three reach every state that can be reached
INSERTS: Matrix = tuple(
    tuple(min(a, b, c, d) for a, b, c, d in zip(*rows, strict=True))
    for rows in zip(UNIT, _ONE_INSERT, _times(_ONE_INSERT, _ONE_INSERT), _times(_ONE_INSERT, _times(_ONE_INSERT, _ONE_INSERT)), strict=True)
)
#: least cost of ending in each state: inserts up to a whole exchange
ENDING: Vector = _apply(INSERTS, (0, INF, INF, 0))


def _choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state behind) of what can happen to a row, letters ascending."""
    out = [("D", DELETE, state)]
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        if state in _KEPT[symbol.lower()]:
            out.append(("K", KEEP + extra, _KEPT[symbol.lower()][state]))
        out.append(("R", REROLE + extra, NEXT_STATE[state]))
    return out


@lru_cache(maxsize=None)
def _step(symbol: str) -> Matrix:
    """Inserts, then one row of this symbol."""
    row = [[INF] * STATES for _ in range(STATES)]
    for state in range(STATES):
        for _, cost, behind in _choices(symbol, state):
            row[state][behind] = min(row[state][behind], cost)
    return _times(INSERTS, tuple(map(tuple, row)))


@lru_cache(maxsize=None)
def _power(symbol: str, bit: int) -> Matrix:
    """Transition of 2^bit rows of the symbol."""
    half = _step(symbol) if bit == 0 else _power(symbol, bit - 1)
    return half if bit == 0 else _times(half, half)


def run_matrix(symbol: str, length: int) -> Matrix:
    """Transition of a run, from the cached binary powers."""
    out, bit = UNIT, 0
    while length:
        if length & 1:
            out = _times(out, _power(symbol, bit))
        length >>= 1
        bit += 1
    return out


def run_costs(symbol: str, length: int, behind: Vector) -> Vector:
    """Least costs before a run, given those behind it."""
    bit = 0
    while length:
        if length & 1:
            behind = _apply(_power(symbol, bit), behind)
        length >>= 1
        bit += 1
    return behind


Runs = tuple[tuple[str, int], ...]


def collapse(symbols: list[tuple[str, int]]) -> Runs:
    """Runs of equal consecutive symbols."""
    out: list[list] = []
    for symbol, count in symbols:
        if out and out[-1][0] == symbol:
            out[-1][1] += count
        elif count:
            out.append([symbol, count])
    return tuple((s, n) for s, n in out)


def _one(symbol: str, state: int, costs: Vector, behind: Vector) -> tuple[str, int]:
    """Least letters of the cheapest way over one row: inserts before it, then its own letter."""
    letters, left = "", costs[state]
    while True:
        ways = [(letter, cost + behind[after], after) for letter, cost, after in _choices(symbol, state)]
        ways.append(("I", INSERT + costs[NEXT_STATE[state]], NEXT_STATE[state]))
        letter, _, after = min(way for way in ways if way[1] == left)
        letters += letter
        if letter != "I":
            return letters, after
        left, state = left - INSERT, after


def _unroll(symbol: str, length: int, state: int, behind: Vector) -> tuple[str, int]:
    """Letters of a run and the state behind it. Vectors of costs, taken from the end, differ by a
    constant from some point on in a short cycle; once state and place in the cycle come back, the
    letters between repeat."""
    shapes: dict[Vector, int] = {}
    costs = [behind]
    head = cycle = None
    while len(costs) <= length:
        shape = tuple(min(c - min(costs[-1]), INF) for c in costs[-1])
        if shape in shapes:
            head, cycle = shapes[shape], len(costs) - 1 - shapes[shape]
            break
        shapes[shape] = len(costs) - 1
        costs.append(_apply(_step(symbol), costs[-1]))

    def at(rows: int) -> Vector:
        if rows < len(costs):
            return costs[rows]
        return costs[head + (rows - head) % cycle]

    def one(rows: int, state: int) -> tuple[str, int]:
        # both vectors up to the same constant: the nearer one is a step of the other
        after = at(rows - 1)
        return _one(symbol, state, _apply(_step(symbol), after), after)

    out: list[str] = []
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    left = length
    while left:
        if head is not None and left - 1 >= head + cycle:
            mark = (state, (left - head) % cycle)
            if mark in seen:
                start, rows = seen[mark]
                turn = rows - left
                times = (left - head - cycle) // turn
                if times > 0:
                    out.append("".join(out[start:]) * times)
                    left -= times * turn
                    seen.clear()
                    continue
            seen[mark] = (len(out), left)
        letters, state = one(left, state)
        out.append(letters)
        left -= 1
    return "".join(out), state


@lru_cache(maxsize=1 << 14)
def walk(runs: Runs, state: int, behind: Vector) -> tuple[str, int]:
    """Cheapest letters over the runs from a state, ASCII-least among equals, and the state behind."""
    stops = [behind]
    for symbol, length in reversed(runs):
        stops.append(run_costs(symbol, length, stops[-1]))
    stops.reverse()
    letters = []
    for (symbol, length), after in zip(runs, stops[1:], strict=True):
        text, state = _unroll(symbol, length, state, after)
        letters.append(text)
    return "".join(letters), state


def finish(state: int) -> str:
    """Inserts behind the last row."""
    return "I" * (ENDING[state] // INSERT)


@lru_cache(maxsize=1 << 14)
def matrix_of(runs: Runs) -> Matrix:
    out = UNIT
    for symbol, length in runs:
        out = _times(out, run_matrix(symbol, length))
    return out


# --- rows to pieces ------------------------------------------------------------------------

_BLANKS = " \t\n\x0b\x0c\r"


def sound_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text without nulls in the last two, and the key of the text."""
    space = F.lit(" ")
    filled = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    return filled.withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def _skeleton(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, role, key): how often, its faults, whether it is the first
    of its role and text in the conversation."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    faults = rows.select("conv", "turn", "role", "key", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    grouped = stage(faults.groupBy("conv", "turn", "role", "key", "blank", "cut").agg(F.count(F.lit(1)).alias("times")), "turns")
    again = grouped.filter("not blank").groupBy("conv", "role", "key").agg(F.count(F.lit(1)).alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    again = stage(again.filter("turns > 1").select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("key").alias("key_"), F.col("first.turn").alias("turn_")), "turns-again")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("key") == F.col("key_")) & (F.col("role") == F.col("role_"))
    marked = grouped.join(small(again, 96), same, "left")
    late = F.col("key_").isNotNull() & ~F.col("blank") & ~F.col("turn").eqNullSafe(F.col("turn_"))
    return marked.select("conv", "turn", "role", "key", "times", "blank", "cut", late.alias("late"))


_PIECES = (
    "part int, piece int, rows array<struct<turn: bigint, role: string, key: binary, times: bigint>>, symbols string, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"
)


class _Piece:
    def __init__(self, conv):
        self.conv, self.rows, self.symbols = conv, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role, key, times, blank, cut, late):
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.illegal += times - 1  # copies have one initial
        if turn is not None:
            if self.high is None or turn != self.high:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if blank:
            self.blank += times
        elif late:
            self.duplicate += times
        else:
            self.duplicate += times - 1
            self.truncated += bool(cut)
        kind = initial if initial in ("s", "u", "a") else "o"
        self.symbols.append("x" if blank or late else kind.upper() if cut else kind)
        self.rows.append({"turn": turn, "role": role, "key": key, "times": times})


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Sorted skeleton rows of one range to pieces of conversations."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    done: list[_Piece] = []
    numbers: list[int] = []
    piece, number, held = None, 0, 0

    def out() -> pa.RecordBatch:
        names = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
        data = [{"conv": p.conv, "part": part, "piece": k, "rows": p.rows, "symbols": "".join(p.symbols), **{n: getattr(p, n) for n in names}} for p, k in zip(done, numbers, strict=True)]
        return pa.RecordBatch.from_pylist(data, schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None or row[0] != piece.conv or len(piece.rows) >= size:
                if piece is not None:
                    done.append(piece)
                    numbers.append(number)
                    held += len(piece.rows)
                number = number + 1 if piece is not None and row[0] == piece.conv else 0
                piece = _Piece(row[0])
                if held >= 2 * size:
                    yield out()
                    done, numbers, held = [], [], 0
            piece.add(*row[1:])
    if piece is not None:
        done.append(piece)
        numbers.append(number)
    if done:
        yield out()


def _runs(symbols: str, rows: list[dict]) -> Runs:
    """A sound row that stands several times is followed by its duplicates."""
    out = []
    for symbol, row in zip(symbols, rows, strict=True):
        out += [(symbol, row["times"])] if symbol == "x" else [(symbol, 1), ("x", row["times"] - 1)]
    return collapse(out)


# --- from pieces to decisions --------------------------------------------------------------
#
# Up: matrices of pieces, of ranges, of conversations. Down: costs behind each piece. Up again: to
# which state the cheapest letters lead from each of the four states. Down again: the state in which
# each piece is entered. Both walks over a conversation's parts are the fold below.


def _fold(nodes: list[dict], behind: Vector) -> list[Vector]:
    """Costs behind each of the nodes in order."""
    out = []
    for node in reversed(nodes):
        out.append(behind)
        behind = _apply(tuple(tuple(r) for r in node["matrix"]), behind)
    return out[::-1]


_MATRIX = "matrix array<array<bigint>>"


def _batch_map(fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in fn(row)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def _mapped(df: DataFrame, fn, fields: str) -> DataFrame:
    """Rows by ``fn(row dict) -> row dicts``; the type of conv is kept."""
    from pyspark.sql.types import StructType

    schema = StructType([df.schema["conv"], *StructType.fromDDL(fields).fields])
    return df.mapInArrow(_batch_map(fn, _arrow(schema)), schema)


def _piece_matrix(row: dict):
    yield {"conv": row["conv"], "part": row["part"], "piece": row["piece"], "matrix": matrix_of(_runs(row["symbols"], row["rows"]))}


def _product(row: dict):
    out = UNIT
    for node in sorted(row["nodes"], key=lambda n: n["piece"]):
        out = _times(out, tuple(tuple(r) for r in node["matrix"]))
    yield {"conv": row["conv"], "part": row["part"], "matrix": out, "pieces": len(row["nodes"])}


def _behind_parts(row: dict):
    nodes = sorted(row["nodes"], key=lambda n: n["part"])
    for node, behind in zip(nodes, _fold(nodes, ENDING), strict=True):
        yield {"conv": row["conv"], "part": node["part"], "behind": behind, "pieces": sum(n["pieces"] for n in nodes)}


def _behind_pieces(row: dict):
    nodes = sorted(row["nodes"], key=lambda n: n["piece"])
    for node, behind in zip(nodes, _fold(nodes, tuple(row["behind"])), strict=True):
        yield {"conv": row["conv"], "part": row["part"], "piece": node["piece"], "behind": behind, "pieces": row["pieces"]}


def _exits(row: dict):
    """States behind the piece from each state before it."""
    runs, behind = _runs(row["symbols"], row["rows"]), tuple(row["behind"])
    yield {"conv": row["conv"], "part": row["part"], "piece": row["piece"], "exits": [_exit(runs, s, behind) for s in range(STATES)]}


def _exit(runs: Runs, state: int, behind: Vector) -> int:
    """-1 where nothing leads on from the state."""
    return walk(runs, state, behind)[1] if _apply(matrix_of(runs), behind)[state] < INF else -1


def _chain(nodes: list[dict]) -> list[int]:
    out = list(range(STATES))
    for node in nodes:
        out = [node["exits"][s] if s >= 0 else -1 for s in out]
    return out


def _exits_part(row: dict):
    yield {"conv": row["conv"], "part": row["part"], "exits": _chain(sorted(row["nodes"], key=lambda n: n["piece"]))}


def _entry_parts(row: dict):
    state = START
    for node in sorted(row["nodes"], key=lambda n: n["part"]):
        yield {"conv": row["conv"], "part": node["part"], "entry": state}
        state = node["exits"][state]


def _entry_pieces(row: dict):
    state = row["entry"]
    for node in sorted(row["nodes"], key=lambda n: n["piece"]):
        yield {"conv": row["conv"], "part": row["part"], "piece": node["piece"], "entry": state}
        state = node["exits"][state]


def _on(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys that may be null, which come once."""
    other = other.select(*[F.col(c).alias(f"{c}__" if c in keys else c) for c in other.columns])
    same = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"{k}__"))
        same = here if same is None else same & here
    return df.join(other, same).drop(*[f"{k}__" for k in keys])


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces of conversations of more than one, with costs behind and the state before them."""
    matrices = stage(_mapped(pieces, _piece_matrix, f"part int, piece int, {_MATRIX}"), "conv-matrices")
    by_part = matrices.groupBy("conv", "part").agg(F.collect_list(F.struct("piece", "matrix")).alias("nodes"))
    by_part = stage(by_part, "conv-parts")
    products = _mapped(by_part, _product, f"part int, {_MATRIX}, pieces int")
    whole = products.groupBy("conv").agg(F.collect_list(F.struct("part", "matrix", "pieces")).alias("nodes"))
    behind = _mapped(whole, _behind_parts, "part int, behind array<bigint>, pieces int")
    behind = _mapped(_on(by_part, behind, "conv", "part"), _behind_pieces, "part int, piece int, behind array<bigint>, pieces int")
    behind = stage(behind, "conv-behind")
    pieces = stage(_on(pieces, behind, "conv", "part", "piece"), "conv-pieces")
    exits = stage(_mapped(pieces, _exits, "part int, piece int, exits array<int>"), "conv-exits")
    by_part = stage(exits.groupBy("conv", "part").agg(F.collect_list(F.struct("piece", "exits")).alias("nodes")), "conv-parts")
    whole = _mapped(by_part, _exits_part, "part int, exits array<int>").groupBy("conv").agg(F.collect_list(F.struct("part", "exits")).alias("nodes"))
    entry = _mapped(_on(by_part, _mapped(whole, _entry_parts, "part int, entry int"), "conv", "part"), _entry_pieces, "part int, piece int, entry int")
    return _on(pieces, stage(entry, "conv-entry"), "conv", "part", "piece")


_DECIDED = (
    "part int, piece int, pieces int, audit string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, turns bigint, cost bigint, turns_left array<struct<place: int, turn: bigint, role: string, key: binary, times: bigint, new_role: string>>"
)


def _cost(audit: str, row: dict) -> int:
    """Cost of a piece's letters."""
    cost, places = 0, iter(zip(row["symbols"], row["rows"], strict=True))
    skip = 0
    for letter in audit:
        if letter == "I":
            cost += INSERT
            continue
        if skip:
            skip -= 1
            cost += DELETE
            continue
        symbol, place = next(places)
        skip = place["times"] - 1
        cost += {"K": KEEP, "R": REROLE, "D": DELETE}[letter] + (TRUNCATED if symbol.isupper() and letter != "D" else 0)
    return cost


def _decide(row: dict):
    """Letters of a piece and the turns that they leave, in order."""
    end = row["last_piece"]
    runs, behind = _runs(row["symbols"], row["rows"]), tuple(row["behind"])
    audit, state = walk(runs, row["entry"], behind)
    if end:
        audit += finish(state)
    left, state, at, skip = [], row["entry"], 0, 0
    for place, letter in enumerate(audit):
        if letter == "I":
            left.append({"place": place, "turn": None, "role": None, "key": None, "times": 0, "new_role": NEXT_ROLE[state]})
            state = NEXT_STATE[state]
            continue
        if skip:
            skip -= 1
            continue
        here, symbol = row["rows"][at], row["symbols"][at]
        at, skip = at + 1, here["times"] - 1
        if letter == "D":
            continue
        role = here["role"] if letter == "K" else NEXT_ROLE[state]
        left.append({"place": place, **here, "new_role": role})
        state = _KEPT[symbol.lower()][state] if letter == "K" else NEXT_STATE[state]
    kept = ("conv", "part", "piece", "pieces", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
    yield {**{k: row[k] for k in kept}, "audit": audit, "cost": _cost(audit, row), "turns_left": left}


def _report(row: dict):
    """A conversation from its pieces."""
    nodes = sorted(row["nodes"], key=lambda n: (n["part"], n["piece"]))
    total = {k: sum(n[k] for n in nodes) for k in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")}
    for a, b in zip(nodes, nodes[1:], strict=False):
        total["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    dated = [n for n in nodes if n["low"] is not None]
    total["turns"] -= sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - total["turns"] if dated else 0
    yield {"conv": row["conv"], "gaps": gaps, **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(n["audit"] for n in nodes)}


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(a row per conversation, the repaired turns).

    The first: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. The second: conv, part,
    piece, place (order within a conversation), pieces (of the conversation), turn (null for an
    inserted one), role, text.
    """
    prepare(rows.sparkSession)
    from pyspark.sql.types import StructType

    rows = sound_rows(rows, conv, turn, role, text)
    skeleton = _skeleton(rows)
    order = ["conv", "turn", "role", "key"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = skeleton.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = StructType([skeleton.schema["conv"], *StructType.fromDDL(_PIECES).fields])
    arrow = _arrow(schema)
    pieces = stage(ranged.mapInArrow(lambda batches: _pieces(batches, arrow, piece), schema), "conv-pieces")
    # most conversations are one piece: nothing has to be handed on
    several = pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("many"), F.max(F.struct("part", "piece")).alias("end")).filter("many > 1")
    several = stage(several.select(F.col("conv").alias("conv_"), "end"), "conv-several")
    mine = F.col("conv").eqNullSafe(F.col("conv_"))
    several = small(several, 64)
    alone = pieces.join(several, mine, "left_anti").withColumns({"behind": F.array(*[F.lit(c).cast("bigint") for c in ENDING]), "pieces": F.lit(1), "entry": F.lit(START), "last_piece": F.lit(True)})
    long = pieces.join(several.select("conv_"), mine).drop("conv_")
    placed = _on(_placed(long), several.select(F.col("conv_").alias("conv"), "end"), "conv")
    placed = placed.withColumn("last_piece", F.struct("part", "piece") == F.col("end")).drop("end")
    decided = _mapped(alone.unionByName(placed.select(*alone.columns)), _decide, _DECIDED)
    decided = stage(decided, "conv-decided")
    facts = [c for c in decided.columns if c not in ("conv", "turns_left", "pieces")]
    report = _mapped(decided.groupBy("conv").agg(F.collect_list(F.struct(*facts)).alias("nodes")), _report, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")

    left = decided.select("conv", "part", "piece", "pieces", F.inline("turns_left"))
    place = ["conv", "part", "piece", "place", "pieces"]
    inserted = left.filter("key is null").select(*place, F.lit(None).cast("bigint").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    kept = left.filter("key is not null").withColumnsRenamed({"conv": "conv_", "turn": "turn_", "role": "role_", "key": "key_"})
    meet = F.col("conv").eqNullSafe(F.col("conv_")) & F.col("turn").eqNullSafe(F.col("turn_")) & (F.col("role") == F.col("role_")) & (F.col("key") == F.col("key_"))
    found = rows.join(kept, meet).select(*place, "turn", F.col("new_role").alias("role"), "text", "times")
    once = found.filter("times = 1").drop("times")
    # a row that stands several times meets its one place as often: one of them is enough
    more = found.filter("times > 1").groupBy(*place, "turn", "role").agg(F.first("text").alias("text"))
    return report, once.unionByName(more).unionByName(inserted)


# --- digests of whole conversations --------------------------------------------------------


def _streamed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns: the digest of a conversation of one piece, the bytes of a longer one in blobs."""
    state: dict = {"key": None, "sha": None, "blob": b"", "n": 0}
    out: list[dict] = []

    def flush(last: bool) -> None:
        conv, part, piece, pieces = state["key"]
        row = {"conv": conv, "part": part, "piece": piece, "n": state["n"], "sha": None, "blob": None}
        if pieces == 1 and last:
            out.append({**row, "sha": state["sha"].hexdigest()})
        elif pieces > 1 and state["blob"]:
            out.append({**row, "blob": state["blob"]})
            state["blob"], state["n"] = b"", state["n"] + 1

    for batch in batches:
        for conv, part, piece, _, pieces, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (conv, part, piece, pieces)
            if key != state["key"]:
                if state["key"] is not None:
                    flush(True)
                state = {"key": key, "sha": hashlib.sha256(), "blob": b"", "n": 0, "first": True}
            line = f"{role}:{text}".encode()
            if pieces == 1:
                state["sha"].update(line if state["first"] else b"\n" + line)
            else:
                state["blob"] += line + b"\n"
                if len(state["blob"]) >= limit:
                    flush(False)
            state["first"] = False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if state["key"] is not None:
        flush(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted blobs of conversations to digests; the newline behind the last turn is left out."""
    conv, sha = None, None
    for batch in batches:
        out = []
        for here, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sha is None or here != conv:
                if sha is not None:
                    out.append({"conv": conv, "sha": sha.hexdigest()})
                conv, sha = here, hashlib.sha256(blob[:-1])
            else:
                sha.update(b"\n" + blob[:-1])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": sha.hexdigest()}], schema)


def digests(turns: DataFrame, blob: int = BLOB_BYTES) -> DataFrame:
    """conv, sha: SHA-256 of the repaired ``role:text`` lines, joined by newlines.

    Turns are dealt by piece; a conversation of several pieces sends blobs of about a megabyte to the
    one task that can chain its digest.
    """
    from pyspark.sql.types import StructType

    conv = turns.schema["conv"]
    keys = ["conv", "part", "piece"]
    dealt = turns.repartition(*keys).sortWithinPartitions(*keys, "place").select(*keys, "place", "pieces", "role", "text")
    schema = StructType([conv, *StructType.fromDDL("part int, piece int, n int, sha string, blob binary").fields])
    arrow = _arrow(schema)
    found = stage(dealt.mapInArrow(lambda b: _streamed(b, arrow, blob), schema), "conv-digests")
    blobs = found.filter("blob is not null").repartition("conv").sortWithinPartitions("conv", "part", "piece", "n").select("conv", "blob")
    schema = StructType([conv, *StructType.fromDDL("sha string").fields])
    short = _arrow(schema)
    return found.filter("sha is not null").select("conv", "sha").unionByName(blobs.mapInArrow(lambda b: _joined(b, short), schema))


# --- damage, for the registered query ------------------------------------------------------


def damage(rows: DataFrame, seed: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text of rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = seed if seed is not None else F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    hurt = rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return hurt.filter("copies > 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def repair_report(conversations: DataFrame, damaged: DataFrame, piece: int = PIECE, blob: int = BLOB_BYTES) -> DataFrame:
    """A row per conversation of the first table: what was found and done in the second."""
    report, turns = repair(damaged, piece=piece)
    none = hashlib.sha256(b"").hexdigest()
    ids = conversations.select(F.col("conv_id").alias("conv0")).distinct()
    mine = lambda c: F.col("conv0").eqNullSafe(F.col(c))
    report = report.withColumnRenamed("conv", "conv1")
    sums = digests(turns, blob).select(F.col("conv").alias("conv2"), "sha")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return (
        ids.join(report, mine("conv1"), "left").join(sums, mine("conv2"), "left")
        .select(F.col("conv0").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(none)).alias("repaired_sha256"))
    )
