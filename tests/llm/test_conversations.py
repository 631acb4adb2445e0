"""Conversation repair against brute force: letters, counts and digests."""

import hashlib
import heapq
import random
import zlib

import pytest

from orthoflow.llm import conversations as C

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cheapest edits of [(initial, fault)] by Dijkstra over (row, state), ASCII-least among equals."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    todo = [(0, "", 0, 0)]
    done = set()
    while todo:
        cost, audit, i, state = heapq.heappop(todo)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit
        made = {s: t for s, t in after[state].items() if s in "ua"}
        for to in made.values():
            heapq.heappush(todo, (cost + 5, audit + "I", i, to))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if initial in after[state]:
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, after[state][initial]))
                for to in made.values():
                    heapq.heappush(todo, (cost + 1 + extra, audit + "R", i + 1, to))
    raise AssertionError


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_name, turn_name = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{conv_name}:{turn_name}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    found = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damaged(rows):
        groups[r[0]].append(r[1:])
    key = lambda t: hashlib.sha256(t.encode()).digest()[:16]
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], key(t[2])))
        seen, symbols = set(), []
        for _, role, text in turns:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit = cheapest(symbols)
        dated = [t[0] for t in turns if t[0] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:], strict=False))
        lines, at, state = [], 0, "a"
        for letter in audit:
            if letter != "I":
                _, role, text = turns[at]
                at += 1
                if letter == "D":
                    continue
            if letter == "I":
                text = ""
            if letter in "IR":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            lines.append(f"{role}:{text}")
        faults = [f for _, f in symbols]
        found[conv] = (
            max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def run(spark, rows, schema="conv_id long, turn long, role string, text string, extra long, conv int", **sizes):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], schema).repartition(5)
    out = C.repair_report(table, C.damage(table), **sizes).collect()
    assert len({r["conv_id"] for r in out}) == len(out)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out}


def letters(rows):
    """Audit and cost through runs, powers and unrolling."""
    named = [("x" if f in ("blank", "duplicate") else (i if i in "sua" else "o").upper() if f else (i if i in "sua" else "o"), 1) for i, f in rows]
    runs = C.collapse(named)
    cost = C._apply(C.matrix_of(runs), C.ENDING)[C.START]
    audit, state = C.walk(runs, C.START, C.ENDING)
    return cost, audit + C.finish(state)


def test_letters_against_brute_force():
    rng = random.Random(3)
    for n in range(400):
        size = rng.randrange(0, 14)
        stick = rng.random()
        rows = []
        for _ in range(size):
            if rows and rng.random() < stick:
                rows.append(rows[-1])
            else:
                rows.append((rng.choice("suaot"[: rng.randrange(1, 6)]), rng.choice(["", "", "", "blank", "truncated"])))
        assert letters(rows) == cheapest(rows), (n, rows)


@pytest.mark.parametrize("symbol", ["s", "u", "a", "o", "S", "U", "A", "O", "x"])
def test_long_runs_by_powers(symbol):
    name = symbol if symbol == "x" else symbol.lower()
    fault = "blank" if symbol == "x" else "truncated" if symbol.isupper() else ""
    for size in (1, 2, 3, 17, 60, 61):
        rows = [("u", "")] + [(name if name in "sua" else "t", fault)] * size + [("a", "")]
        assert letters(rows) == cheapest(rows), size
    runs = (("u", 1), (symbol, 1_000_003), ("a", 1))
    audit, _ = C.walk(runs, C.START, C.ENDING)
    assert sum(c != "I" for c in audit) == 1_000_005
    stepped = C.ENDING
    for s, length in reversed(runs):
        for _ in range(length if length < 2000 else 0):
            stepped = C._apply(C._step(s), stepped)
    vector = C.run_costs(symbol, 2001, C.ENDING)
    plain = C.ENDING
    for _ in range(2001):
        plain = C._apply(C._step(symbol), plain)
    assert vector == plain


def messy():
    rng = random.Random(5)
    says = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Yes.", "Ünïcödé 漢字 done. ", "a\nb.", None]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            if turn < 2:
                role = ["system", "user"][turn]
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, rng.choice(says)))
    rows += [(None, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(6)]
    rows += [(900, None, "user", None), (901, 5, "user", "x " * 200_000 + "end.")]
    rows += [(902, 7, "user", "same."), (902, 7, "user", "same."), (902, 7, "assistant", "same."), (902, 8, "user", "same.")] * 3
    dropped = next(n for n in range(10_000, 20_000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone.")]
    return rows


def test_repair_against_brute_force(spark):
    rows = messy()
    assert run(spark, rows) == brute(rows)


def test_one_conversation_over_many_pieces(spark):
    """A conversation that spans ranges and pieces, with ties between edits across their borders."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{t}.", f"{t}!", f"{t}"])) for t in range(700)]
    rows += [(2, 3, "user", "again.")] * 50 + [(2, 4, "assistant", "ok.")] + [(3, 0, "user", "a.")] + [(3, 1, "assistant", "b.")]
    rows += [(None, t, "user", "never again.") for t in range(60)]
    got, want = run(spark, rows, piece=7, blob=40), brute(rows)
    assert got == want


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair_report(table, C.damage(table)).collect() == []


def test_registered_query(spark, sf):
    from orthoflow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in out} == brute(rows)
