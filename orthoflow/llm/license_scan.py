"""License scans (operator 10): Aho-Corasick for tags and notice phrases, expressions by
shunting-yard.

Method: one automaton over words holds the name and notice phrases and the words of the identifier
tag, and runs over a document's words. The expression behind a tag is parsed by a shunting-yard
parser (with binds before and, and before or) as far as it names known licenses, and evaluated
against a set of accepted ones. Phrases, licenses and accepted licenses are parameters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import ALNUM, prepare, word_runs

#: Fixed phrases of the base labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases, with the license they stand for.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "bsd license": "bsd",
    "isc license": "isc",
    "all rights reserved": "proprietary",
    "released into the public domain": "public-domain",
}
TAG = b"spdx-license-identifier"
#: Licenses whose use needs no more than a notice; an expression is permitted when it evaluates
#: to true with exactly these granted.
ACCEPTED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc 0bsd zlib unlicense cc0-1.0 bsl-1.0".split())


def license_ids() -> frozenset[str]:
    """Known license identifiers, lower-case: single names, and families with their versions."""
    names = set(
        "mit mit-0 x11 isc 0bsd zlib unlicense wtfpl ncsa postgresql openssl curl icu ntp tcl ruby vim w3c hpnd sleepycat "
        "beerware libtiff ijg json naist-2003 bsd-source-code php-3.0 php-3.01 python-2.0 psf-2.0 unicode-3.0 unicode-dfs-2016 blueoak-1.0.0".split()
    )
    versions = {
        "apache": "1.0 1.1 2.0", "mpl": "1.0 1.1 2.0", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "cddl": "1.0 1.1", "osl": "1.0 2.0 2.1 3.0", "afl": "1.1 2.0 2.1 3.0",
        "artistic": "1.0 2.0", "bsl": "1.0", "cc0": "1.0", "ofl": "1.0 1.1", "lppl": "1.0 1.2 1.3a 1.3c", "upl": "1.0", "zpl": "1.1 2.0 2.1", "cecill": "1.0 2.0 2.1", "mulanpsl": "1.0 2.0",
        "cpl": "1.0", "ipl": "1.0", "busl": "1.1", "sspl": "1.0", "nasa": "1.3", "libpng": "2.0", "ecl": "1.0 2.0", "ms": "pl rl", "odbl": "1.0", "pddl": "1.0",
    }
    names |= {f"{family}-{v}" for family, vs in versions.items() for v in vs.split()}
    names |= {f"bsd-{n}-clause{more}" for n in "1234" for more in ("", "-clear", "-patent", "-attribution")}
    names |= {f"{family}-{v}{kind}" for family, vs in (("gpl", "1.0 2.0 3.0"), ("lgpl", "2.0 2.1 3.0"), ("agpl", "1.0 3.0"), ("gfdl", "1.1 1.2 1.3")) for v in vs.split() for kind in ("", "-only", "-or-later")}
    return frozenset(names | {f"cc-by{kind}-{v}" for kind in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd") for v in "1.0 2.0 2.5 3.0 4.0".split()})


KNOWN = license_ids()
_BEHIND_TAG = re.compile(r"\s*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[^\s()]+")
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception(-[0-9.]+)?|exception-[a-z0-9.-]+")
_RANK = {"or": 1, "and": 2, "with": 3}

FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, permitted boolean, score double"


def expression_tokens(text: str, known: frozenset[str] = KNOWN) -> list[str]:
    """Tokens of a lower-case expression up to the first that is none: parentheses, operators, known
    licenses (a plus behind them allowed), references (licenseref-...) and, behind with, exceptions."""
    out: list[str] = []
    for raw in _TOKEN.findall(re.split(r"\*/|-->|[,;]", text)[0]):
        token = raw.rstrip(".") or raw
        after_with = bool(out) and out[-1] == "with"
        named = _EXCEPTION.fullmatch(token) if after_with else token.removesuffix("+") in known or token.startswith(("licenseref-", "documentref-"))
        if not (token in "()" or token in _RANK or named):
            while out and (out[-1] in _RANK or out[-1] == "("):  # what leads on to prose is prose
                out.pop()
            break
        out.append(token)
        if token != raw:  # a full stop ends the sentence
            break
    return out


def parse_expression(text: str, known: frozenset[str] = KNOWN) -> list[str] | None:
    """Reverse Polish form of the expression that a lower-case text begins with; None without any, or
    when it is malformed."""
    return shunting_yard(expression_tokens(text, known))


def shunting_yard(tokens: list[str]) -> list[str] | None:
    """Reverse Polish form of a whole expression; None when it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in tokens:
        if token == "(":
            if operand:
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in _RANK:
            if not operand:
                return None
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        elif operand:
            return None
        else:
            out.append(token)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(rpn: list[str], accepted: frozenset[str] = ACCEPTED) -> tuple[bool, list[str]]:
    """Whether the accepted licenses satisfy the expression, and the licenses it names; a license
    with an exception is one name, and accepted where the license alone is."""
    stack: list[tuple[bool, list[str]]] = []
    for token in rpn:
        if token not in _RANK:
            stack.append((token.removesuffix("+") in accepted, [token]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a, [f"{' '.join(left)} with {' '.join(right)}"]))
        else:
            stack.append((a and b if token == "and" else a or b, left + right))
    return stack[0]


class PhraseFinder:
    """Aho-Corasick automaton over words: states by (state, word), links to the longest suffix that is
    a state, and the phrases that end in each state."""

    def __init__(self, phrases: dict[str, str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.ends: list[list[tuple[int, str]]] = [[]]  # words of the phrase, label
        for phrase, label in phrases.items():
            state, words = 0, phrase.encode().split()
            for word in words:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][word]
            self.ends[state].append((len(words), label))
        self.link = [0] * len(self.next)
        order = list(self.next[0].values())
        for state in order:  # by depth: links of shorter ones are known
            for word, to in self.next[state].items():
                self.link[to] = self._step(self.link[state], word)
                self.ends[to] += self.ends[self.link[to]]
                order.append(to)

    def _step(self, state: int, word: bytes) -> int:
        while word not in self.next[state]:
            if not state:
                return 0
            state = self.link[state]
        return self.next[state][word]

    def places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, words, label) of every occurrence."""
        state, out = 0, []
        for i, word in enumerate(words):
            state = self._step(state, word)
            for size, label in self.ends[state]:
                out.append((i + 1 - size, size, label))
        return out


def anchors(phrases: list[str]) -> set[bytes]:
    """A word of each phrase, such that a text without any of these words holds no phrase."""
    return {max(p.split(), key=len).encode() for p in phrases}


#: label of the tag's words in the automaton; labels of base phrases have a plus before them
_TAGGED = "#tag"


def _scanner(text: str, notices: dict[str, str], accepted: frozenset[str], known: frozenset[str]):
    phrases = {**{p: f"+{v}" for p, v in BASE.items()}, **{p: v for p, v in notices.items() if p not in BASE}}
    words_of_phrases = anchors(list(phrases)) | {TAG}
    phrases[TAG.decode().replace("-", " ")] = _TAGGED

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PhraseFinder(phrases)
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.bool_(), pa.float64()]
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch, words in word_runs(batches, text, ALNUM, lower=True):
            raw = words.buf.tobytes()
            ends = words.offsets
            near: dict[int, None] = {}
            for anchor in words_of_phrases:
                at = raw.find(anchor)
                while at >= 0:
                    row = int(np.searchsorted(ends, at, side="right")) - 1
                    near[row] = None
                    at = raw.find(anchor, int(ends[row + 1]))
            counts = np.diff(words.first).tolist()
            rows = [(n, 0, None, None, [], [], [], None, 0.0) for n in counts]
            for r in near:
                rows[r] = _row(words, r, raw[int(ends[r]) : int(ends[r + 1])], finder, accepted, known)
            columns = list(zip(*rows, strict=True))
            found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            kept = [(n, batch.column(n)) for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *found], [*[n for n, _ in kept], *names])

    return scan


def _row(words, r: int, raw: bytes, finder: PhraseFinder, accepted: frozenset[str], known: frozenset[str]) -> tuple:
    first, end = int(words.first[r]), int(words.first[r + 1])
    places = finder.places([words.text(i) for i in range(first, end)])
    base = [(at, label[1:]) for at, _, label in places if label[0] == "+"]
    labels = defaultdict(float)
    for _, label in base:
        labels[label] = max(labels[label], 0.6)
    expressions, verdicts = [], []
    begin = int(words.offsets[r])
    for at, size, label in places:
        if label[0] == "+":
            continue
        if label != _TAGGED:
            labels[label] = max(labels[label], 0.8)
            continue
        start, stop = (int(x) - begin for x in (words.start[first + at], words.end[first + at + size - 1]))
        line = raw[stop : raw.find(b"\n", stop) if b"\n" in raw[stop:] else len(raw)].decode("utf-8", "replace") if raw[start:stop] == TAG else ""
        behind = _BEHIND_TAG.match(line)
        rpn = parse_expression(behind[1], known) if behind else None
        if rpn is not None:
            ok, named = evaluate(rpn, accepted)
            expressions.append(" ".join(rpn))
            verdicts.append(ok)
            labels.update(dict.fromkeys(named, 1.0))
    starts = [at for at, _ in base]
    return (
        end - first, len(base), min(starts, default=None), max(starts, default=None), sorted({label for _, label in base}), sorted(labels),
        expressions, all(verdicts) if verdicts else None, max(labels.values(), default=0.0),
    )


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, accepted: frozenset[str] = ACCEPTED,
    known: frozenset[str] = KNOWN,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word (places of the base
    phrases), base_labels, labels, expressions (in reverse Polish form), permitted (all of them
    satisfied by ``accepted``; null without any) and score (0 none, 0.6 a name, 0.8 a notice,
    1 an identifier expression).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. Null and empty texts
    have no words and no labels; text behind a tag that begins no expression of ``known`` licenses
    and references gives no label, text behind an expression is left out; repeated rows are reported each; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    notices = NOTICES if notices is None else notices
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner("text", notices, accepted, known), f"doc_id {id_type}, {FOUND}")
