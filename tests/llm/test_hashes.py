"""Hashes decide about words and windows: strings built to collide must not."""

import numpy as np
import pyarrow as pa

from orthoflow.llm import ngram_jaccard, substring_dedup
from orthoflow.llm.common import SPACED, Words, string_buffer


def thue_morse(n, a, b):
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    return "".join(np.where(bits, a, b)), "".join(np.where(bits, b, a))


def hashes(texts, lane=0, block=1 << 20):
    return Words(*string_buffer(pa.array(texts)), SPACED, False).hashes(lane, block).tolist()


def test_words_have_hashes_of_their_own():
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abß漢"), size=rng.integers(1, 90))) for _ in range(4000)}
    for n in (64, 1024, 4096):
        words |= set(thue_morse(n, "a", "b"))
    words = sorted(words)
    for lane in (0, 1):
        found = hashes(words, lane)
        assert len(set(found)) == len(words)
        assert hashes([" ".join(words)], lane, 500) == found == hashes([f" \t{w}\n" for w in words], lane)
    assert not set(hashes(words, 0)) & set(hashes(words, 1))


def test_words_built_to_collide(spark):
    """Two documents of one long word each, one the complement of the other; the same with words
    behind; and the like with two words in the pattern."""
    rows = []
    for n in (1024, 2048, 8192):
        one, two = thue_morse(n, "a", "b")
        tail = " " + " ".join(f"w{i}" for i in range(12))
        rows += [one, two, one + tail, two + tail]
        first, second = thue_morse(n, "x ", "y ")
        rows += [first, second]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = ngram_jaccard.jaccard_components(docs).collect()
    sets = {}
    for r in found:
        words = rows[r["doc_id"]].split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    for r in found:
        linked = [d for d in sets if 100 * len(sets[d] & sets[r["doc_id"]]) >= 80 * len(sets[d] | sets[r["doc_id"]])]
        assert r["component_id"] in linked and r["component_id"] <= min(linked)
    kept = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()}
    first = {}
    for i, text in enumerate(rows):
        words = text.split()
        for j in range(len(words) - 12):
            first.setdefault(tuple(words[j : j + 13]), i)
    for i, text in enumerate(rows):
        words = text.split()
        gone = set()
        for j in range(len(words) - 12):
            if first[tuple(words[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        assert kept[i] == len(gone), i
