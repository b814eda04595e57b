import random
import re
from itertools import combinations

import pytest
import xxhash

from quartzlake.llm import simhash
from quartzlake.llm.graph import components


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_the_plain_definition():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 9, 60):
        for _ in range(8):
            text = " \n".join(rng.choice(["Wort", "İz", "ÄRGER", "a\u00a0b", "x", "\x1cY"]) for _ in range(n))
            assert simhash.fingerprint(text) == plain_fingerprint(text)
    tie = next(k for k in range(1000) if (xxhash.xxh64_intdigest(b"a b c", 42) ^ xxhash.xxh64_intdigest(f"b c w{k}".encode(), 42)).bit_count() > 30)
    assert simhash.fingerprint(f"a b c w{tie}") == plain_fingerprint(f"a b c w{tie}")  # a bit of half the shingles is 0


def brute(rows):
    """doc_id -> component_id by union-find over all pairs."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            lo, hi = sorted((find(i), find(j)))
            root[hi] = lo
    return {i: find(i) for i, _ in prints}


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 9973}" for k in range(n))


ROWS = [
    (10, None), (3, ""), (7, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (8, "one two"), (20, words(1, 400)), (21, words(1, 400)),
    (22, words(1, 399) + " end"), (23, "x " + words(1, 399)), (30, words(2, 300)), (31, words(2, 300).upper()), (40, words(3, 30000)), (41, words(3, 29999)), (50, "a a a a a a a"),
]


def test_components_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(ROWS)


def test_known_fingerprint():
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint("\n ") == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [1, 100])
def test_lists_beyond_the_limit_lose_no_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "MAX_LIST", limit)
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << a) ^ (1 << b) for a in range(0, 20, 3) for b in range(a, 64, 5)] + [base, base ^ 0xFF, 77]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    low = lambda p: p & ((1 << 64) - 1)
    root = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(prints, 2):
            if (low(a) ^ low(b)).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert {p: got.get(p, p) for p in prints} == root


def test_chain_and_repeats(spark):
    rows = [(i + 1, i) for i in range(60)] * 2 + [(101, 100), (100, 102), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "hi long, lo long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
