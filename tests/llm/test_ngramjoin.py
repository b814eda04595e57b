"""The similarity join against all pairs of plain Python sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzlake.llm import ngramjoin


def plain_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plainly(rows):
    """(doc_id, size, component) of every row, by all pairs."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def planted(seed):
    """Texts with copies at all likenesses, near the limit too, chains of edits, and passages that many share."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta"] if rng.random() < 0.5 else [f"w{rng.randrange(4000)}" for _ in range(2)])
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([4, 5, 8, 9, 12, 30, 80, 200]))]
        if rng.random() < 0.4:
            base = base + passage if rng.random() < 0.5 else passage + base
        for _ in range(rng.randrange(1, 7)):
            rows.append(" ".join(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(base))
                base = base[:at] + rng.choice([[word()], [], [word(), base[at]]]) + base[at + 1 :]
    rows += [" ".join([f"x{i}" for i in range(k)]) for k in range(7, 12)] + ["same few words", "Same  FEW\nwords", "É e", "é e", None, "", " \t\n", None]
    return [(i * 3 % 101 + 200 * (i > 90), t) for i, t in enumerate(rng.sample(rows, len(rows)))] + [(None, rows[0]), (None, "nobody else has this"), (5, "twice here now"), (5, "twice here now")]


@pytest.mark.parametrize("verify", [0.0, 50.0])
def test_join_equals_all_pairs(spark, monkeypatch, verify):
    """Whatever l the documents take: the cost of a verification moves it from the shortest to the longest prefix."""
    monkeypatch.setattr(ngramjoin, "VERIFY", verify)
    rows = planted(int(verify * 20) + 1)
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, fp string, n int").repartition(3)
    got = sorted(map(tuple, ngramjoin.classes(docs).collect()), key=str)
    assert got == plainly(rows)
    assert len({c for _, _, c in got}) < len(rows) - 20  # there is something to find


def test_prefixes_adapt(spark, monkeypatch):
    """Shingles that many documents share make a document ask for more of them; one that shares too few leaves."""
    shared = [f"s{i}" for i in range(6)]
    texts = [" ".join([*shared, *(f"d{k}x{i}" for i in range(4))]) for k in range(40)] + [" ".join(f"one{i}" for i in range(30)), " ".join(f"one{i}" for i in range(29)) + " other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    monkeypatch.setattr(ngramjoin, "VERIFY", 5.0)
    nodes = ngramjoin.marked(docs)
    need = {r.row: r.need for r in ngramjoin.postings(nodes).select("row", "need").distinct().collect()}
    assert set(need) == {40, 41}  # of six shingles of the others, two are shared, and come last in the order


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(0)
    summary = ngramjoin.Summary(50)
    for _ in range(40):
        summary.add(np.concatenate([rng.integers(100, 10**9, 30).astype(np.uint64), np.arange(10, dtype=np.uint64)]))
        assert len(summary.keys) <= 50
    assert set(range(10)) <= set(summary.keys.tolist())


def test_signature_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in rng.integers(0, 300, 2))
        a = np.union1d(a, b[: len(b) // 2])
        bits = int(np.bitwise_count((ngramjoin.signature(a) ^ ngramjoin.signature(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_empty_table(spark):
    assert ngramjoin.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lists_make_no_square(spark):
    """Copies of one text with an edit each: compared with one centre, not with one another."""
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(0, 300, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngramjoin.classes(docs)
    assert found.select("component_id").distinct().count() == 1 and found.agg(F.min("component_id")).first()[0] == 0
