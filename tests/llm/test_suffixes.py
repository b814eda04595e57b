import hashlib
import random
from collections import Counter

import pytest

from quartzlake.llm import shared, suffixes


def first_kept(rows, length):
    """Bytes that stay if the first occurrence of each string does: by id (null last), then row, then place."""
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, gone = set(), {k: [False] * len(texts[k]) for k in order}
    for k in order:
        for s in range(len(texts[k]) - length + 1):
            if (w := texts[k][s : s + length]) in seen:
                gone[k][s : s + length] = [True] * length
            seen.add(w)
    return sorted(str((rows[k][0], bytes(b for b, g in zip(texts[k], gone[k], strict=True) if not g))) for k in order)


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in texts for s in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(map(str, out))


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdluäé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    passage, base = words(rng, 60), words(rng, 120)
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 500), (5, "x" * 199), (6, "y" * 200), (6, "y" * 200), (None, "y" * 201), (7, "Und " * 300)]
    rows += [(10 + k, words(rng, rng.randint(0, 40)) + passage[: rng.randint(50, len(passage))] + words(rng, 20)) for k in range(12)]
    rows += [(40, passage + passage), (41, base), (42, base), (43, base[:-1]), (44, "q" + base)]
    for k in range(60):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = rng.choice("xyzq")
        rows.append((100 + k, "".join(near)))
    rows += [(200, words(rng, 3000)), (201, "\U0001f600ö" * 100)]
    return rows


@pytest.mark.parametrize("length, kmer, batches, chunk", [(200, 40, 4, 1 << 20), (50, 11, 7, 300)])
def test_against_brute_force(spark, monkeypatch, length, kmer, batches, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if batches == 7 else "10m")  # both kinds of join
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string").repartition(3)
    got = suffixes.remove_repeats(docs, length, kmer, batches, carry=("text", "h"))
    found = [tuple(r) for r in got.collect()]
    assert sorted(str(r[:5]) for r in found) == brute(rows, length)
    assert sorted(str(r[6].text) for r in found) == sorted(str(t) for _, t in rows)
    assert all(hashlib.sha256(r[5]).hexdigest() == r[4] for r in found)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("length, kmer, chunk", [(50, 11, 300)])
def test_first_occurrence_stays(spark, monkeypatch, length, kmer, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rows = [(i, t) for i, t in corpus() if i != 6]  # rows of one id and text have no order of their own
    docs = spark.createDataFrame(random.Random(5).sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(docs, length, kmer, keep_first=True)
    assert sorted(str((r.doc_id, bytes(r.kept))) for r in got.collect()) == first_kept(rows, length)


@pytest.mark.parametrize("chunk", [333])
def test_a_chunk_edge_makes_no_repeat(spark, monkeypatch, chunk):
    """A unique text longer than several chunks stays whole, in the workers' chunks too, and a copied part still goes."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(11)
    unique, other = words(rng, 2500), words(rng, 800)
    rows = [(1, unique), (2, other + unique[3000:3600])]
    docs = spark.createDataFrame([rows[0]], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs).collect()] == [(0, 0)]
    both = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r[:5])) for r in suffixes.remove_repeats(both).collect()) == brute(rows, 200)


def test_the_default_chunk_edge(spark):
    """One unique text over a megabyte: nothing repeats in it."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(1, "".join("%032x" % rng.getrandbits(128) for _ in range(40000)))], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).first().n_removed == 0


def test_levels_merge_geometrically(spark):
    family = suffixes.ArrayFamily()
    for k in range(6):
        again = family.add(spark.createDataFrame([(k, 0, (k,)), (100 + k // 2, k, (k,))], "h long, c long, one struct<row: long>"))
        assert [r.h for r in again.collect()] == ([100 + k // 2] if k % 2 else [])
        ranks = [r for r, _ in family.levels]
        assert ranks == sorted(ranks, reverse=True) and sum(2**r for r in ranks) == k + 1


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROUND_BYTES", 1 << 10)
    rows = [(i, t) for i, t in corpus() if i != 6]
    docs = spark.createDataFrame(random.Random(6).sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(docs, 50, 11, keep_first=True)
    assert sorted(str((r.doc_id, bytes(r.kept))) for r in got.collect()) == first_kept(rows, 50)
