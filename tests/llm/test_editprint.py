import hashlib
import random

import numpy as np
import pytest

from quartzlake.llm import editprint as E


def slow_print(text):
    """The walk, one step at a time."""
    bits = np.random.default_rng(7).random((256, E.PERIOD)) < 0.5
    bits[:, -1] = True
    chars, i, j, out, level = E.code_points(text), 0, 0, [], E.level_of(len(text))
    while i < len(chars):
        c = int(chars[i])
        keep = level == 0 or all(int(E._mixed(np.array([j]))[0]) & ((1 << m) - 1) == 0 for m in range(1, level + 1))
        if keep:
            out.append(f"{int(E._mixed(np.array([c ^ (j << 24)], np.uint64))[0]) & 15:x}")
        i += bool(bits[((c * 2654435761) & 0xFFFFFFFF) >> 24, j % E.PERIOD])
        j += 1
    return f"{level:02d}:" + "".join(out)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(n))


TEXTS = ["", "a", "ab", "Ö", "abc", "\U0001f600x" * 50, words(1, 30), words(2, 300), words(3, 3000), "a" * 9000, words(2, 300)]


def test_walks_match_single_steps(monkeypatch):
    for few in (1, 3, 48):
        monkeypatch.setattr(E, "FEW", few)
        got = E.prints([(i, t, None) for i, t in enumerate(TEXTS)])
        assert [r["fingerprint"] for r in got] == [slow_print(t) for t in TEXTS]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_edited_and_next(spark, parts, monkeypatch):
    monkeypatch.setattr(E, "CHUNK_CHARS", 500)
    rows = [(None, "first of all"), *((i * 7 % 23 - 3, t) for i, t in enumerate(TEXTS)), (100, None), (100, None)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, place int").repartition(parts)
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, f) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        a, b, c = slow_print(t), slow_print(edited), slow_print(f)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, E.likeness(a, b), E.likeness(a, c)))
    got = [tuple(r)[:7] for r in E.fingerprints(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_likeness_follows_edits():
    base = words(5, 800)
    edited = lambda share: "".join(c if random.Random(k).random() > share else "" for k, c in enumerate(base))
    own = slow_print(base)
    near, far = E.likeness(own, slow_print(edited(0.002))), E.likeness(own, slow_print(words(6, 800)))
    assert E.likeness(own, own) == 1 and near > 0.3 and far < 0.2
    assert E.likeness("00:", "00:") == 1 and E.likeness("00:", own) == 0


def planted():
    """Texts with one or a few changed characters at the head, in the middle and at the tail, a crowd of near copies, and strangers."""
    rng, texts = random.Random(9), []
    for k in range(10):
        base = words(100 + k, rng.choice([6, 30, 150, 400, 700]))
        texts.append(base)
        for place in (0, len(base) // 2, len(base) - 2):
            texts.append(base[:place] + "q" + base[place + 1 :])
            texts.append(base[:place] + "zz" + base[place:])
    crowd = words(300, 250)
    texts += [crowd[: len(crowd) - len(tail := f" {k * 7919 % 1000}")] + tail for k in range(120)]
    return texts + [words(500 + k, 100) for k in range(20)] + ["", "", "a", "ab"]


def test_classes_against_all_pairs(spark):
    texts = planted()
    docs = spark.createDataFrame([(k + 5, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id - 5: r.class_id for r in E.classes(E.fingerprints(docs)).collect()}
    prints = {k: slow_print(t) for k, t in enumerate(texts) if len(t) < 2500} | {k: E.prints([(k, t, None)])[0]["fingerprint"] for k, t in enumerate(texts) if len(t) >= 2500}
    root, near = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            if E.likeness(prints[i], prints[j]) >= E.LIKE:
                near.append((i, j))
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert len(near) > 5000
    assert sum(got[i] == got[j] for i, j in near) / len(near) >= 0.99  # recall
    assert all(root[k] == root[c - 5] for k, c in got.items())  # nothing is made up
    assert all(got[k] <= k + 5 and got[got[k] - 5] == got[k] for k in got)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert E.fingerprints(none).count() == 0 and E.classes(E.fingerprints(none)).count() == 0


def test_unlike_members_of_a_list_are_not_paired(spark):
    """Members of one list in many components, of several levels: all like pairs are left, few of the others."""
    rng = random.Random(3)
    texts = [words(100 + i, n) for i in range(40) for n in (4, 40)]
    for t in list(texts):
        k = rng.randrange(len(t))
        texts.append(t[:k] + "q" + t[k + 1 :])
    prints = sorted({r["fingerprint"] for r in E.prints([(i, t, None) for i, t in enumerate(texts)])})
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint string")

    def met(levels):
        """Pairs of one list at each level, as if all fingerprints that have it, of so many levels of their own, shared a band there."""
        listed = [(64 + level, i, i) for i, f in enumerate(prints) for level, *_ in list(E._levels(f))[:levels]]
        rows = [(r.hi, r.lo) for r in E.apart(spark.createDataFrame(listed, "key long, node long, root long"), nodes, E.LIKE).collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    pairs = {(i, j) for i in range(len(prints)) for j in range(i) if abs(int(prints[i][:2]) - int(prints[j][:2])) <= 1}
    like = {(i, j) for i, j in pairs if E.likeness(prints[i], prints[j]) >= E.LIKE}
    below = {(i, j) for i, j in pairs if prints[i][:2] == prints[j][:2]}
    assert len(like) > 40 and like <= met(2)
    rows = met(1)
    assert like & below <= rows <= below and len(rows - like) < len(below) / 20


def test_late_differences_leave_no_pairs(spark, monkeypatch):
    """Texts of one head and different tails, all in one list: no table of pairs has more than those that the threshold leaves open."""
    head = words(1, 26)
    prints = sorted({r["fingerprint"] for r in E.prints([(k, f"{head} {words(50 + k, 12)}", None) for k in range(60)])})
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint string")
    level = int(prints[0][:2])
    listed = spark.createDataFrame([(64 + level, k, k) for k, f in enumerate(prints) if int(f[:2]) == level], "key long, node long, root long")
    made, cut = [], E.cut

    def counted(df, *rest):
        found = cut(df, *rest)
        if "hi" in found.columns:
            made.append(found.count())
        return found

    monkeypatch.setattr(E, "cut", counted)
    got = {(r.hi, r.lo) for r in E.apart(listed, nodes, E.LIKE).collect()}
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if int(prints[i][:2]) == int(prints[j][:2]) == level]
    assert {p for p in pairs if E.likeness(prints[p[0]], prints[p[1]]) >= E.LIKE} <= got
    assert len(pairs) > 500 and max(made) < len(pairs) / 20


@pytest.mark.parametrize("n", [1, 63, 64, 65, 319, 320, 400])
def test_sketches_count_unlike_digits(n):
    rng = np.random.default_rng(n)
    a, b = (np.frombuffer("".join(f"{d:x}" for d in rng.integers(0, 16, n)).encode(), np.uint8) for _ in range(2))
    apart = (E.sketch(a) ^ E.sketch(b)).reshape(-1, E.PLANES)
    assert sum((int(x) & (1 << 64) - 1).bit_count() for x in np.bitwise_or.reduce(apart, axis=1)) == (a[:320] != b[:320]).sum()
