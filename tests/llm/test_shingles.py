import random

from quartzlake.llm import shared, shingles


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The doc_ids kept, by comparing all pairs."""
    s, root = [sets(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] == s[j] or len(s[i] & s[j]) * 5 >= 4 * len(s[i] | s[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        if root[i] not in seen:
            seen.add(root[i])
            out.append((rows[i][0], rows[i][1]))
    return out


def corpus():
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two three four"), (7, "a b c d e f g h"), (8, "a b c d e f g h i"), (9, "a b c d e f g")]
    head, rng = words(0, 60), random.Random(5)
    for k in range(60):  # one base, changed in a few or many words
        w = words(1, 200)
        for _ in range(k % 12):
            w[rng.randrange(200)] = f"x{rng.randrange(99)}"
        rows.append((100 + k, " ".join(w)))
    for k in range(40):  # a common head, long or short beside the rest
        rows.append((200 + k, " ".join(head + words(1000 + k, 4 + 3 * k))))
    for k in range(30):  # a chain: each near the next, the ends far apart
        rows.append((300 + k, " ".join(words(2, 400)[5 * k : 5 * k + 150])))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(i for i, _ in brute(rows))
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == want
    monkeypatch.setattr(shingles, "FREQUENT", 0)  # the order sets the cost, not the result
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == want


def test_decides_by_row(spark):
    """One doc_id with two texts: the text that stands alone stays; a row that repeats whole stays once."""
    a, b = " ".join(words(7, 80)), " ".join(words(8, 80))
    rows = [(9, a), (9, b), (5, b), (6, "u v w x y z"), (6, "u v w x y z"), (None, a), (None, "n")]
    got = shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(9, a), (5, b), (6, "u v w x y z"), (None, "n")]))


def test_empty_table(spark):
    assert shingles.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_group_far_from_its_first_member_makes_no_square(spark, monkeypatch):
    """Variants of one text of which a fifth of all pairs is similar: no step has rows in the square of their number."""
    rng, base, made, cut = random.Random(3), words(3, 200), [], shingles.cut
    rows = []
    for k in range(300):
        w = list(base)
        for at in range(5, 197, 16):
            if rng.random() < 0.5:
                w[at] = f"x{at}"
        rows.append((k, " ".join(w)))

    def counted(df, label):
        found = cut(df, label)
        made.append((found.count(), label))
        return found

    monkeypatch.setattr(shingles, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == sorted(i for i, _ in brute(rows))
    assert max(n for n, label in made if label in ("shingle-pairs", "shingle-near")) < 6000


def test_long_texts_with_a_common_passage_are_not_compared(spark, monkeypatch):
    """Texts too long for the signature that share a passage: prefixes have some shingles in common, far fewer than similar texts."""
    passage, made, cut = words(4, 30), [], shingles.cut
    rows = [(k, " ".join(words(2000 + k, 900) + passage + words(3000 + k, 600))) for k in range(60)]
    rows.append((60, rows[59][1].replace(" ", " changed ", 1)))

    def counted(df, label):
        found = cut(df, label)
        made.append((found.count(), label))
        return found

    monkeypatch.setattr(shingles, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == list(range(60))
    assert [n for n, label in made if label == "shingle-near"][-1] == 0  # the turn of all pairs


def test_rounds_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROUND_BYTES", 1 << 12)
    rows = corpus()
    assert shared.dealing_rounds(sum(len(t or "") for _, t in rows)) == shared.MOST_ROUNDS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in shingles.one_of_each(docs).collect()) == sorted(i for i, _ in brute(rows))
