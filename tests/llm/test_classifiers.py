import random

import numpy as np
import pytest

from quartzlake.llm import language, toxicity

# Invented words for three made-up languages.
STEMS = {"aa": ["tano", "miko", "sula", "reno", "kari"], "bb": ["schtur", "pfeng", "lichz", "gerüb", "kömpf"], "cc": ["eaux", "ille", "ouvré", "tion", "çaire"]}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "s", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def net(spark):
    rows = [(i, text(c, i), c) for i, c in enumerate(list(STEMS) * 20)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_of_held_out_texts(spark, net):
    cases = [(i, text(c, 1000 + i, n), c) for i, (c, n) in enumerate([(c, n) for c in STEMS for n in (12, 40, 4000)])]
    cases += [(100, None, "x"), (101, "", "x"), (102, "12 34 !", "x"), (103, None, None)]
    docs = spark.createDataFrame(cases, "doc_id long, text string, lang_pred string").repartition(3)
    got = {r.doc_id: r for r in language.predict(docs, net).collect()}
    for i, t, c in cases:
        if i >= 100:
            assert (got[i].lang_pred, got[i].lang_score) == ("und", 0.0)
        else:
            assert got[i].lang_pred == c and 0 <= got[i].lang_score <= 1


def test_pooling_covers_every_byte_once(net, monkeypatch):
    raw = text("bb", 5, 100).encode()
    for n in (1, 63, 64, 65, 127, 128, 130):
        one = language.pooled(net, [raw[:n], b"", raw[:n]])
        assert np.allclose(one[0], one[2]) and np.isclose(one[0].sum(), 1, atol=1e-4) and one[1].sum() == 0
    alone = language.pooled(net, [raw])
    monkeypatch.setattr(language, "BATCH", 3)
    assert np.allclose(language.pooled(net, [raw]), alone, atol=1e-5)


def test_gradients(monkeypatch):
    """Training lowers the error of a tiny problem to almost nothing."""
    net = language.train({"p": [b"abababababab" * 20], "q": [b"cdcdcdcdcdcd" * 20]})
    assert language.pooled(net, [b"ababab" * 5])[0, 0] > 0.9 and language.pooled(net, [b"dcdc" * 9])[0, 1] > 0.9


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.fit(docs) is None
    assert language.predict(docs, None).first().lang_pred == "und"
    assert language.predict(docs.limit(0), None).count() == 0


def toxic_rows(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(["river", "house", "green", "walk", "stone", "paper", "lamp", "idle"]) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["grumblor", "grumblors,", "Grumblor"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(9999, 1, "x"), (1, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    new = toxic_rows(200, 2) + [(900, None, 0), (901, "", 0), (902, "house " * 40000 + "grumblor", 1), (902, "house " * 40000, 0)]
    held = spark.createDataFrame([(i, t, y) for i, t, y in new], "doc_id long, text string, want int").repartition(3)
    for r in toxicity.score(held, model).collect():
        assert (r.toxic_score >= 0.5) == bool(r.want) and 0 <= r.toxic_score <= 1


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxic_score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_toxicity_sample_is_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 40, 0: 60})
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(7)
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS toxic")
    found, share = toxicity.sample(docs, labels, "toxic")
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h", "doc_id").collect()]
    want = {1: [i for i in order if i % 3 == 0][:40], 0: [i for i in order if i % 3][:60]}
    got = found.collect()
    assert {y: {r.doc_id for r in got if r.y == y} for y in want} == {y: set(ids) for y, ids in want.items()} and share == 1 / 3
    assert toxicity.sample(docs.limit(0), labels, "toxic")[1] is None
