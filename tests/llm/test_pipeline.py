import random
from pathlib import Path

import corpus_pipeline as pipeline
import pytest

from quartzlake.llm import shared

STEMS = {"en": ["river", "stone", "house", "green", "walk"], "de": ["schtur", "pfeng", "lichz", "gerüb", "kömpf"]}


def text(lang, seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["s", "", "en", "er", "ly"]) + rng.choice(["", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(120):
        t = text("en" if i % 2 else "de", i)
        rows.append((i, t + " grumblor" if i % 6 == 0 else t, "en" if i % 2 else "de", "s", len(t)))
    passage = text("en", 999, 50)
    rows += [(200, rows[1][1], "en", "s", 1), (201, text("en", 201) + passage, "en", "s", 1), (202, passage + text("en", 202), "en", "s", 1)]
    rows += [(203, None, None, "s", None), (204, "12345 !!", "en", "s", 8), (None, text("de", 205), "de", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut(stage(spark, docs, sf_dir), "test")
        assert docs.columns == pipeline.COLUMNS
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(range(120)) | {200, 201, 202, None} == set(seen["language"])
    assert set(seen["language"]) - set(seen["toxicity"]) == {i for i in range(120) if i % 6 == 0}
    assert set(seen["toxicity"]) - set(seen["near duplicates"]) == {200}
    before, after = seen["near duplicates"], seen["repeats"]
    assert set(before) == set(after)
    changed = {i for i in after if after[i].text != before[i].text}
    assert changed == {202} and after[201].text == before[201].text and all(after[i].n_chars == len(after[i].text) < len(before[i].text) for i in changed)
    packed = pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(after)


def test_run_keeps_the_last_table_only(spark, sf_dir):
    """What the stages write goes when the stage after it has been written."""
    top = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(top.iterdir())
    assert pipeline.run(spark, sf_dir).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before}
    assert left == {"stage-repeats"}


def test_near_copy_with_changed_words_goes(spark):
    """A copy with two words of 150 changed: fingerprints of three-word shingles may be many bits apart."""
    rows = []
    for i in range(12):
        words = text("en", 500 + i, 150).split()
        near = [*words[:20], "other", *words[21:120], "another", *words[121:]]
        rows += [(2 * i, " ".join(words), "en", "s", 1), (2 * i + 1, " ".join(near), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == pipeline.COLUMNS
    assert {r.doc_id for r in got.collect()} == {2 * i for i in range(12)}


def test_replacement_characters_of_a_text_stay(spark):
    """Only a character that a cut edge parts goes, not a U+FFFD that the text has of its own."""
    shared, a, b = text("en", 998, 50)[:220], "\ufffd odd \ufffd " + text("de", 600, 30), text("de", 601, 30) + " \ufffd"
    rows = [(1, a + "\u00e9" + shared), (2, b + "\u00e8" + shared), (3, "plain \ufffd"), (0, "start " + shared)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pipeline.drop_repeats(spark, docs, "").collect()}
    assert {i: r.text for i, r in got.items()} == {0: "start " + shared, 1: a + "\u00e9", 2: b + "\u00e8", 3: "plain \ufffd"}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_whole_characters():
    raw = "aé€😀z".encode()
    for low in range(len(raw) + 1):
        for high in range(low, len(raw) + 1):
            assert pipeline.suffixes.whole_characters(raw[low:high]).decode() == raw[low:high].decode(errors="ignore")
