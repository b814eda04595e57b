import re
from collections import Counter

from quartzlake.llm import quality

TEXTS = [
    None, "", "  \n\t", "one two three.", "A clean line of prose with ten words and an end. " * 3, "x # y * z | a & b < c > d $ e % f g h",
    "a b c d e " * 4, "a b c d e f g h i j k l m n a b c d e o p q r s t", "a a a a a a b c d e f g h i j k l", "Same line here now.\nSame line here now.\n\nSame line here now.\nOther line is here today.",
    "HELLO!! THERE!! ALL!! OF!! YOU!!\nLOUD!! WORDS!! EVERY!! WHERE!! NOW!!", "home | about | contact | more | help\nThis is the one good line that we keep here.",
    "All rights reserved.\nThe rest of this text is plain prose that nobody would want to remove at all.", "Öl müßte größer sein als die anderen Öle dort drüben.\nÉté   x y", "no end here at all\n" * 2 + "word " * 30,
    "\U0001f600 smile " * 6 + "done.", " ".join(f"w{i}" for i in range(30000)) + ".", "x\r\ny z\x0bq\x0cr",
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def measured(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string").repartition(3)
    return {r.doc_id: r for r in quality.measure(docs).collect()}


def test_base_columns(spark):
    for i, r in measured(spark, TEXTS).items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(TEXTS[i]), TEXTS[i]


def test_verdicts(spark):
    prose = "The river runs past the old mill and into a wide green valley."
    cases = {
        prose: True, f"{prose}\nNobody has crossed its stone bridge": True, "home | about | contact | more | help | news\n" * 1 + "a | b | c | d | e | f | g": False,
        "HELLO!! THERE!! ALL!! OF!! YOU!! LOUD!! WORDS!! EVERY!! WHERE!! NOW!!": False, "Of%%% the*** and$$$ with### from&&& those%%% who*** came$$$ to### us&&&": False,
        "Log in\nSign up\nAll rights reserved.\nShare this page\nClick here to read more of it now": False,
    }
    got = measured(spark, list(cases))
    assert [got[i].kept for i in range(len(cases))] == list(cases.values())
    other = "Nobody has crossed its stone bridge since the last flood of spring."
    mixed = measured(spark, [f"{prose}\nhome | about | contact | more\n{other}"])[0]
    assert mixed.clean_text == f"{prose}\n{other}" and mixed.kept


def test_empty_table(spark):
    assert quality.measure(spark.createDataFrame([], "doc_id long, text string")).count() == 0
