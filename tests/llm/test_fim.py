"""The bit vectors against plain lists of tokens, and the operator over odd texts."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quartzlake.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ 1\n.é漢\U0001f600"), max_size=60) | st.integers(1, 1600).map(lambda n: "x" * n), max_size=6))
def test_bits_equal_token_lists(texts):
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    tokens, points = (fim.Bits(m, starts) for m in fim.boundaries(np.frombuffer(b"".join(raw), np.uint8), starts))
    lists = [TOKEN.findall(t) for t in texts]
    assert tokens.totals().tolist() == [len(x) for x in lists]
    for share in (0, 0.4, 0.9, 1):
        k = np.array([int(share * len(x)) for x in lists], np.int64)
        cuts = tokens.select(k)
        assert cuts.tolist() == [len("".join(x[:i]).encode()) for x, i in zip(lists, k, strict=True)]
        assert points.rank(cuts).tolist() == [len("".join(x[:i])) for x, i in zip(lists, k, strict=True)]


def plainly(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    t = TOKEN.findall(text)
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = ("".join(x) for x in (t[:a], t[a:b], t[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    spm = h4 % 100 < 20
    return doc_id, len(t), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_operator_equals_plain_python(spark):
    texts = [None, "", " ", "a", "one two", "<", "<P", "a <S> b", "x<P>", "é漢 \U0001f600" * 300, "word " * 30_000, "<M", "<S<S", "P>S>M>", "A1b2\n\n"]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts * 12)] + [(None, "no id here", "clash", 7), (3, "a", "clash", 7), (3, "a", "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    found = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r)[:6] for r in found.collect()), key=str)
    assert got == sorted((plainly(i, t) for i, t, _, _ in rows), key=str)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in found.collect()) == sorted(t or "" for _, t, _, _ in rows)


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
