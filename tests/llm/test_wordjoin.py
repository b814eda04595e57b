import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from quartzlake.llm import wordjoin

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " a", "a ", "a  b", "a\n\nb", "a\tb", "a b", "x\n y", "it's 'tis  \n", "\n", "a\nb", "\nb", "don't we'll\nI'm 12 34,5", "x <|endoftext|> y",
    "　一 \U0001f600x", "a\x1cb c", "one two three " * 2000, "Zu keität schön. " * 50, "same", "same", "Ünïcödé" * 40, "long" * 50_000 + " " + "x y " * 100_000,
]


@pytest.mark.parametrize("size", [48 << 20, 40])
def test_against_the_library(spark, monkeypatch, size):
    monkeypatch.setattr(wordjoin, "BLOCK_BYTES", size)
    monkeypatch.setattr(wordjoin, "SPAN", max(3, size >> 20))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    code = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i % 20, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, place string").coalesce(2)
    want = []
    for i, t in enumerate(TEXTS):
        ids = code.encode_ordinary(t or "")
        assert code.decode_bytes(ids) == (t or "").encode()
        want.append((i % 20, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in wordjoin.encode_decode(docs, PATH, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)


def test_empty_table(spark):
    assert wordjoin.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
