"""Every registered query of the subpackage over one small set of tables, held against its contract by plain Python."""

import hashlib
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
import re
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quartzlake.llm import language, queries

SF = "/root/testdata/sf0.001"
SPECIAL = [None, "", " \n\t", "12 34 !", "Two words", "x" * 450, "\U0001f600é" * 90 + " end", "a b c d e f g h i j k l m n."]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables with a few rows more: null, empty, letterless and one-word texts, each twice."""
    out = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = 1 + docs.agg(F.max("doc_id")).first()[0]
    more = [(first + i, t, None, None, None) for i, t in enumerate(SPECIAL * 2)]
    more = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*(F.col(c).cast(k) for c, k in docs.dtypes))).withColumn("words", F.lit("clash")).repartition(5).write.parquet(f"{out}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    first = 1 + pages.agg(F.max("page_id")).first()[0]
    more = spark.createDataFrame([(first + i, "http://a.example/", h) for i, h in enumerate([None, "", "x" * 99, "x" * 99, "é" * 50, "é" * 50])], "page_id long, url string, html string")
    pages.select("page_id", "url", "html").unionByName(more).repartition(3).write.parquet(f"{out}/pages.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()}


def rows_of(spark, sf_dir, name, columns):
    """The rows of a query by identifier, after a look at the columns that the contract names."""
    found = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(found.dtypes)
    assert {c: kinds[c] for c in columns} == columns
    return found.collect()


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op1(spark, sf_dir):
    got = rows_of(spark, sf_dir, "op1_warc", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    want = {}
    for k, raw in pages.items():
        again = len(raw) >= 100 and first[raw] != k
        want[k] = (len(raw), sha(raw), "revisit" if again else "response", first[raw] if again else None)
    assert len(got) == len(pages) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_op2(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op2_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in texts}
    learned = {v for k, v in lang.items() if v and not held[k]}
    assert sorted(r.doc_id for r in got) == list(texts)
    for r in got:
        assert r.held_out == held[r.doc_id] and 0 <= r.score <= 1
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert r.lang_pred in learned if letters else r.lang_pred == language.UNDETERMINED
    seen = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != language.UNDETERMINED]
    assert seen and sum(seen) >= 0.85 * len(seen)


def fingerprint(text):
    """By the contract's words, with the xxhash library."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = Counter(b for p in pieces for h in [xxhash.xxh64(p.encode(), seed=42).intdigest()] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(pieces))


def test_op3(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op3_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    fp, least = {k: fingerprint(t) for k, t in texts.items()}, {k: k for k in texts}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert len(got) == len(fp) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{fp[k]:016x}", least[k]) for k in fp}


def test_op4(spark, sf_dir, texts):
    kinds = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    got = rows_of(spark, sf_dir, "op4_fingerprint", kinds)
    ids, by_text = list(texts), {}
    assert sorted(r.doc_id for r in got) == ids
    for r in got:
        text, after = texts[r.doc_id] or "", texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited.encode()))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    long = [r for r in got if r.n_chars >= 400]
    assert sum(r.near_edited for r in long) > 0.5 * len(long) and sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def test_op5(spark, sf_dir, texts):
    got = {r.doc_id: r for r in rows_of(spark, sf_dir, "op5_suffixes", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    n = Counter(hash(b[i : i + 200]) for b in raw.values() for i in range(len(b) - 199))
    assert list(sorted(got)) == list(raw)
    for k, b in raw.items():
        gone, end, spans = bytearray(len(b)), 0, 0
        for i in range(len(b) - 199):
            if n[hash(b[i : i + 200])] > 1:
                spans += not end or i > end
                end = i + 200
                gone[i:end] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(b), sum(gone), spans, sha(kept)), k


def test_op6(spark, sf_dir, texts):
    kinds = {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}
    got = rows_of(spark, sf_dir, "op6_quality", kinds)
    assert sorted(r.doc_id for r in got) == list(texts)
    for r in got:
        words = WORD.findall(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words))) and not (r.base_failed and r.kept)


def test_op7(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op7_sstable", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    code, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for k, t in texts.items():
        ids = code.encode(t or "", add_special_tokens=False).ids + [2]
        want[k] = (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(want) and {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want


def test_op8(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op8_wordjoin", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    from tiktoken.load import load_tiktoken_bpe

    code = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for k, t in texts.items():
        ids = code.encode_ordinary(t or "")
        want[k] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_op9(spark, sf_dir, texts):
    got = rows_of(spark, sf_dir, "op9_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in got) == list(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [r.predicted == toxic[r.doc_id] for r in got if r.held_out and toxic.get(r.doc_id) is not None]
    assert right and sum(right) >= 0.9 * len(right)


def test_op10(spark, sf_dir, texts):
    kinds = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    got = rows_of(spark, sf_dir, "op10_packing", kinds)
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: code.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    at = {k: 0 for k in ids}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert (r.start, r.doc_tokens, r.ids_crc32) == (at[r.doc_id], len(own), crc(own[r.start : r.start + r.length])) and r.length > 0
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in ids.items()}
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in ends.values())
    assert max(ends.values()) <= 1024 and padding <= 0.05 * sum(ends.values())
