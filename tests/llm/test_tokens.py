import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quartzlake.llm import packing, sstable, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " a", "a ", "a  b", "a\n\nb", "a\tb", "a b", "x\n y", "it's 'tis  \n", "\n", "a\nb", "\nb", "don't we'll\nI'm 12 34,5",
    "x <|endoftext|> y", "　一 \U0001f600x", "a\x1cb c", "one two three " * 3000, "Zu keität schön. " * 50, "same", "same",
]


def ids(text):
    return tokens._library(PATH).encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i * 3 % 19 if i < 19 else i - 19, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)


def test_words_give_the_ids_of_the_whole_text(monkeypatch):
    texts = [*TEXTS, *(f"a{chr(c)}b c" for c in (9, 11, 12, 13, 28, 31, 133, 160, 5760, 8192, 8202, 8232, 8233, 8239, 8287, 8203, 12288, 65279))]
    for limit, size in ((1_000_000, 1 << 20), (3, 1 << 20), (1_000_000, 10)):
        monkeypatch.setattr(tokens, "MEMORY_WORDS", limit)
        monkeypatch.setattr(tokens, "BATCH_BYTES", size)
        encoder = tokens.TextEncoder(PATH)
        for _ in range(2):
            assert [i.tolist() for i in encoder.encode(pa.array(texts, pa.string()))] == [ids(t) for t in texts]
    assert list(encoder.encode(pa.array([], pa.string()))) == []


def test_shards_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    got = sorted(map(tuple, sstable.read_shards(sstable.write_shards(docs, PATH, 2)).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text in sorted(((r.doc_id, r.text or "") for r in docs.collect())):
        own = np.array([*ids(text), 2], "<u4")
        want.append((doc_id, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert got == want


def test_lookup(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    monkeypatch.setattr(sstable, "BLOCK_BYTES", 500)

    store, name = pafs.LocalFileSystem(), str(tmp_path / "x.sst")
    writer = sstable.ShardWriter(store.open_output_stream(name))
    kept = [(None, [1]), *((i * 3 - 9, list(range(i % 7))) for i in range(5000)), (15000, [70000, 5]), (15000, [6])]
    for doc_id, own in kept:
        writer.add(sstable.key_of(doc_id), np.array(own, "<u4"))
    writer.close()
    reader = sstable.ShardReader(store.open_input_file(name))
    assert [(sstable.id_of(k), v.tolist()) for k, v in reader.scan()] == kept
    assert len(reader.blocks) > 1
    for doc_id in (None, -9, 0, 3, 14985, 14986, 15000, -10, 10**12):
        assert [v.tolist() for v in reader.get(sstable.key_of(doc_id))] == [v for k, v in kept if k == doc_id]


def check_packing(rows, want, max_tokens=1024, max_segments=64):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, sequence, offset in rows:
        by_doc[doc_id].append((start, length, crc, total))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(want)
    for doc_id, own in want.items():
        at = 0
        for start, length, crc, total in sorted(by_doc[doc_id]):
            assert start == at and length > 0 and total == len(own) and crc == zlib.crc32(own[start : start + length].tobytes())
            at += length
        assert at == len(own)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_tokens and len(parts) <= max_segments
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    assert padding == 0


def test_packing(spark):
    docs = spark.createDataFrame([(i * 7 - 20, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)
    want = {i * 7 - 20: np.array([*ids(t), 0], "<u4") for i, t in enumerate(TEXTS)}
    check_packing(packing.pack(docs, PATH, 0).collect(), want)
    assert packing.pack(docs.limit(0), PATH, 0).count() == 0


@pytest.mark.parametrize("segments, loss", [(4, 1024), (64, 1024), (3, 300)])
def test_limits(segments, loss):
    rng = np.random.default_rng(1)
    docs = {i: rng.integers(0, 9, n).astype("<u4") for i, n in enumerate([*rng.integers(1, 12, 500), *rng.integers(1, 3000, 60)])}
    packer = packing.Packer(0, max_segments=segments, max_loss=loss, buffer=50)
    for i, own in docs.items():
        packer.add(i, own, loss_from=len(own) // 2)
    packer.finish()
    rows = packer.take()
    check_packing(rows, docs, max_segments=segments)
    borne = defaultdict(int)
    for doc_id, start, length, _, total, sequence, _ in rows:
        borne[sequence] += max(0, start + length - max(start, total // 2))
    assert max(borne.values()) <= loss


def test_a_full_memory_keeps_the_words_at_hand(monkeypatch):
    """Over its bound, the encoder gives only words to the library that it has not met; ids are those of whole texts."""
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 60)
    own, asked = tokens.TextEncoder(PATH), []
    plain = own._words
    monkeypatch.setattr(own, "_words", lambda words: asked.extend(words) or plain(words))
    texts = [" ".join(f"w{k}" for k in range(at, at + 50)) for at in (0, 20, 40, 60)]
    for n, text in enumerate(texts):
        before = len(asked)
        (ids,) = own.encode(pa.array([text]))
        assert ids.tolist() == own.whole(text).tolist()
        assert len(own.memory) <= 60 and (n == 0 or len(asked) - before <= 22)  # 20 more, and the first word as one after a line feed
