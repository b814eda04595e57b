import gzip
import hashlib

import pyarrow.fs as pafs

from quartzlake.llm import shared, warc


def brute(rows):
    first, out = {}, []
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    for i, b in raw:
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, b in raw:
        refers = first.get(b) if i is not None and first.get(b, i) < i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/5", "x" * 100), (3, "http://a/3", "x" * 100), (9, "http://a/9\r\nInjected: 1", "x" * 100), (4, None, "y" * 99), (6, "u", "y" * 99), (7, "u", None), (8, "u", ""),
    (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "é\U0001f600" * 5000), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "é\U0001f600" * 5000), (None, "u", "z" * 200), (12, "u", "z" * 200), (12, "u", "other" * 40), (20, "u", "w" * 3_000_000),
]


def test_round_trip(spark, monkeypatch):
    pages = spark.createDataFrame([(*r, "q") for r in ROWS], "page_id long, url string, html string, payload string").repartition(4)
    for gap, most, broadcast in ((64 << 10, 8 << 20, 4 << 20), (0, 1, 0)):
        monkeypatch.setattr(warc, "GAP_BYTES", gap)
        monkeypatch.setattr(warc, "RANGE_BYTES", most)
        monkeypatch.setattr(shared, "BROADCAST_BYTES", broadcast)
        index = warc.write_archives(pages)
        got = warc.read_records(index).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
        assert all(r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes for r in got)


def test_archives_are_plain_gzip_members(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1))
    name = index.first().file
    with pafs.LocalFileSystem().open_input_file(name) as f:
        whole = gzip.decompress(f.read())
    assert whole.count(b"WARC/1.1\r\n") == 4 and b"\r\nInjected" not in whole


def test_some_records_and_none(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    index = warc.write_archives(pages)
    assert {r.page_id for r in warc.read_records(index.where("page_id IN (3, 20)")).collect()} == {3, 20}
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0
