"""WARC archives: an index of every record first, then coalesced byte-range reads of the records that are wanted.

`write_archives` writes one gzip member per record (so that any record can be read alone) and returns the index: file,
offset, length, URL, digest of each record. `read_records` sorts index rows by place, merges neighbours into ranges of
bounded size and reads each range once.

Defined cases: a null payload is empty; payloads of at least MIN_REVISIT bytes that are equal make one response (the
smallest id) and revisits; a null URL is written as `urn:id:<id>`; rows with one id twice are two records; a null id
sorts first and is written as an empty field; an empty table gives an empty index; further columns of the input are
dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, joined, new_dir

MIN_REVISIT = 100
#: A range read spans at most RANGE_BYTES, over gaps of at most GAP_BYTES.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of archive that a reading task takes.
TASK_BYTES = 64 << 20
INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url if url is not None else f'urn:id:{page_id}').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    ident = lambda name: int(v) if (v := fields[name][len("<urn:page:") : -1]) else None
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return {
        "page_id": ident("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": ident("WARC-Refers-To") if revisit else None,
    }


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and, for revisits, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    light = rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    # written, so that Spark can split a payload that a third of all pages have
    first = light.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    first = cut(first, "first-pages")
    revisits = cut(light.join(first, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct(), "revisits")
    return joined(rows, revisits, ["page_id", "payload_digest"], "left")


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a record for each row into archives in the shared folder; return the index as a written table."""
    root = new_dir(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pafs.FileSystem.from_uri(root)
        store.create_dir(at, recursive=True)
        name = f"{at}/part-{uuid.uuid4().hex}.warc.gz"
        out, place = None, 0
        for batch in batches:
            rows = batch.to_pydict()
            found = {"file": [], "offset": [], "length": [], "record_type": []}
            for page_id, url, payload, size, digest, refers in zip(*(rows[k] for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")), strict=True):
                out = out or store.open_output_stream(name, compression=None)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeeze.compress(_record(page_id, url, payload, size, digest, refers)) + squeeze.flush()
                out.write(data)
                for k, v in zip(found, (name, place, len(data), "response" if refers is None else "revisit"), strict=True):
                    found[k].append(v)
                place += len(data)
            col = batch.column
            yield pa.RecordBatch.from_arrays(
                [col("page_id"), col("url"), pa.array(found["file"], pa.string()), pa.array(found["offset"], pa.int64()), pa.array(found["length"], pa.int64()), col("payload_bytes"), col("payload_digest"), pa.array(found["record_type"], pa.string()), col("refers_to")],
                names=["page_id", "url", "file", "offset", "length", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
        if out:
            out.close()

    return cut(plan_records(pages).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the records of these index rows back, in few sorted range reads."""
    root = new_dir(index.sparkSession, "unused")  # names the file system that the archives are on

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(os.path.dirname(root))
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        name, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True))
            start = 0
            while start < len(places):
                file, low, size = places[start]
                end, high = start + 1, low + size
                while end < len(places) and places[end][0] == file and places[end][1] - high <= GAP_BYTES and places[end][1] + places[end][2] - low <= RANGE_BYTES:
                    high = places[end][1] + places[end][2]
                    end += 1
                if file != name:
                    name, source = file, store.open_input_file(file)
                data = source.read_at(high - low, low)
                yield pa.RecordBatch.from_pylist([_parse(zlib.decompress(data[o - low : o - low + n], 31)) for _, o, n in places[start:end]], schema=schema)
                start = end

    placed = index.select("file", "offset", "length")
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    return placed.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)
