"""Token ids in sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each task streams its documents into shards. A shard holds
data blocks (prefix-compressed keys, values of token ids, zstd), a sparse index with the first key of each block, a
Bloom filter over the keys and a footer. A key is found by binary search in the sparse index and a scan of one block.

    shard  := block* index bloom footer
    block  := zstd(entry*)            entry := varint(shared) varint(unshared) varint(len) key-bytes value
    value  := width byte (2 or 4), then the ids as little-endian unsigned integers of that width
    index  := zstd((varint(len) key varint(offset) varint(length))*)
    footer := 7 x u64 (index offset, index length, bloom offset, bloom length, hashes, entries, ids) MAGIC

Defined cases: null and empty texts have the end id alone; a null identifier sorts first; rows with one identifier twice
are two entries, in the order of their texts; an empty table gives no shard; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import cut, new_dir, tidy

MAGIC, FOOTER = b"QZSST\x01\x00\x00", struct.Struct("<7Q8s")
#: Bytes of entries in a block, bytes of blocks in a shard, bits for a key in the Bloom filter, its hashes.
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, HASHES = 64 << 10, 64 << 20, 10, 7
SHARDS = "file string, place long, shard long, entries long, ids long"


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do, null first."""
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _pack(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _unpack(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _places(key: bytes, hashes: int, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Entries in ascending order of their keys go in; `close` writes index, filter and footer."""

    def __init__(self, sink):
        self.sink, self.at, self.block, self.first, self.last = sink, 0, bytearray(), None, b""
        self.index, self.keys, self.ids, self.squeeze = bytearray(), [], 0, zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = _pack(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.ids = key, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.squeeze.compress(bytes(self.block))
            self.index += _varint(len(self.first)) + self.first + _varint(self.at) + _varint(len(data))
            self.sink.write(data)
            self.at, self.first, self.block = self.at + len(data), None, bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        bloom[[p for k in self.keys for p in _places(k, HASHES, bits)]] = True
        index, packed = self.squeeze.compress(bytes(self.index)), np.packbits(bloom).tobytes()
        self.sink.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), HASHES, len(self.keys), self.ids, MAGIC))
        self.sink.close()


class ShardReader:
    """One shard: `scan` reads all entries in order, `get` the entries of one key."""

    def __init__(self, source):
        self.source, self.open = source, zstandard.ZstdDecompressor()
        index_at, index_len, bloom_at, bloom_len, self.hashes, self.entries, self.ids, magic = FOOTER.unpack(source.read_at(FOOTER.size, source.size() - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.first, self.blocks = self.open.decompress(source.read_at(index_len, index_at)), 0, [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.first.append(raw[at : at + n])
            offset, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.blocks.append((offset, length))
        self.bloom = np.unpackbits(np.frombuffer(source.read_at(bloom_len, bloom_at), np.uint8)).astype(bool)
        self.bits = max(64, self.entries * BLOOM_BITS)

    def _entries(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.blocks[n]
        raw, at, key = self.open.decompress(self.source.read_at(length, offset)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            yield key, _unpack(raw[at + unshared : at + unshared + size])
            at += unshared + size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.blocks)):
            yield from self._entries(n)

    def get(self, key: bytes) -> list[np.ndarray]:
        if not self.bloom[_places(key, self.hashes, self.bits)].all():
            return []
        found, n = [], bisect_right(self.first, key) - 1
        while n > 0 and self.first[n] == key:  # entries of one key may start in the block before
            n -= 1
        for k in range(max(n, 0), len(self.blocks)):
            if self.first[k] > key:
                break
            found += [ids for x, ids in self._entries(k) if x == key]
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every text, append end_id, write the shards; return a written table of them, `ids_before` included."""
    root = new_dir(docs.sparkSession, "sstable")

    @tidy  # the words stay for the worker's next task, as encoding them is most of the work; only the reading of the shards comes after
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = tokens.encoder(tokenizer).encode, TaskContext.get().partitionId()
        store, at = pafs.FileSystem.from_uri(root)
        store.create_dir(at, recursive=True)
        end, shards, writer, done = np.array([end_id], "<u4"), 0, None, []

        def finish():
            writer.close()
            done.append({"file": name, "place": place, "shard": shards, "entries": len(writer.keys), "ids": writer.ids})

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                if writer is None:
                    name = f"{at}/{uuid.uuid4().hex}.sst"
                    writer = ShardWriter(store.open_output_stream(name, compression=None))
                writer.add(key_of(doc_id), np.append(ids, end))
                if writer.at >= SHARD_BYTES:
                    finish()
                    writer, shards = None, shards + 1
        if writer:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    shards = cut(ordered.mapInArrow(write, SHARDS), "shards")
    before = Window.orderBy("place", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    return shards.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, from the shard files."""
    spark = shards.sparkSession
    root = new_dir(spark, "unused")  # names the file system that the shards are on

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("ids_before").to_pylist(), strict=True):
                rows = []
                with store.open_input_file(file) as source:
                    for key, ids in ShardReader(source).scan():
                        rows.append({"doc_id": id_of(key), "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                        start += len(ids)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")]))

    tasks = max(1, math.ceil(shards.count()))
    return shards.select("file", "ids_before").repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
