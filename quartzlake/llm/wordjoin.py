"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens are exploded with their positions, block by block: a block is some documents of one task, its distinct
pre-tokens are numbered, and a position holds a number. The numbered pre-tokens (block, number, word) are a table, the
positions a file for each block. Each distinct word of the corpus is encoded once. Its ids are exploded and joined with
the token-byte table, which has a row for each token of the vocabulary, and so decoded. Ids and bytes are joined back to
(block, number), and the documents of a block are reassembled by position.

A text is read and cut once. A block is named by the attempt of the task that made it, so the table, which holds rows of
finished attempts only, names files of those attempts only, and nothing depends on how a second reading would be split.

Defined cases: null and empty texts have no token; white space of any kind is encoded; very long texts are a block of
their own; rows with one doc_id twice are two documents, null ids too; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_dir, new_dir, portions, release, shuffle_parts, tidy, written_bytes
from .tokens import IRREGULAR

#: Bytes of text and distinct pre-tokens from which a block is full, and bits of a place (block, number) for either part.
BLOCK_BYTES, BLOCK_WORDS = 48 << 20, 500_000
NUMBER_BITS, ORDINAL_BITS, ATTEMPT_BITS = 24, 12, 27
#: Words get their ids, and blocks their documents, in so many rounds by hash; the shuffle files of one round are on disk at a time.
ROUNDS, REASSEMBLIES = 2, 4
#: Positions of a document that are put together at a time, and bytes of ids on disk for a task that does so.
SPAN, TASK_BYTES = 1 << 20, 16 << 20
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each list in their concatenation."""
    length = np.fromiter(map(len, lists), np.int32, len(lists))
    return np.cumsum(length, dtype=np.int32) - length, length


class Numbering:
    """The distinct pre-tokens of a block in order of their numbers, from 1; number 0 is the empty word, which each block has."""

    def __init__(self, pattern: str):
        self.find, self.numbers, self.pieces = regex.compile(pattern).findall, {"": 0}, {}

    def _cut_up(self, piece: str) -> list[int]:
        return [self.numbers.setdefault(w, len(self.numbers)) for w in self.find(piece)]

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces[piece] = self._cut_up(piece)
        return found

    def positions(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text the numbers at its positions.

        Where single spaces and line feeds part a text, a pre-token starts at each, so distinct pieces are cut once."""
        texts = pc.fill_null(texts, "")
        regular = pc.invert(pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(texts, "")))
        found: list = []
        if pc.any(regular).as_py():
            parted = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts.filter(regular), "\n", " \n"), ""), " ")
            coded = parted.values.dictionary_encode()
            pieces, which = [self._piece(w if w[0] == "\n" else " " + w) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy()
            start, length = _flat(pieces)
            flat = np.fromiter(chain.from_iterable(pieces), np.int32, int(length.sum()))
            own = length[which]
            after = np.cumsum(own, dtype=np.int64)
            at = flat[np.repeat(start[which] - (after - own), own) + np.arange(after[-1])]
            ends = np.append(0, after)[parted.offsets.to_numpy()]
            found = [at[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]  # without the line feed that was put before
        following = iter(found)
        return [next(following) if r else np.array(self._cut_up(t.as_py()), np.int32) for r, t in zip(regular.to_pylist(), texts, strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[list[str], list, np.ndarray, np.ndarray]]:
    """(words, doc_ids, lengths, positions) of each block of a task."""
    words, ids, found, size = Numbering(pattern), [], [], 0
    for batch in chain.from_iterable(map(portions, batches)):
        found.extend(words.positions(batch.column("text")))
        ids.extend(batch.column("doc_id").to_pylist())
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES or len(words.numbers) >= BLOCK_WORDS:
            yield list(words.numbers), ids, np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)
            words, ids, found, size = Numbering(pattern), [], [], 0
    if ids:
        yield list(words.numbers), ids, np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)


def _packed(ids: list, length: np.ndarray, positions: np.ndarray) -> bytes:
    """A block's documents and positions: a number's three bytes stand in three planes, which compress better."""
    head = pa.record_batch([pa.array(ids, pa.int64()), pa.array(length)], names=["doc_id", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as out:
        out.write_batch(head)
    head = sink.getvalue().to_pybytes()
    planes = np.ascontiguousarray(positions.astype("<u4").view("u1").reshape(-1, 4)[:, :3].T)
    return np.array([len(head)], "<u8").tobytes() + head + zstandard.compress(planes, 1)


def _unpacked(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    n = 8 + int(np.frombuffer(raw, "<u8", 1)[0])
    head = pa.ipc.open_stream(raw[8:n]).read_all().combine_chunks()
    planes = np.frombuffer(zstandard.decompress(raw[n:]), "u1").reshape(3, -1).astype("<u4")
    return head.column("doc_id").combine_chunks(), head.column("length").to_numpy(), planes[0] | planes[1] << 8 | planes[2] << 16


def _reassembled(raw: bytes, count: np.ndarray, decimal: list[str], decoded: list[bytes]) -> pa.RecordBatch:
    """The documents of a block from its positions and, by number, the ids and bytes of its words."""
    doc_ids, length, positions = _unpacked(raw)
    out, end = ([], [], []), 0
    for n in length.tolist():
        ids, text, start, end = hashlib.sha256(), hashlib.sha256(), end, end + n
        for at in range(start, end, SPAN):
            places = positions[at : min(at + SPAN, end)].tolist()
            ids.update((" " * (at > start) + " ".join(map(decimal.__getitem__, places))).encode())
            text.update(b"".join(map(decoded.__getitem__, places)))
        for column, value in zip(out, (int(count[positions[start:end]].sum()), ids.hexdigest(), text.hexdigest()), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _token_bytes(spark, ranks: str) -> DataFrame:
    """The vocabulary as a table: token and its bytes in hexadecimal digits. Its size does not depend on the corpus."""
    return spark.createDataFrame(pa.table({"token": pa.array(list(_ranks(ranks).values()), pa.int32()), "digits": [b.hex() for b in _ranks(ranks)]}))


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces) and decoded_sha256 (of the decoded bytes)."""
    spark = docs.sparkSession
    root = new_dir(spark, "positions")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @tidy
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(root)
        files.create_dir(at, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for k, (words, ids, length, positions) in enumerate(_blocks(batches, pattern)):
            if len(words) >> NUMBER_BITS or k >> ORDINAL_BITS or attempt >> ATTEMPT_BITS:
                raise ValueError("a place has too few bits for this block")
            block = attempt << ORDINAL_BITS | k
            with files.open_output_stream(f"{at}/{block:010x}", compression=None) as out:
                out.write(_packed(ids, length, positions))
            place = np.arange(len(words), dtype=np.int64) + (block << NUMBER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words, pa.string())], names=["place", "word"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, known = _encoding(ranks, pattern), _ranks(ranks)
        for batch in batches:
            raw = [w.encode() for w in batch.column("word").to_pylist()]
            ids = [[known[b]] if b in known else code._encode_single_piece(b) if b else [] for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    @tidy
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(root)
        block, count, decimal, decoded = None, [], [], []

        def finished():
            with files.open_input_file(f"{at}/{block:010x}") as source:
                return _reassembled(source.read(), np.array(count, np.int64), decimal, decoded)

        for batch in batches:
            place = batch.column("place").to_numpy()
            edges = np.flatnonzero(np.diff(place >> NUMBER_BITS)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(place)], strict=True):
                if a == b:
                    continue
                if int(place[a]) >> NUMBER_BITS != block:
                    if block is not None:
                        yield finished()
                    block, count, decimal, decoded = int(place[a]) >> NUMBER_BITS, [], [], []
                if (int(place[a]) & (1 << NUMBER_BITS) - 1, int(place[b - 1] - place[a])) != (len(count), b - a - 1):
                    raise ValueError("the words of a block are not all there")
                for found, name in ((count, "n"), (decimal, "decimal"), (decoded, "decoded")):
                    found.extend(batch.column(name).slice(a, b - a).to_pylist())
        if block is not None:
            yield finished()

    words = cut(rows.mapInArrow(explode, "place long, word string"), "block-words")
    ids = cut(words.select("word").distinct().mapInArrow(encode, "word string, ids array<int>").withColumn("key", F.monotonically_increasing_id()), "distinct-words")
    own = lambda found, k: found.where(F.pmod(F.xxhash64("word"), F.lit(ROUNDS)) == k)
    vocabulary, decimal = F.broadcast(_token_bytes(spark, ranks)), F.array_join(F.transform("ids", lambda k: k.cast("string")), " ")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "digits"))), lambda x: x["digits"])
    parts = []
    for k in range(ROUNDS):
        tokens = own(ids, k).select("key", F.posexplode_outer("ids").alias("at", "token")).join(vocabulary, "token", "left")
        by_word = tokens.groupBy("key").agg(F.array_join(ordered, "").alias("digits"))
        coded = own(ids, k).join(by_word, "key").select("word", F.size("ids").alias("n"), decimal.alias("decimal"), F.unhex("digits").alias("decoded"))
        coded = cut(coded, "coded-words")
        parts.append(cut(own(words, k).join(coded, "word").select("place", "n", "decimal", "decoded"), "placed-ids"))
        release(coded)
    release(words, ids)
    block, each = F.shiftright("place", NUMBER_BITS), shuffle_parts(spark, sum(map(written_bytes, parts)) // REASSEMBLIES, TASK_BYTES)
    done = []
    for k in range(REASSEMBLIES):
        some = reduce(DataFrame.unionByName, parts).where(F.pmod(F.xxhash64(block), F.lit(REASSEMBLIES)) == k)
        done.append(cut(some.repartition(each, block).sortWithinPartitions("place").mapInArrow(assemble, RESULT), "encoded"))
    release(*parts)
    drop_dir(spark, root)
    return reduce(DataFrame.unionByName, done)
