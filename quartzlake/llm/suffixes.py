"""Exact removal of repeated byte strings, by a logarithmic family of sparse suffix arrays.

Every string of LENGTH bytes has an anchor: the least of its KMER-byte substrings by hash, the leftmost of equals. Equal
strings have equal anchors at equal offsets, so it is enough to index the suffixes that start at anchors (about one
byte in 80). The strings of one anchor are its run. A row of an array is a suffix: hash h of its first KMER bytes, hash c of
its whole run, how often that run stands in the batch, and the first place where it does; an array is sorted by (h, c), so
suffixes that match over KMER bytes are neighbours, and those that match over the whole run are one row.

Documents come in batches. A batch gets an array of its own, is merge-scanned against every array there is (a sort-merge
join), which tells how far each suffix matches, and arrays of equal rank are merged, so that a suffix is rewritten a
logarithmic number of times. Suffixes of one anchor are ordered by the hash of their run, not by their bytes: the scan
needs equal neighbours, not the lexicographic order.

A run that is found twice is repeated whole. At the ends of a match, where anchors are equal and runs are not, blocks of
strings are compared: a block whose common core is nowhere else has no repeated string, one that is elsewhere as a whole
has nothing else, and only the strings of the blocks between are compared one by one. Strings are equal if h and a second
64-bit hash of them are, 128 bits. Texts are shuffled once, into buckets by row, and later steps read them from there.

With keep_first the first occurrence of each string stays: that of the smallest doc_id (null last), then of the first row,
then of the smallest place.

Defined cases: null texts are empty; texts shorter than LENGTH bytes are kept whole; rows with one doc_id twice are two
documents (if equal and long enough, each repeats the other); ties between occurrences matter with keep_first only; very
long texts are hashed CHUNK bytes at a time; an empty table gives no rows; further columns are ignored, and carried ones
come back in a struct, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucketed, cut, dealing_rounds, numbered, portions, release, shuffle_parts, tidy

LENGTH, KMER = 200, 40
#: Least number of batches, and bytes of text in one; more text makes more batches.
BATCHES, BATCH_BYTES = 4, 16 << 30
#: Bytes that are hashed at a time; a place among them fits PLACE_BITS.
CHUNK, PLACE_BITS = 1 << 18, 22
#: Strings in a row that are compared together before they are compared one by one.
BLOCK = 16
BASE = 0x9E3779B97F4A7C15 | 1
ANCHORS = "row long, id long, h long, c long, p int, before short, strings short, batch int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = np.full(n, BASE, np.uint64)
    step[0] = 1
    back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.multiply.accumulate(step), np.multiply.accumulate(back)


def anchors(raw: bytes, length: int = LENGTH, kmer: int = KMER) -> np.ndarray:
    """(anchor place, first string, last string) of each run of strings of one chunk with the same anchor, and the anchors' hashes."""
    x = np.frombuffer(raw, np.uint8)
    n, wide = len(x), length - kmer + 1
    if n < length:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
    power, back = _powers(1 << max(12, (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[kmer:] - total[: n - kmer + 1]) * back[: n - kmer + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    key = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    block = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - length + 1
    least = np.minimum(behind[:strings], ahead[wide - 1 : wide - 1 + strings])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:] - 1, strings - 1)
    return np.stack([place[first], first, last], axis=1), h[place[first]]


def _chunks(raw: bytes, length: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a long text that overlap by length - 1 bytes, so that each string is in one of them."""
    for at in range(0, max(1, len(raw) - length + 1), chunk):
        yield at, raw[at : at + chunk + length - 1]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def indexed(rows: DataFrame, length: int, kmer: int, batches: int, chunk: int | None = None) -> DataFrame:
    """The ANCHORS rows of rows (row, id, text): anchor hash h, run hash c, place p, strings of the run and those before p.

    A run that a chunk edge (every CHUNK bytes unless given) cuts in two gives two rows of one h and p."""
    chunk = chunk or CHUNK  # read here: workers import the module anew

    @tidy
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in found:
            for part in portions(batch):
                cols, counts = [[], [], [], [], []], []
                for text in part.column("text"):
                    raw, count = _bytes(text.as_py()), 0
                    for at, some in _chunks(raw, length, chunk):
                        runs, h = anchors(some, length, kmer)
                        c = np.fromiter((digest(some[a : b + length], p - a) for p, a, b in runs.tolist()), np.uint64, len(runs))
                        p, a, b = runs.T
                        for col, values in zip(cols, (h.view(np.int64), c.view(np.int64), p + at, p - a, b - a + 1), strict=True):
                            col.append(values)
                        count += len(runs)
                    counts.append(count)
                h, c, p, before, strings = (np.concatenate(col) if col else np.zeros(0, np.int64) for col in cols)
                owner = np.repeat(np.arange(len(counts)), counts)
                own = [part.column(k).take(pa.array(owner)) for k in ("row", "id")]
                which = part.column("row").to_numpy()[owner] % batches
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(h), pa.array(c), pa.array(p.astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(strings.astype(np.int16)), pa.array(which.astype(np.int32))],
                    names=["row", "id", "h", "c", "p", "before", "strings", "batch"],
                )

    return rows.mapInArrow(run, ANCHORS)


class ArrayFamily:
    """Arrays (h, c, n, one) of anchored suffixes in the shared folder, at most one of each rank between batches."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
        return cut(found.sortWithinPartitions("h", "c"), "suffix-level")

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index a batch (h, c, one: a place), and scan it: the h that stand in it twice, or in it and in an array before it."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._array(one.unionByName(two))))
            release(one, two)
        new = self._array(suffixes.withColumn("n", F.lit(1).cast("long")))
        again = new.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
        for _, level in self.levels:
            again = again.unionByName(new.select("h").join(level.select("h"), "h", "left_semi"))
        self.levels.append((0, new))
        return cut(again.distinct(), "suffix-scan")

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (level for _, level in self.levels))


def _blocks(raw: bytes, runs: list, length: int) -> Iterator[tuple]:
    """(h, core hash, full hash, place, first string, last string, open) of each block of the runs (h, p, before, strings, open).

    A block is BLOCK strings in a row, aligned to the anchor, so equal strings are in blocks of equal number. Its core is
    what all its strings have in common, and the full block is all their bytes."""
    digest = xxhash.xxh64_intdigest
    for r in runs:
        p, a = r["p"], r["p"] - r["before"]
        b = a + r["strings"] - 1
        for q in range((a - p) // BLOCK, (b - p) // BLOCK + 1):
            at, seed = p + q * BLOCK, q & 0xFFFFFFFFFFFFFFFF
            whole = raw[at : at + length + BLOCK - 1] if at >= 0 else b""
            full = digest(whole, seed) if len(whole) == length + BLOCK - 1 else None
            yield r["h"], digest(raw[max(0, at + BLOCK - 1) : at + length], seed), full, at, max(at, a), min(at + BLOCK - 1, b), r["open"]


def _signed(values) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


BLOCKS = "row long, id long, h long, core long, full long, at int, low int, high int, open boolean"
STRINGS = "row long, id long, h long, w long, s int, open boolean"


def _block_rows(length: int):
    @tidy
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in portions(batch):
                rows, owner = [], []
                for k, (text, runs) in enumerate(zip(part.column("text"), part.column("runs"), strict=True)):
                    rows += _blocks(_bytes(text.as_py()), runs.as_py(), length)
                    owner += [k] * (len(rows) - len(owner))
                h, core, full, at, low, high, open_ = zip(*rows, strict=True) if rows else [()] * 7
                own = [part.column(k).take(pa.array(owner, pa.int32())) for k in ("row", "id")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(h, pa.int64()), _signed(core), _signed(full), *(pa.array(v, pa.int32()) for v in (at, low, high)), pa.array(open_, pa.bool_())],
                    names=[c.split()[0] for c in BLOCKS.split(", ")],
                )

    return run


def _string_rows(length: int):
    @tidy
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in found:
            for part in portions(batch, most=1 << 20):
                h, w, s, open_, counts = [], [], [], [], []
                for text, parts in zip(part.column("text"), part.column("parts"), strict=True):
                    raw, before = _bytes(text.as_py()), len(s)
                    for r in parts.as_py():
                        places = range(r["low"], r["high"] + 1)
                        s += places
                        w += [digest(raw[k : k + length]) for k in places]
                        h += [r["h"]] * len(places)
                        open_ += [r["open"]] * len(places)
                    counts.append(len(s) - before)
                own = [part.column(k).take(pa.array(np.repeat(np.arange(len(counts)), counts))) for k in ("row", "id")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(h, pa.int64()), pa.array(np.array(w, np.uint64).view(np.int64)), pa.array(s, pa.int32()), pa.array(open_, pa.bool_())],
                    names=[c.split()[0] for c in STRINGS.split(", ")],
                )

    return run


def _repeated(rows: DataFrame, key: str, at: str, label: str) -> DataFrame:
    """h, key, first: keys of rows that stand at two places or more, and the first of these, as a written table.

    Distinct places are counted: both halves of a run that a chunk edge cut have the block that straddles the edge."""
    place = F.struct("id", "row", F.col(at).alias("at"))
    found = rows.groupBy("h", key).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return cut(found.where("first <> last").drop("last"), label)


def _open_ends(texts: DataFrame, matches: DataFrame, length: int, keep_first: bool) -> tuple[DataFrame, list[DataFrame]]:
    """row, low, high of the repeated strings where anchors are equal and runs are not, and the tables to release later."""
    place, removed = F.struct("id", "row", "at"), F.col("first").isNotNull()
    ends = matches.select("one.row", F.struct("h", "one.p", "one.before", "one.strings", (F.lit(keep_first) | (F.col("n") == 1)).alias("open")).alias("run"))
    ends = cut(ends.groupBy("row").agg(F.collect_list("run").alias("runs")), "suffix-ends")
    blocks = texts.join(ends, "row").select("row", "id", "text", "runs").mapInArrow(_block_rows(length), BLOCKS)
    blocks = cut(blocks, "suffix-blocks")
    cores = _repeated(blocks, "core", "at", "suffix-cores")
    full = _repeated(blocks.where("full IS NOT NULL"), "full", "at", "suffix-full")
    near = cut(blocks.join(cores.select("h", "core"), ["h", "core"], "left_semi").join(full, ["h", "full"], "left"), "suffix-near")
    later = removed & (place != F.col("first"))
    gone = near.where(F.col("open") & (later if keep_first else removed)).select("row", "low", (F.col("high") + length).alias("high"))
    # of equal blocks one is enough to compare with; cores of which all blocks are equal need no comparison
    rest = near.where(~later)
    several = cut(rest.groupBy("h", "core").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h", "core"), "suffix-several")
    parts = rest.join(several, ["h", "core"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("h", "low", "high", (F.col("open") & (F.lit(keep_first) | ~removed)).alias("open"))).alias("parts"))
    parts = cut(parts, "suffix-parts")
    each = cut(texts.join(parts, "row").select("row", "id", "text", "parts").mapInArrow(_string_rows(length), STRINGS), "suffix-strings")
    again = _repeated(each, "w", "s", "suffix-again")
    single = each.where("open").join(again, ["h", "w"])
    if keep_first:
        single = single.where(F.struct("id", "row", F.col("s").alias("at")) != F.col("first"))
    single = single.select("row", F.col("s").alias("low"), (F.col("s") + length).alias("high"))
    return gone.unionByName(single), [ends, blocks, cores, full, near, several, parts, each, again]


def spans(texts: DataFrame, length: int, kmer: int, batches: int, keep_first: bool) -> DataFrame:
    """row, parts: for rows (row, id, text) with strings to remove, the array of their (low, high) bytes."""
    rows = cut(indexed(texts, length, kmer, batches), "suffix-anchors")
    family = ArrayFamily()
    place = F.struct("id", "row", "p", "before", "strings").alias("one")
    scans = [family.add(rows.where(F.col("batch") == k).select("h", "c", place)) for k in range(batches)]
    again = cut(reduce(DataFrame.unionByName, scans).distinct(), "suffix-found")
    # written tables on both sides of each join, so that Spark can split an anchor that a third of all rows hold
    held = cut(family.rows().join(again, "h", "left_semi"), "suffix-held")
    release(again, *scans, *(level for _, level in family.levels))
    matches = cut(held.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("one").alias("one")), "suffix-matches")
    several = cut(matches.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "suffix-several")
    whole = rows.join(matches.where("n > 1").select("h", "c", F.col("one.row").alias("first_row"), F.col("one.p").alias("first_p")), ["h", "c"])
    if keep_first:
        whole = whole.where("row <> first_row OR p <> first_p")
    low = F.col("p") - F.col("before")
    whole = whole.select("row", low.cast("int").alias("low"), (low + F.col("strings") - 1 + length).cast("int").alias("high"))
    single, tables = _open_ends(texts, matches.join(several, "h", "left_semi"), length, keep_first)
    found = whole.unionByName(single).groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    found = cut(found, "suffix-spans")
    release(rows, held, matches, several, *tables)
    return found


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching parts."""
    out: list[list[int]] = []
    for low, high in sorted(parts):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def whole_characters(part: bytes) -> bytes:
    """A part of valid UTF-8 without the characters that were cut in two at its ends."""
    low, high = 0, len(part)
    while low < high and part[low] & 0xC0 == 0x80:
        low += 1
    lead = high - 1
    while lead > low and part[lead] & 0xC0 == 0x80:
        lead -= 1
    if low < high and lead + (1 if part[lead] < 0x80 else 2 if part[lead] < 0xE0 else 3 if part[lead] < 0xF0 else 4) > high:
        high = lead
    return part[low:high]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, kmer: int = KMER, batches: int | None = None, kept: bool = True, carry: tuple[str, ...] = (), characters: bool = False, keep_first: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay, if asked for) and a struct of the carried columns.

    With characters, kept is without the characters that were cut in two; the other columns are by bytes all the same."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rounds = dealing_rounds(size)
    rows = docs.select(
        numbered(text, rounds).alias("row"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id") if keep_first else F.lit(0).cast("long").alias("id"),
        doc_id.alias("own_id"), text.alias("text"), (F.struct(*carry) if carry else F.lit(0)).alias("carry"),
    )
    schema = T.StructType.fromDDL(RESULT).add(rows.schema["carry"])
    rows = bucketed(rows, "row", "suffix-texts", shuffle_parts(docs.sparkSession, size), rounds)
    found = spans(rows.where(F.octet_length("text") >= length).select("row", "id", "text"), length, kmer, batches or max(BATCHES, math.ceil(size / BATCH_BYTES)), keep_first)

    @tidy
    def close(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for part in portions(batch):
                out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for text, parts in zip(part.column("text"), part.column("parts"), strict=True):
                    raw, cuts = _bytes(text.as_py()), merged([(x["low"], x["high"]) for x in parts.as_py() or []])
                    stay = [raw[a:b] for a, b in zip([0, *(h for _, h in cuts)], [*(low for low, _ in cuts), len(raw)], strict=True)]
                    left = b"".join(stay)
                    whole = b"".join(map(whole_characters, stay)) if characters and cuts else left
                    for k, v in zip(out, (len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), whole if kept else None), strict=True):
                        out[k].append(v)
                columns = [pa.array(out[k], kind) for k, kind in zip(out, (*[pa.int64()] * 3, pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("own_id"), *columns, part.column("carry")], names=["doc_id", *out, "carry"])

    done = rows.join(found, "row", "left").select("own_id", "text", "parts", "carry").mapInArrow(close, schema)
    return done if carry else done.drop("carry")
