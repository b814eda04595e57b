"""Product codes of vectors: 16 parts, each replaced by the index of its nearest codebook entry, in exact integers.

Components become fixed-point integers floor(256 * x). A codebook starts as the parts of the vectors with the smallest ids; each
round assigns all parts and replaces the entries by the floored means of their parts. Assignment is an exponion search: a
part starts at its entry of the round before (entry 0 in the first round), at distance u. An entry at least as near lies within
2u of that entry, so its list of other entries, sorted by distance, is scanned as far as that radius and no further. Distances
are squared integers (the test is D <= 4 * u * u), so ties are exact and go to the lower index.

A round is one pass over the vectors. A task finds the entries of earlier rounds again from their codebooks, which is cheaper than
to write vectors or codes between rounds (cost grows with the square of the rounds, of which there are few), and yields its
sums: a row for each part and entry at most, so what is shuffled and what reaches the driver has a bound, whatever the input.
Codebooks (entries * components integers) go to the tasks.

Defined cases: null vectors, and vectors with null or non-finite components, are dropped. So are those whose length is
not that of the kept vector with the smallest id or no multiple of the parts, and those with an integer beyond `reach`, for
which squared distances leave 64 bits. Null ids come last, equal ids are ordered by their vectors. With fewer vectors than
entries the codebooks are smaller. Repeated rows stay. Null labels are one group. An empty table gives an empty result.
Further columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, joined, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def reach(width: int) -> int:
    """The largest integer component at which four times the squared distance of parts of so many components stays below 2 ** 63."""
    return math.isqrt(2**61 // max(width, 1)) // 4


class Search:
    """Exponion search in one codebook: an array of entries by components."""

    def __init__(self, book: np.ndarray):
        self.book = book
        apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(apart, -1)  # each entry leads its own list
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def __call__(self, parts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part its nearest entry and the squared distance to it; start: where its search begins."""
        best, at = ((parts - self.book[start]) ** 2).sum(1), start.copy()
        within = np.empty(len(parts), np.int64)
        by_start = np.argsort(start, kind="stable")
        for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1):
            if len(rows):
                within[rows] = np.searchsorted(self.apart[start[rows[0]]], 4 * best[rows], side="right")
        order = np.argsort(-within, kind="stable")
        ends = len(parts) - np.searchsorted(np.sort(within), np.arange(1, within.max(initial=1)), side="right")
        for k, end in enumerate(ends.tolist(), 1):  # the k-th neighbour, for parts whose radius holds more than k entries
            rows = order[:end]
            entry = self.near[start[rows], k]
            apart = ((parts[rows] - self.book[entry]) ** 2).sum(1)
            better = (apart < best[rows]) | (apart == best[rows]) & (entry < at[rows])
            best[rows[better]], at[rows[better]] = apart[better], entry[better]
        return at, best


def kept(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and embedding of the vectors that can be coded, of whatever length."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = vectors.select("vec_id", "label", F.col("embedding").alias("embedding"))
    size, width = F.size("embedding"), F.size("embedding") / parts
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    fits = most < F.floor(F.sqrt(F.lit(float(2**61)) / width)) / 4 / SCALE - 1
    return found.where(F.col("embedding").isNotNull() & (size > 0) & (size % parts == 0)).where(~F.exists("embedding", odd)).where(fits)


def first_books(found: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int, list[np.ndarray]]:
    """The length of a vector, and for each part the parts of the vectors with the smallest ids; no more than `entries` rows are read."""
    order = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding")
    if not (one := order(found).first()):
        return 0, []
    rows = order(found.where(F.size("embedding") == len(one.embedding))).limit(entries).collect()
    fixed = np.floor(np.array([r.embedding for r in rows], np.float64) * SCALE).astype(np.int64)
    return fixed.shape[1], np.split(fixed, parts, axis=1)


def _fixed(batch: pa.RecordBatch, length: int, parts: int) -> list[np.ndarray]:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(np.floor(flat * SCALE).astype(np.int64).reshape(-1, length), parts, axis=1)


def _followed(part: np.ndarray, searches: list[Search]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance after a search in each codebook, in the order of the rounds."""
    at, best = np.zeros(len(part), np.int64), None
    for search in searches:
        at, best = search(part, at)
    return at, best


def fit(found: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[list[np.ndarray]]]:
    """The length of a vector, and the codebooks before and after each round: a list by part of arrays of entries by components."""
    length, books = first_books(found, parts, entries)
    history = [books]
    for _ in range(rounds if length else 0):
        before = [[h[p] for h in history] for p in range(parts)]

        @tidy
        def sums(batches: Iterator[pa.RecordBatch], before=before) -> Iterator[pa.RecordBatch]:
            searches = [[Search(b) for b in books] for books in before]
            shape = before[0][0].shape
            total, n = np.zeros((parts, *shape), np.int64), np.zeros((parts, shape[0]), np.int64)
            for batch in batches:
                for p, part in enumerate(_fixed(batch, length, parts)):
                    at, _ = _followed(part, searches[p])
                    np.add.at(total[p], at, part)
                    n[p] += np.bincount(at, minlength=shape[0])
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

        width = length // parts
        some = found.select("embedding").where(F.size("embedding") == length).mapInArrow(sums, "p long, e long, n long, s array<long>")
        whole = some.groupBy("p", "e").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
        after = [b.copy() for b in history[-1]]
        for row in whole.collect():  # parts * entries rows at most
            after[row.p][row.e] = [int(row[f"s{i}"]) // row.n for i in range(width)]
        history.append(after)
    return length, history


def encode(found: DataFrame, length: int, history: list[list[np.ndarray]], parts: int = PARTS) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distance) under the last codebooks."""
    by_part = [[h[p] for h in history] for p in range(parts)] if length else []

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [[Search(b) for b in books] for books in by_part]
        for batch in batches:
            if not batch.num_rows:
                continue
            done = [_followed(part, searches[p]) for p, part in enumerate(_fixed(batch, length, parts))]
            digits = np.stack([at for at, _ in done], axis=1).astype(np.uint8).tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in done))], names=["vec_id", "label", "code", "error"])

    kinds = dict(found.dtypes)
    return found.where(F.size("embedding") == length).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place, in decimal with commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded, written, with the error summed over the rows of a label; null labels are one group. The sums are formed in two
    steps, and joined back by broadcast while they are within the bound, so a label of a third of all rows is no burden."""
    key = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_key")]
    totals = cut(coded.select("error", *key).groupBy("no_label", "label_key").agg(F.sum("error").alias("label_error")), "label-error")
    return joined(coded.select("*", *key), totals, ["no_label", "label_key"], "inner").drop("no_label", "label_key")


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector that can be coded."""
    found = kept(vectors)
    length, history = fit(found)
    return with_label_error(cut(encode(found, length, history), "vector-codes")).withColumn("codebooks_sha256", F.lit(digest(history[-1])))
