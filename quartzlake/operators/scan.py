"""Folds over sorted sequences: a state that feeds on its own results is carried along the rows of a key, in order.

Spark shuffles the rows by key and sorts them inside the tasks (spilling to disk); a task reads them once, batch by batch, and the
state passes from batch to batch. So a key is never held whole, many small keys cost no call each, and memory is one batch and one state.
A fold is sequential by nature: the rows of one key go through one task, as a stream.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

KINDS = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "decimal(38)": pa.decimal128(38, 0)}


def folded(rows: DataFrame, keys: list[str], order: list[str | Column], inputs: list[str], start: Callable, outputs: str) -> DataFrame:
    """rows with further columns: for each key `start()` gives a function that takes the inputs of a row and returns its outputs.

    outputs is the schema of the added columns (their types are those of KINDS). Rows of equal order keep no fixed order: give an order that is total. Nulls are a key
    of their own. An empty table stays empty."""
    added, kinds = zip(*(c.split() for c in outputs.split(",")), strict=True)
    names = [*rows.columns, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, step = None, None
        for batch in batches:
            found = []
            whose = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)
            for key, row in zip(whose, values, strict=True):
                if step is None or key != held:
                    held, step = key, start()
                found.append(step(*row))
            columns = zip(*found, strict=True) if found else ([] for _ in added)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, KINDS[k]) for c, k in zip(columns, kinds, strict=True))], names=names)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{own}, {outputs}")


class VerdictChain:
    """The verdict of a bar, and the last close that was CLEAN itself, with which the next one is compared.

    A bar that fails a fatal rule is REJECTED, one that fails a warning or moves too far from the reference is REVIEW_REQUIRED; neither
    becomes the reference. Without a positive reference, and for a bar without a close, nothing is compared; with `zero` a reference
    of zero is compared too, from which every close is infinitely far. A second bar of
    a day and source is a duplicate; the state holds the sources of one day only."""

    def __init__(self, most: float, zero: bool = False):
        self.most, self.zero, self.last, self.day, self.sources = most, zero, None, None, set()

    def __call__(self, day, source, close, fatal, warned, explained) -> tuple[str, bool, bool, float | None]:
        if day != self.day:
            self.day, self.sources = day, set()
        duplicate = source in self.sources
        self.sources.add(source)
        known, reference = self.last is not None and (self.last > 0 or self.zero and self.last == 0) and close is not None, self.last
        outlier = known and (self.last == 0 or abs(close - self.last) / self.last * 100 > self.most) and not explained
        status = "REJECTED" if fatal or duplicate else "REVIEW_REQUIRED" if warned or outlier else "CLEAN"
        if status == "CLEAN":
            self.last = close
        return status, outlier, duplicate, reference


class Limiter:
    """A bucket of so many calls in a window, whose further calls wait, virtually, until the oldest one leaves it.

    The state is at most `most` times: those of the calls in the window, the ones that wait at the time at which they get through."""

    def __init__(self, most: int, window: int):
        if most < 1:
            raise ValueError("a limiter lets one call through at least")
        self.most, self.window, self.times, self.total = most, window, deque(), 0

    def __call__(self, at: int) -> tuple[bool, int, int]:
        while self.times and self.times[0] <= at - self.window:
            self.times.popleft()
        wait = 0
        if waits := len(self.times) == self.most:
            through = self.times.popleft() + self.window
            wait = max(0, through - at)
        self.times.append(through if waits else at)
        self.total += wait
        return waits, wait, self.total


class Trailing:
    """The share of the values among the last `window` rows that are at most the row's own; nulls (and NaN) take a place and have no share.

    The state is the window twice, in order of rows and in order of values; a row is an insertion and a removal by bisection."""

    def __init__(self, window: int):
        self.window, self.rows, self.values = window, deque(), []

    def __call__(self, value) -> tuple[float | None]:
        value = None if value != value else value
        if len(self.rows) == self.window and (gone := self.rows.popleft()) is not None:
            del self.values[bisect_left(self.values, gone)]
        self.rows.append(value)
        if value is None:
            return (None,)
        insort(self.values, value)
        return (bisect_right(self.values, value) / len(self.values),)


def trailing_share(rows: DataFrame, key: str, order: str, column: str, window: int, name: str) -> DataFrame:
    """rows with the share of `column` among the last `window` rows of its key."""
    return folded(rows, [key], [order], [column], lambda: Trailing(window), f"{name} double")


class Averages:
    """Exponential averages of several spans, each from the first value on, null before its least number of rows."""

    def __init__(self, spans: tuple[int, ...], least: dict[int, int]):
        self.rules, self.at, self.n = [(2.0 / (s + 1), least.get(s, 1)) for s in spans], [None] * len(spans), 0

    def __call__(self, value) -> tuple:
        self.n += 1
        self.at = [value if a is None else a if value is None else a + (value - a) * w for a, (w, _) in zip(self.at, self.rules, strict=True)]
        return self.n, *(a if self.n >= least else None for a, (_, least) in zip(self.at, self.rules, strict=True))
