"""Packing of token sequences by vector bin packing.

A piece of a document has a demand of three parts: its tokens, one segment, and its loss-bearing tokens (those from
`loss_from` on; by default all). A sequence has room for MAX_TOKENS, MAX_SEGMENTS and MAX_LOSS. Whole sequences are cut
from long documents first. The remainders wait in a buffer of bounded size, and the open sequence takes the one whose
demand has the largest dot product with the room that is left, each part as a share of its limit. If none fits, the
one with the largest product is cut to fill the sequence. A sequence that cannot be filled (the last of a task, or one
that has all its segments) is parted at powers of two, lengths that need no padding.

Every task packs the documents of its own input split, so there is no shuffle; sequence ids carry the split's number.

Defined cases: null and empty texts are one piece, the end id alone; rows with one doc_id twice are packed as two
documents; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 1024, 64, 1024
#: Remainders that wait for a place.
BUFFER = 512
#: Sequences of one task have ids from its number times this.
PER_TASK = 1 << 36
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Takes documents, gives rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_id: int, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=MAX_LOSS, buffer=BUFFER):
        self.next_id, self.limits, self.size = first_id, np.array([max_tokens, max_segments, max_loss], float), buffer
        self.need = np.zeros((3, buffer))  # demand of each waiting remainder; a free slot has none
        self.held: list = [None] * buffer  # (doc_id, ids, start, loss_from)
        self.free, self.rows = list(range(buffer)), []

    @staticmethod
    def _loss(start: int, end: int, loss_from: int) -> int:
        return max(0, end - max(start, loss_from))

    def _emit(self, parts: list[tuple]) -> None:
        """parts: (doc_id, ids, start, end) of one sequence; unless it is full, it is parted at powers of two."""
        left = sum(end - start for *_, start, end in parts)
        room = offset = 0
        for doc_id, ids, start, end in parts:
            while start < end:
                if not room:
                    room, offset = (left if left == self.limits[0] else 1 << (left.bit_length() - 1)), 0
                    left, self.next_id = left - room, self.next_id + 1
                n = min(room, end - start)
                self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.next_id - 1, offset))
                room, offset, start = room - n, offset + n, start + n

    def add(self, doc_id, ids: np.ndarray, loss_from: int = 0) -> None:
        start, (tokens_, _, loss) = 0, self.limits.astype(int).tolist()
        while len(ids) - start >= tokens_ and self._loss(start, start + tokens_, loss_from) <= loss:
            self._emit([(doc_id, ids, start, start + tokens_)])
            start += tokens_
        if start < len(ids):
            while not self.free:
                self._fill()
            self._hold(self.free.pop(), doc_id, ids, start, loss_from)

    def _hold(self, slot: int, doc_id, ids, start: int, loss_from: int) -> None:
        self.held[slot] = (doc_id, ids, start, loss_from)
        self.need[:, slot] = (len(ids) - start, 1, self._loss(start, len(ids), loss_from))

    def _fill(self) -> None:
        """Fill one sequence from the buffer."""
        room, parts = self.limits.copy(), []
        while room[0] > 0 and room[1] > 0 and len(self.free) < self.size:
            score = (room / self.limits**2) @ self.need
            fits = (self.need[0] <= room[0]) & (self.need[2] <= room[2]) & (self.need[0] > 0)
            slot = int((score * fits).argmax())
            if not fits[slot]:
                slot = int(score.argmax())
            doc_id, ids, start, loss_from = self.held[slot]
            end = len(ids)
            if not fits[slot]:
                end = min(end, start + int(room[0]))
                end = min(end, max(start, loss_from) + int(room[2]))
                if end <= start:
                    break
            parts.append((doc_id, ids, start, end))
            room -= (end - start, 1, self._loss(start, end, loss_from))
            if end < len(ids):
                self._hold(slot, doc_id, ids, end, loss_from)
            else:
                self.held[slot], self.need[:, slot] = None, 0
                self.free.append(slot)
        self._emit(parts)

    def finish(self) -> None:
        while len(self.free) < self.size:
            self._fill()

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, **limits) -> DataFrame:
    """Encode doc_id, text (and loss_from, the first loss-bearing token, where there is such a column) and pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(tokenizer).encode, np.array([end_id], "<u4")
        packer = Packer(TaskContext.get().partitionId() * PER_TASK, **limits)
        names = [c.split()[0] for c in PIECES.split(", ")]

        def out():
            rows = packer.take()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

        for batch in batches:
            for doc_id, ids, loss_from in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), batch.column("loss_from").to_pylist(), strict=True):
                packer.add(doc_id, np.append(ids, end), loss_from)
            yield out()
        packer.finish()
        yield out()
        tokens.forget(tokenizer)

    loss_from = F.coalesce(F.col("loss_from").cast("long"), F.lit(0)) if "loss_from" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), loss_from.alias("loss_from"))
    return rows.mapInArrow(run, PIECES)
