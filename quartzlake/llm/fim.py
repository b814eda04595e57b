"""Fill-in-the-middle rearrangement of documents, cut by rank and select over packed bit vectors.

A text is cut into tokens: a run of ASCII letters, or any other single code point. The UTF-8 bytes of a document have a bit
each, set where a token starts; the bits are packed into words of 64 and blocks of 512, and a directory holds the bits set
before each block. The popcount of a document's blocks is its number of tokens, and the byte at which its k-th token starts is
found from the directory (which block), the words and bytes of that block (which byte) and a table (which bit). So no list of
tokens is ever made. A second vector with a bit for each code point turns byte cuts into lengths in code points, by rank.

Documents of a portion share one vector, and each begins at a block of its own. Texts stay in their partition: nothing is shuffled.

Defined cases: null text is empty; empty texts, and those that contain a mark, stay as they are (plain). A null doc_id draws as an
empty one. Repeated rows draw alike and stay repeated. Cuts at the same place give an empty middle, cuts at an end an empty
prefix or suffix. A text longer than a portion is a portion of its own. An empty table gives an empty result. Further columns
are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import portions, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Draws below these percentages rearrange a document, and put the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
SEED = 1
WORD, BLOCK = 64, 512
#: Place of the k-th set bit in each byte, lowest bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_IN_BYTE = np.argsort(1 - _BITS, axis=1, kind="stable")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Bits:
    """Bits over the bytes of many documents, with counts before each block."""

    def __init__(self, marks: np.ndarray, starts: np.ndarray):
        """marks: a bool for each byte; starts: the byte at which each document starts, and at the end their total."""
        sizes = np.diff(starts)
        self.sizes, self.base = sizes, np.concatenate([[0], np.cumsum(-(-sizes // BLOCK))])
        padded = np.zeros(self.base[-1] * BLOCK, bool)
        padded[np.arange(len(marks)) + np.repeat(self.base[:-1] * BLOCK - starts[:-1], sizes)] = marks
        self.words = np.packbits(padded, bitorder="little").view("<u8").reshape(-1, BLOCK // WORD)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64))])

    def totals(self) -> np.ndarray:
        """Bits set in each document."""
        return np.diff(self.before[self.base])

    def select(self, k: np.ndarray) -> np.ndarray:
        """For each document the byte of its k-th set bit, counted from 0; its size where it has no more."""
        found, has = self.sizes.copy(), np.flatnonzero(k < self.totals())
        rank = self.before[self.base[has]] + k[has]
        block = np.searchsorted(self.before, rank, side="right") - 1
        word, rank = _pick(np.bitwise_count(self.words[block]), rank - self.before[block])
        bytes_ = self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, WORD // 8)
        byte, rank = _pick(np.bitwise_count(bytes_), rank)
        bit = _IN_BYTE[bytes_[np.arange(len(has)), byte], rank]
        found[has] = (block - self.base[has]) * BLOCK + word * WORD + byte * 8 + bit
        return found

    def rank(self, at: np.ndarray) -> np.ndarray:
        """For each document the bits set before a byte."""
        block, rest = np.divmod(at, BLOCK)
        block = np.minimum(self.base[:-1] + block, len(self.words))
        words = np.concatenate([self.words, np.zeros((1, BLOCK // WORD), "<u8")])[block]
        keep = np.clip(rest[:, None] - np.arange(0, BLOCK, WORD), 0, WORD).astype(np.uint64)
        mask = np.where(keep == WORD, ~np.uint64(0), (np.uint64(1) << (keep % np.uint64(WORD))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(words & mask).sum(1, dtype=np.int64) - self.before[self.base[:-1]]


def _pick(counts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In which column of each row of counts the bit of that rank lies, and its rank there."""
    after = np.cumsum(counts, axis=1, dtype=np.int64)
    at = (after <= rank[:, None]).sum(1)
    return at, rank - np.where(at > 0, after[np.arange(len(at)), at - 1], 0)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether a token starts there, and whether a code point does."""
    lower = data | 0x20
    letter, point = (lower >= ord("a")) & (lower <= ord("z")) & (data < 0x80), (data & 0xC0) != 0x80
    after_letter = np.concatenate([[False], letter[:-1]]) if len(data) else letter
    after_letter[starts[:-1][np.diff(starts) > 0]] = False
    return point & ~(letter & after_letter), point


def _rearranged(part: pa.RecordBatch) -> pa.RecordBatch:
    text = pc.fill_null(part.column("text"), "").cast(pa.large_string())
    marked = pc.or_(pc.or_(pc.match_substring(text, PREFIX), pc.match_substring(text, SUFFIX)), pc.match_substring(text, MIDDLE))
    starts = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    tokens, points = (Bits(marks, starts) for marks in boundaries(data, starts))
    n = tokens.totals()
    draw = [part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
    cuts = [tokens.select(pick(draw[0] % (n + 1), draw[1] % (n + 1))) for pick in (np.minimum, np.maximum)]
    plain = (n == 0) | marked.to_numpy(zero_copy_only=False) | (draw[2] % 100 >= REARRANGED)
    form = np.where(plain, "plain", np.where(draw[3] % 100 < SUFFIX_FIRST, "spm", "psm"))
    prefix_chars, upto = points.rank(cuts[0]), points.rank(cuts[1])
    raw, (p, s, m) = data.tobytes(), (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for kind, a, b, start, end in zip(form.tolist(), cuts[0].tolist(), cuts[1].tolist(), starts.tolist(), starts[1:].tolist(), strict=False):
        if kind == "plain":
            out.append(raw[start:end])
        else:
            head, middle, tail = raw[start : start + a], raw[start + a : start + b], raw[start + b : end]
            out.append(b"".join((p, head, s, tail, m, middle) if kind == "psm" else (s, tail, p, head, m, middle)))
    arrays = [part.column("doc_id"), pa.array(n), pa.array(form), pa.array(prefix_chars, mask=plain), pa.array(upto - prefix_chars, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


@tidy
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch):
            yield _rearranged(part)


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output for every row of docs (doc_id, text)."""
    digest = F.sha2(F.concat_ws("", F.lit(f"{SEED}:"), F.col("doc_id").cast("string")), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws).mapInArrow(_run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text of an output of transform. No text that is rearranged contains a mark, so each mark stands once."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
