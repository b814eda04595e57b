"""Token ids of whole texts, with a bounded memory of words in each Python worker.

A byte-level BPE merges inside pre-tokens only, and where single spaces or line feeds stand between other characters a
pre-token starts at each of them. A text of such spacing is therefore the concatenation of its words' ids, each word
with the space or line feed before it, and a batch of texts needs the library once for each distinct word. Texts with
any other spacing go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import free_memory

#: Words that a worker remembers (about 200 bytes each); when they are so many, it keeps those of the texts at hand only.
MEMORY_WORDS = 500_000
#: Bytes of text that are encoded together, and words in one call of the library.
BATCH_BYTES, CALL_WORDS = 16 << 20, 1000
# White space besides space and line feed. With these, or two in a row, or one at an end, a text is not cut into words.
IRREGULAR = r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"


@cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


class TextEncoder:
    """Ids as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.path, self.memory = path, {}
        self.feed = self.whole("\n")

    def whole(self, text: str) -> np.ndarray:
        return np.array(_library(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without a line feed, from one call: line feeds part them, and a line feed's id parts the ids."""
        ids = self.whole("\n".join(words))
        ends = np.flatnonzero(ids == self.feed[0])
        if len(self.feed) != 1 or len(ends) != len(words) - 1:
            return [self.whole(w).tobytes() for w in words]
        raw, places = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
        return [raw[4 * a + 4 : 4 * b] for a, b in zip(places, places[1:], strict=False)]

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; one that starts with a line feed has none before it, the others have a space."""
        fresh = [w for w in words if w not in self.memory]
        if len(self.memory) + len(fresh) > MEMORY_WORDS:
            self.memory = {w: self.memory[w] for w in words if w in self.memory}
        feed = self.feed.tobytes()
        for at in range(0, len(fresh), CALL_WORDS):
            some = fresh[at : at + CALL_WORDS]
            ids = self._words([w[1:] if w[0] == "\n" else " " + w for w in some])
            self.memory.update((w, feed + i if w[0] == "\n" else i) for w, i in zip(some, ids, strict=True))
        return list(map(self.memory.__getitem__, words))

    def _regular(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts of regular spacing. A line feed is put before each, as a first word is like one after a line feed."""
        parted = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = parted.values.dictionary_encode()
        known, which = self._known(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        flat, length = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(length) - length
        own = length[which]
        after = np.cumsum(own)
        ids = flat[np.repeat(start[which] - (after - own), own) + np.arange(after[-1])]
        ends = np.append(0, after)[parted.offsets.to_numpy()]
        return [ids[a + len(self.feed) : b] for a, b in zip(ends, ends[1:], strict=False)]

    def _batch(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        regular = pc.invert(pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.equal(texts, "")))
        words = iter(self._regular(texts.filter(regular)) if pc.any(regular).as_py() else [])
        return [next(words) if r else self.whole(t.as_py()) for r, t in zip(regular.to_pylist(), texts, strict=True)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null is empty."""
        texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
        after, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
        while start < len(texts):
            before = after[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(after, before + BATCH_BYTES, side="right")))
            yield from self._batch(texts.slice(start, end - start))
            start = end


def forget(path: str) -> None:
    """Empty the memory of this worker's encoder at the end of a task: workers live on, and other stages need the room."""
    encoder(path).memory.clear()
    free_memory()


@cache
def encoder(path: str) -> TextEncoder:
    """One encoder, and so one memory, for each file and Python worker."""
    return TextEncoder(path)
