"""Document fingerprints by a randomised edit embedding.

Shared random walks read every text: at step j the walk stands on a character c, writes it, and moves on if the shared
random bit R_j(c) is 1. Texts of small edit distance get outputs of small Hamming distance, as walks that an edit put
out of step meet again. Only a nested random sample of the steps is kept: a text of n characters uses the least level
at which about SAMPLES of its steps are sampled, and the samples of a coarser level are among those of a finer one, so
that any two fingerprints can be compared at the coarser level of both. A fingerprint is the level and a hex digit for
each sampled step, a hash of the character that the walk wrote there.

`likeness` is the share of equal digits beyond chance. `bands` bit-samples a fingerprint into keys for candidate search,
`links` verifies candidates by their likeness, and `classes` names the near copies of each document by their links. A pair
at likeness 0.8 shares one of 20 bands of nine digits with a probability of 0.98.

Defined cases: null texts are empty and have a fingerprint without digits, which is like other empty ones (1) and
unlike the rest (0); equal texts have equal fingerprints; rows with one doc_id twice follow each other in the order of
their texts; a table of one row is its own next; very long texts are walked alone; an empty table gives no rows; further
columns are ignored. Documents with a null doc_id have the class of their copies, null if none of them has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, few, portions, release, tidy

#: Period of the random bits; most samples of a text; likeness of unrelated texts' digits; characters walked at a time.
PERIOD, SAMPLES, CHANCE, CHUNK_CHARS = 4096, 256, 0.125, 4_000_000
#: So few walks are walked one by one, more of them side by side.
FEW = 48
#: Bands of a level; their digits, for fingerprints of at least and of less than so many digits; likeness of near copies.
BANDS, BAND_DIGITS, LIKE = 20, ((4, 1, 80), (9, 64, 1 << 30)), 0.8
#: Longs of a sketch, those that hold 64 digits, a bit of each in every long; bits of a band's key that hold its level.
SKETCH, PLANES, LEVEL_BITS = 20, 4, 6
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_bands int, next_bands int"
EDGE = f"{SCHEMA}, place int, last_text string, first_text string"


@cache
def _steps() -> np.ndarray:
    """(256, PERIOD): steps that a walk spends on a character that it reaches at a step."""
    bits = np.random.default_rng(7).random((256, PERIOD)) < 0.5
    bits[:, -1] = True
    spent = np.zeros((256, 2 * PERIOD + 1), np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        spent[:, j] = np.where(bits[:, j % PERIOD], 1, spent[:, j + 1] + 1)
    return np.ascontiguousarray(spent[:, :PERIOD])


@cache
def _rows() -> list[list[int]]:
    return _steps().tolist()


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


@cache
def _sampled(level: int, power: int) -> np.ndarray:
    """Steps below 2**power that are sampled at a level, ascending."""
    if level == 0:
        return np.arange(1 << power)
    finer = _sampled(level - 1, power)
    return finer[(_mixed(finer) & np.uint64((1 << level) - 1)) == 0]


def level_of(n_chars: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, 2 * n_chars) / SAMPLES))))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def walk(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks over chars[start : start + length], each from its first step: the step at which each character is reached
    (at its place in chars), and the step after the last character of each walk."""
    symbol = ((chars * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)
    reached, table, rows = np.zeros(len(chars), np.int32), _steps(), _rows()
    order = np.argsort(-lengths, kind="stable")
    start, length, at = starts[order], lengths[order], first[order].astype(np.int64)
    side = int(length[FEW - 1]) if len(length) >= FEW else 0  # characters that FEW walks still have
    counts = np.searchsorted(-length, -np.arange(side), side="left") if side else []
    flat = table.ravel()
    for i in range(side):
        k = counts[i]
        here, place = at[:k], start[:k] + i
        reached[place] = here
        here += flat[symbol[place] * PERIOD + (here & (PERIOD - 1))]
    for w in range(min(len(length), FEW)):
        if length[w] > side:
            j, own, low = int(at[w]), [], int(start[w]) + side
            for s in symbol[low : int(start[w] + length[w])].tolist():
                own.append(j)
                j += rows[s][j & 4095]
            reached[low : low + len(own)], at[w] = own, j
    ends = np.empty(len(order), np.int64)
    ends[order] = at
    return reached, ends


def digits(n_chars: int, reached: np.ndarray, chars: np.ndarray, end: int) -> str:
    """The fingerprint of one walk."""
    level = level_of(n_chars)
    if not n_chars:
        return "00:"
    steps = _sampled(level, max(12, int(end).bit_length()))
    steps = steps[: np.searchsorted(steps, end)]
    written = chars[np.searchsorted(reached, steps, side="right") - 1]
    nibble = _mixed(written.astype(np.uint64) ^ (steps.astype(np.uint64) << np.uint64(24))) & np.uint64(15)
    if len(nibble) % 2:
        return f"{level:02d}:" + nibble.astype(np.uint8)[:-1].reshape(-1, 2).dot(np.array([16, 1], np.uint8)).astype(np.uint8).tobytes().hex() + f"{int(nibble[-1]):x}"
    return f"{level:02d}:" + nibble.astype(np.uint8).reshape(-1, 2).dot(np.array([16, 1], np.uint8)).astype(np.uint8).tobytes().hex()


def _at_level(fingerprint: str, level: int) -> np.ndarray:
    own, got = int(fingerprint[:2]), np.frombuffer(fingerprint[3:].encode(), np.uint8)
    if own == level or not len(got):
        return got
    power = 12
    while len(_sampled(own, power)) < len(got):
        power += 1
    steps = _sampled(own, power)[: len(got)]
    return got[(_mixed(steps) & np.uint64((1 << level) - 1)) == 0]


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of equal digits at the coarser level, less what chance gives."""
    if a == b:
        return 1.0
    level = max(int(a[:2]), int(b[:2]))
    x, y = _at_level(a, level), _at_level(b, level)
    most, least = max(len(x), len(y)), min(len(x), len(y))
    share = float((x[:least] == y[:least]).sum()) / most if least else 0.0
    return max(0.0, (share - CHANCE) / (1 - CHANCE))


@cache
def _places(n: int, width: int) -> np.ndarray:
    """(BANDS, width): places below n of each band, in an order that does not depend on n."""
    orders = np.random.default_rng(11).permuted(np.tile(np.arange(2 * SAMPLES), (BANDS, 1)), axis=1)
    return np.stack([order[order < n][:width] for order in orders])


def _levels(fingerprint: str) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """A fingerprint's own level and the next one, its digits there and its band hashes."""
    own = int(fingerprint[:2])
    for level in (own, own + 1):
        got = _at_level(fingerprint, level)
        yield level, got, [
            xxhash.xxh64_intdigest(bytes((level, n)) + digits_.tobytes(), width)
            for width, low, high in (BAND_DIGITS if level == 0 else BAND_DIGITS[1:]) if low <= len(got) < high
            for n, digits_ in enumerate(got[_places(len(got), width)])
        ]


def bands(fingerprint: str) -> list[int]:
    """Hashes of bit-sampled digits from the whole of a fingerprint, at its level and the next, so that neighbouring levels can meet.

    The few digits of a short text make narrow bands, more make wide ones; in between both kinds, so that either kind meets."""
    return [key for _, _, keys in _levels(fingerprint) for key in keys]


def sketch(got: np.ndarray) -> np.ndarray:
    """The first 16 * SKETCH digits: of each 64 the first bits in one long, the second ones in the next, and so on; what is missing counts as 0."""
    values = np.where(got > 57, got - 87, got - 48).astype(np.uint8)[: 16 * SKETCH]
    values = np.concatenate([values, np.zeros(16 * SKETCH - len(values), np.uint8)])
    return np.packbits(values.reshape(-1, 1, 64) >> np.arange(PLANES, dtype=np.uint8)[:, None] & 1, axis=-1).view(np.int64).ravel()


def prints(rows: list[tuple]) -> list[dict]:
    """Results of (doc_id, text, text of the next document)."""
    texts = [code_points(t or "") for _, t, _ in rows]
    tails = [code_points((following or "")[: len(t) // 4]) for t, (*_, following) in zip(texts, rows, strict=True)]
    last = code_points(rows[-1][2] or "")
    flat = np.concatenate([*texts, *tails, last]) if rows else np.zeros(0, np.uint32)
    n, tail = np.array([len(t) for t in [*texts, last]]), np.array([len(t) for t in tails])
    starts = np.concatenate([[0], np.cumsum(n[:-1])[:-1], [n[:-1].sum() + tail.sum()]]).astype(np.int64)
    tail_starts = n[:-1].sum() + np.concatenate([[0], np.cumsum(tail)[:-1]]).astype(np.int64)
    reached, ends = walk(flat, starts, n, np.zeros(len(n), np.int64))
    own = [digits(n[k], reached[starts[k] : starts[k] + n[k]], flat[starts[k] : starts[k] + n[k]], ends[k]) for k in range(len(n))]
    kept = n[:-1] - n[:-1] // 4
    from_step = np.array([ends[k] if kept[k] == n[k] else reached[starts[k] + kept[k]] for k in range(len(rows))], np.int64)
    tail_reached, tail_ends = walk(flat, tail_starts, tail, from_step)
    found = []
    for k, (doc_id, text, following) in enumerate(rows):
        low, high = starts[k], tail_starts[k]
        steps = np.concatenate([reached[low : low + kept[k]], tail_reached[high : high + tail[k]]])
        chars = np.concatenate([flat[low : low + kept[k]], flat[high : high + tail[k]]])
        edited = digits(kept[k] + tail[k], steps, chars, tail_ends[k])
        raw = ((text or "")[: kept[k]] + (following or "")[: tail[k]]).encode("utf-8", "surrogatepass")
        keys = set(bands(own[k]))
        found.append({
            "doc_id": doc_id, "n_chars": int(n[k]), "edited_sha256": hashlib.sha256(raw).hexdigest(), "fingerprint": own[k], "edited_fingerprint": edited,
            "near_edited": likeness(own[k], edited), "near_next": likeness(own[k], own[k + 1]), "edited_bands": len(keys & set(bands(edited))), "next_bands": len(keys & set(bands(own[k + 1]))),
        })
    return found


def _chunks(rows: list[tuple]) -> Iterator[list[dict]]:
    """prints of rows, so many characters at a time; each chunk's last row brings the next text along."""
    start = size = 0
    for k, (_, text, following) in enumerate(rows):
        size += len(text or "")
        if size + len(following or "") > CHUNK_CHARS or k == len(rows) - 1:
            yield prints(rows[start : k + 1])
            start, size = k + 1, 0


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The SCHEMA columns of every document: fingerprints of its text and of its edited text, and their likeness.

    Documents are range-partitioned and sorted, so nearly every next document is in the same task. The last document
    of each task waits with its text, and meets the first text of the task after it in a small join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, edge = TaskContext.get().partitionId(), None, _schema(EDGE)
        pack = lambda rows: pa.RecordBatch.from_pylist(rows, schema=edge)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            if held is None:
                yield pack([{"place": place, "first_text": texts[0] or ""}])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            for found in _chunks([(i, t, f) for i, t, f in zip(ids, texts, texts[1:], strict=False)]):
                yield pack(found)
            held = (ids[-1], texts[-1])
        if held is not None:
            yield pack([{"doc_id": held[0], "place": place, "last_text": held[1] or ""}])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(prints([(row["doc_id"], row["last_text"], row["next_text"])]), schema=_schema(SCHEMA))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_first()
    done = cut(rows.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(run, EDGE), "edit-prints")
    heads = done.where("first_text IS NOT NULL").select("place", "first_text")
    over = Window.orderBy("place")  # a number for each task only
    following = heads.select("place", F.lead("place").over(over).alias("next_place"), F.min("place").over(Window.partitionBy()).alias("least"))
    following = following.select("place", F.coalesce("next_place", "least").alias("next_place"))
    heads = heads.select(F.col("place").alias("next_place"), F.col("first_text").alias("next_text"))
    waiting = done.where("last_text IS NOT NULL").select("doc_id", "place", "last_text")
    waiting = waiting.join(following, "place").join(heads, "next_place").select("doc_id", "last_text", "next_text")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return few(done.where("fingerprint IS NOT NULL").select(*names).unionByName(few(waiting, done).mapInArrow(close, SCHEMA)), done)


def _alike(pairs: DataFrame, nodes: DataFrame, threshold: float, like: DataFrame) -> DataFrame:
    """The pairs (hi, lo) of nodes (node, fingerprint) whose likeness reaches the threshold. like: what the pairs are made from."""

    @F.pandas_udf("double")
    def alike(a, b):
        import pandas as pd

        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("fingerprint").alias(f"print_{k}"))
    both = few(pairs.join(side("hi"), "hi").join(side("lo"), "lo"), like, nodes)
    return both.withColumn("likeness", alike("print_hi", "print_lo")).where(F.col("likeness") >= threshold).select("hi", "lo")


def apart(open_: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """hi, lo: the members (key, node, root) of one list in different components that may reach the threshold, once each.

    At the coarser level of two fingerprints the digits that differ among the first ones, and those that only one has, are too many for most
    pairs: then they are left out before their fingerprints are joined, which loses no link. Two that meet at a level above both have one level and are judged there."""

    @tidy
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, f, *found) for n, f in zip(batch.column("node").to_pylist(), batch.column("fingerprint").to_pylist(), strict=True) for found in _levels(f)]
            finest = [_at_level(f, int(f[:2])) for _, f, *_ in rows]
            packed = np.array([np.concatenate([sketch(got), sketch(all_)]) for (*_, got, _), all_ in zip(rows, finest, strict=True)], np.int64).reshape(len(rows), 2 * SKETCH)
            columns = [[n for n, *_ in rows], [level for _, _, level, *_ in rows], [level == int(f[:2]) for _, f, level, *_ in rows], [len(got) for *_, got, _ in rows], [len(all_) for all_ in finest], *packed.T]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()] + 2 * SKETCH * [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["node", "at", "own", "size_d", "size_e", *words])

    words = [f"{k}{i}" for k in "de" for i in range(SKETCH)]  # at the level of the key, and at the own one
    held = nodes.join(open_.select("node").distinct(), "node", "left_semi").select("node", "fingerprint")
    held = cut(few(held, open_, nodes).mapInArrow(sketches, f"node long, at long, own boolean, size_d int, size_e int, {', '.join(f'{w} long' for w in words)}"), "edit-sketches")
    entries = cut(open_.withColumn("at", F.col("key").bitwiseAND((1 << LEVEL_BITS) - 1)).join(held, ["node", "at"]), "edit-entries", open_, held)
    # one shuffle serves both sides, as they have the same columns
    side = lambda k: entries.select("key", F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("root", "own", "size_d", "size_e", *words)))
    differ = lambda w: F.col(f"{w}_hi").bitwiseXOR(F.col(f"{w}_lo"))
    # 64 digits at a time: a test of digits one after the other in a long is more code than the JVM compiles
    unlike = lambda k: sum((F.bit_count(reduce(Column.bitwiseOR, (differ(f"{k}{i + plane}") for plane in range(PLANES)))) for i in range(0, SKETCH, PLANES)), F.lit(0))
    share = CHANCE + threshold * (1 - CHANCE)

    def fits(k):
        most, least = F.greatest(f"size_{k}_hi", f"size_{k}_lo"), F.least(f"size_{k}_hi", f"size_{k}_lo")
        return (least >= share * most - 1e-6) & (unlike(k) <= (1 - share) * most + 1e-6)

    pairs = side("hi").join(side("lo"), "key").where("hi > lo AND root_hi <> root_lo").where(F.when(F.col("own_hi") | F.col("own_lo"), fits("d")).otherwise(fits("e")))
    found = cut(pairs.select("hi", "lo").distinct(), "edit-apart-pairs", entries)
    release(held, entries)
    return found


def links(nodes: DataFrame, threshold: float = LIKE) -> DataFrame:
    """hi, lo: verified links that join all nodes (node, fingerprint) which share a band and reach the threshold, as a written table.

    Each member of a band's list is compared with the first, which is linear. Then all members of a list that are not
    connected yet are compared, so no link between two components is lost; rows are quadratic only in the members of one list
    in different components."""

    @tidy
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "fingerprint", 1 << 20):
                # the level takes the place of a key's last bits
                keys = [sorted({k >> LEVEL_BITS << LEVEL_BITS | level for level, _, own in _levels(f.as_py()) for k in own}) for f in part.column("fingerprint")]
                owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                flat = np.array([k for own in keys for k in own], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), part.column("node").take(pa.array(owner))], names=["key", "node"])

    listed = cut(nodes.select("node", "fingerprint").mapInArrow(keyed, "key long, node long"), "edit-bands")
    centre = cut(listed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("top")).where("lo < top").select("key", "lo"), "edit-centres", listed)
    held = cut(listed.join(centre, "key"), "edit-lists", listed)
    first = cut(_alike(held.where("node > lo").select(F.col("node").alias("hi"), "lo").distinct(), nodes, threshold, held), "edit-stars")
    label = cut(components(first, first), "edit-label", first)
    placed = cut(held.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "edit-placed", held, label)
    split = cut(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key"), "edit-apart", placed)
    open_ = cut(placed.join(split, "key", "left_semi"), "edit-open", placed)
    rest = apart(open_, nodes, threshold)
    found = cut(first.unionByName(_alike(rest, nodes, threshold, rest)), "edit-links")
    release(listed, centre, held, first, label, placed, split, open_, rest)
    return found


def classes(printed: DataFrame, threshold: float = LIKE) -> DataFrame:
    """printed (doc_id, fingerprint and more) with class_id: the smallest doc_id that verified links lead to, its own included."""
    nodes = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes, "edit-nodes", printed)
    found = links(nodes, threshold)
    label = cut(components(found, found), "edit-label", found)
    rooted = nodes.join(label, "node", "left").select("fingerprint", "least", F.coalesce("root", "node").alias("root"))
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("fingerprint", "class_id"), "edit-classes", nodes)
    release(nodes, found, label)
    return few(printed.join(named, "fingerprint"), printed)
