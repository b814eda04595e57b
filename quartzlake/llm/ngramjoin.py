"""Similarity join of documents by their sets of five-word shingles, with adaptive multi-match prefixes; exact.

Two documents link if the Jaccard similarity of their sets is SIMILAR or more. Shingles have one global order. A set of n
shingles shares t = ceil(0.8 n) at least with a similar one, so the first n - t + l shingles of both (their l-prefixes) have l in
common, for every l up to 4 (different similar sets share four). A longer prefix makes more posting rows and, as more shared shingles
are asked for, fewer candidates; which l is best depends on the document. From the exact lengths of the posting lists each
document has, for each l, a bound of its posting rows S(l) and of its candidates S(l) / l, and takes the l of least cost
S(l) * (1 + VERIFY * n / l). A document with fewer than l shingles of its l-prefix in any other document has no similar one and
leaves at once. A pair is asked for the smaller l of the two, within both prefixes of that l, so no similar pair is lost.

Pairs must also fit by their sizes, which give a shorter prefix for each pair, by the places of each shared shingle (what can be shared before and after it), and by a parity signature, a lower bound of how much two sets
differ. What is left is
verified with the whole texts. Equal sets are one node. Members of a posting list are first compared with its smallest one, then
with a few others at random, which is linear; then only nodes of one list that are not connected yet are
paired. So a group of copies costs no square, also where many of them are not similar to the smallest one.

The order is by hash, but shingles that are frequent anywhere come last, the most frequent at the very end. Each task keeps a
summary of bounded size over all its texts (counts less than the share 1 / COUNTERS may be missed), so all rows are counted. Any
order gives the same result. Shingles with the same posting list are one list with a weight, so a run of text that long documents share pairs
them once and not once for each shingle.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; texts of one to four words have
one shingle, the whole sequence, and link with equal ones. Every row is a row of its own, whatever its doc_id; of null ids the
component takes the smallest other one, or null. Very long texts are processed whole, a portion each. An empty table gives an empty
result. Further columns are dropped, whatever their names. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import bucketed, cut, portions, release, shuffle_parts, tidy

#: Words of a shingle, seed of the hashes, and the least similarity as a fraction.
SHINGLE, SEED, SIMILAR = 5, 42, (4, 5)
#: The longest extension of a prefix: different sets of the least similarity share so many shingles.
LEVELS = 4
#: What one shingle of a verified candidate costs, in posting rows.
VERIFY = 0.05
#: Counters of a task's summary, and frequent shingles that are ordered by it. They set the cost only, not the result.
COUNTERS, FREQUENT, OFTEN = 50_000, 20_000, 5
#: Members of lists of at least LONG are compared with about HAND - 1 others at random before all pairs of the rest are looked at.
LONG = HAND = 8
#: Words of a parity signature.
SIGNATURE = [f"b{i}" for i in range(8)]
PAIR = ["hi", "lo", "root_hi", "root_lo"]
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, each made from the hashes of its words in their order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    span = min(size, len(words))
    found = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        found = _mixed(found ^ hashes[i : len(words) - span + 1 + i]) + np.uint64(i + 1)
    return np.unique(found)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least SIMILAR."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The longest prefix of a set in the global order: the frequent shingles (sorted, with their ranks) come last."""
    n, (up, down) = len(found), SIMILAR
    if n < LEVELS:  # a similar set is an equal one
        return found[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = frequent[at] == found
        found = np.concatenate([found[~late], found[late][np.argsort(rank[at[late]], kind="stable")]])
    return found[: n - -(-n * up // down) + LEVELS]


def signature(found: np.ndarray) -> np.ndarray:
    """For each of 512 slots whether an odd number of shingles falls into it. Two signatures differ in no more bits than their sets
    differ in shingles."""
    return np.packbits(np.bincount((found >> np.uint64(55)).astype(np.int64), minlength=64 * len(SIGNATURE)).astype(np.uint8) & 1).view(np.int64)


def _level(n: str, place: str):
    """The smallest l whose l-prefix has this place."""
    up, down = SIMILAR
    return F.greatest(F.lit(1), F.expr(f"{place} - {n} + cast(ceil({n} * {up} / {down}) as int) + 1"))


class Summary:
    """Counts of the most frequent keys of a stream: what is over the capacity lowers all counts by the largest that must go."""

    def __init__(self, most: int = COUNTERS):
        self.most, self.keys, self.counts = most, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        all_keys = np.concatenate([self.keys, keys])
        counts = np.concatenate([self.counts, np.ones(len(keys), np.int64)])
        self.keys, at = np.unique(all_keys, return_inverse=True)
        self.counts = np.zeros(len(self.keys), np.int64)
        np.add.at(self.counts, at, counts)
        if (over := len(self.keys) - self.most) > 0:
            self.counts -= np.partition(self.counts, over - 1)[over - 1]
            held = self.counts > 0
            self.keys, self.counts = self.keys[held], self.counts[held]


def frequent_shingles(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all texts, sorted, and their ranks from less to most frequent."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary()
        for batch in batches:
            for part in portions(batch):
                summary.add(np.concatenate([shingle_set(t.as_py(), size) for t in part.column("text")]))
        held = summary.counts >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(summary.keys[held].view(np.int64)), pa.array(summary.counts[held])], names=["s", "n"])

    often = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    keys = np.array(often.column("s").to_numpy()).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def marked(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """row, fp (hash of the set), n (its size), prefix and signature of rows (row, text)."""
    frequent, rank = frequent_shingles(rows, size)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                sets = [shingle_set(t.as_py(), size) for t in part.column("text")]
                heads = [prefix(s, frequent, rank) for s in sets]
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                bits = np.stack([signature(s) for s in sets], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fp), pa.array([len(s) for s in sets], pa.int32()), lists, *map(pa.array, bits)], names=["row", "fp", "n", "prefix", *SIGNATURE])

    return rows.select("row", "text").mapInArrow(run, "row long, fp long, n int, prefix array<long>, " + ", ".join(f"{b} long" for b in SIGNATURE))


def postings(nodes: DataFrame) -> DataFrame:
    """key, row, n, place, level, need, w and signature: the entries of each node's own prefix, in a table of `cut`; need is its l.

    Shingles in just the same nodes' prefixes, as a run of shared text has them, are one list of weight w under the first of them
    in the global order, which is the first of them in each node too."""
    listed = nodes.select("row", "n", F.posexplode("prefix").alias("place", "key"))
    listed = listed.select("key", "row", "n", "place", _level("n", "place").alias("level"))
    lengths = cut(nodes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "join-lengths")
    met = cut(listed.join(lengths, "key"), "join-met")
    levels = range(1, LEVELS + 1)
    within = lambda l, x: F.sum(F.when(F.col("level") <= l, x).otherwise(0))  # noqa: E731, E741
    known = met.groupBy("row").agg(F.first("n").alias("n"), *(within(l, F.col("k") - 1).alias(f"s{l}") for l in levels), *(within(l, F.lit(1)).alias(f"m{l}") for l in levels))  # noqa: E741
    alone = F.expr(" OR ".join(f"m{l} < {l}" for l in levels))  # noqa: E741
    costs = [F.struct((F.col(f"s{l}") * (1 + VERIFY * F.col("n") / l)).alias("cost"), F.lit(l).alias("need")) for l in levels]  # noqa: E741
    need = cut(known.where(~alone).select("row", F.least(*costs)["need"].alias("need")), "join-need")
    own = cut(met.drop("k").join(need, "row").where("level <= need"), "join-own")
    release(lengths, met, need)
    members = own.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "row")).alias("y"), F.min(F.struct("row", "place")).alias("c"))
    lists = cut(members.where("m > 1").groupBy("m", "x", "y", "c.row").agg(F.min_by("key", "c.place").alias("key"), F.count(F.lit(1)).alias("w")).select("key", "w"), "join-lists")
    found = cut(own.join(lists, "key").join(nodes.select("row", *SIGNATURE), "row"), "join-postings")
    release(own, lists)
    return found


def _fitting(pairs: DataFrame) -> DataFrame:
    """The pairs of entries that may belong to similar sets, by their sizes, places and signatures. `both` is what sets of such sizes must share;
    each then has the shingle within its prefix for that number, which is shorter than the one for its own size alone."""
    up, down = SIMILAR
    pairs = pairs.withColumn("need", F.least("need_hi", "need_lo")).withColumn("both", F.expr(f"cast(ceil((n_hi + n_lo) * {up} / {up + down}) as int)"))
    after = F.least(F.col("n_hi") - F.col("place_hi"), F.col("n_lo") - F.col("place_lo"))
    sizes = F.least("n_hi", "n_lo") * down >= F.greatest("n_hi", "n_lo") * up
    within = [F.col(f"place_{k}") < F.col(f"n_{k}") - F.col("both") + F.col("need") for k in ("hi", "lo")]
    apart = sum((F.bit_count(F.col(f"{b}_hi").bitwiseXOR(F.col(f"{b}_lo"))) for b in SIGNATURE), F.lit(0))
    return pairs.where(sizes & within[0] & within[1] & (F.least("place_hi", "place_lo") + after >= F.col("both")) & (apart <= F.col("n_hi") + F.col("n_lo") - 2 * F.col("both")))


def _counted(pairs: DataFrame) -> DataFrame:
    """The distinct pairs that share enough shingles of their prefixes."""
    shared = pairs.groupBy("hi", "lo").agg(F.sum("w").alias("k"), *(F.first(c).alias(c) for c in ("need", "root_hi", "root_lo")))
    return shared.where("k >= need").select("hi", "lo", "root_hi", "root_lo")


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The pairs (hi, lo, root_hi, root_lo) whose texts (row, text) are similar. texts is in buckets by row, so only the texts of
    pairs move."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for part in portions(batch, "text_hi"):
                good = []
                for lo, a, b in zip(part.column("lo").to_pylist(), part.column("text_hi"), part.column("text_lo"), strict=True):
                    if lo != last:
                        last, held = lo, shingle_set(b.as_py(), size)
                    good.append(similar(shingle_set(a.as_py(), size), held))
                yield part.select(PAIR).filter(pa.array(good, pa.bool_()))

    side = lambda k: texts.select(F.col("row").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("hi"), "hi").join(side("lo"), "lo").select(*PAIR, "text_hi", "text_lo").mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def _side(entries: DataFrame, k: str, *key: str) -> DataFrame:
    return entries.select("key", *key, *(["w"] if k == "hi" else []), F.col("row").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "place", "need", "root", *SIGNATURE)))


def _stars(entries: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each member of a list with its smallest one."""
    least = entries.groupBy("key").agg(F.min(F.struct("row", "n", "place", "need", "root", *SIGNATURE)).alias("c"))
    centre = cut(_side(least.select("key", "c.*"), "lo"), "join-centres")
    return _counted(_fitting(_side(entries, "hi").join(centre, "key").where("root_hi <> root_lo"))), [centre]


def _dealt(entries: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each member of a longer list with a few others at random, others in each list, if they are not connected."""
    hand = entries.where(F.col("m") >= LONG).withColumn("hand", F.pmod(F.xxhash64("row", "key"), F.ceil(F.col("m") / HAND)))
    pairs = _side(hand, "hi", "hand").join(_side(hand, "lo", "hand"), ["key", "hand"]).where("hi > lo AND root_hi <> root_lo")
    return _fitting(pairs).select(*PAIR).distinct(), []


def _all(entries: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All members of a list that are not connected."""
    return _counted(_fitting(_side(entries, "hi").join(_side(entries, "lo"), "key").where("hi > lo AND root_hi <> root_lo"))), []


def connected(nodes: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """row, root: for each node (row, n, prefix, signature) that may be similar to another one, the least of those it is connected with, in a
    table of `cut`. After each step the lists keep only what is in two components still, by the roots known so far."""
    listed = postings(nodes)
    entries = cut(listed.withColumn("root", F.col("row")).withColumn("m", F.lit(0).cast("long")), "join-open")
    label = cut(listed.select("row").distinct().withColumn("root", F.col("row")), "join-label")
    steps = [_stars, _dealt, _all]
    for step in steps:
        pairs, held = step(entries)
        near = cut(pairs, "join-near")
        found = cut(verified(near, texts, size), "join-found")
        if step is not steps[0] and found.isEmpty():
            release(near, found, *held)
            continue
        merged = cut(components(found.select(F.col("root_hi").alias("hi"), F.col("root_lo").alias("lo"))).select(F.col("node").alias("root"), F.col("root").alias("new")), "join-merged")
        moved = lambda df: df.join(merged, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")  # noqa: B023, E731
        before, label = label, cut(moved(label).select("row", "root"), "join-label")
        release(near, found, before, *held)
        if step is not steps[-1]:
            placed = cut(moved(entries.drop("m")), "join-placed")
            open_ = cut(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("m")).where("x < y").select("key", "m"), "join-lists")
            before, entries = entries, cut(placed.join(open_, "key"), "join-open")
            release(before, placed, open_)
        release(merged)
    release(listed, entries)
    return label


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    spark, bytes_ = docs.sparkSession, docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    held = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = bucketed(held, "row", "join-rows", shuffle_parts(spark, bytes_))
    prints = cut(marked(rows, size), "join-prints")
    named = cut(rows.select("row", "doc_id").join(prints.select("row", "fp", "n"), "row"), "join-named")
    nodes = cut(named.where("n > 0").groupBy("fp").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id")), "join-nodes")
    label = connected(prints.join(nodes.select("row"), "row", "left_semi").select("row", "n", "prefix", *SIGNATURE), rows, size)
    rooted = cut(nodes.join(label, "row", "left").select("fp", "doc_id", F.coalesce("root", "row").alias("root")), "join-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = cut(rooted.join(least, "root").select("fp", "component_id"), "join-components")
    release(rows, prints, nodes, label, rooted)
    alone = named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = named.where("n > 0").join(component, "fp").select("doc_id", "n", "component_id").unionByName(alone)
    return every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
