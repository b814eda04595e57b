"""Near copies by the likeness of shingle sets, exact, by a prefix index with count filtering.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is at least SIMILAR. The words
are those of `simhash`. A fingerprint is of no use at that likeness: about 15 % of its bits differ, more bits than it has
bytes, so no shared byte is guaranteed.

Shingles have one global order. Similar sets share SHARED shingles at least among the first
floor(n / 5) + SHARED of each, n being the size of the set, so only those are indexed (the prefix), and pairs that share fewer
are dropped, and so are those whose prefixes share too few for their sizes. The order is by hash, but shingles that are frequent in a sample of the texts come last, the most frequent
at the very end; any order gives the same result, and this one keeps the posting lists short.

Candidates come first from op3's index: fingerprints within two bits (`simhash.links`), and all rows of one fingerprint. That index alone
would miss most of the near copies at this likeness, so the prefix index gives the rest of them.

Equal sets are one node. Candidates must fit by their sizes and by a parity signature, a lower bound of how much two sets differ,
before their texts are read. First each member of a posting list is compared with the smallest one, then, in some turns, each one that is
not connected yet with a few others at random, both of which are linear. Then all pairs of a list are compared whose nodes are not
connected yet: a great group of near copies is in one component by then, also where few of them are similar to the smallest one, and no
link between two components is lost. Rows are quadratic only in the members of one list that are similar and still in different components.

Defined cases: null, empty and blank texts have the empty set and are copies of each other; texts of one to four words
have one shingle, the whole sequence; every row is a row of its own, whatever its doc_id. Sets are compared by 64-bit
hashes of shingles, and equal sets are found by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .graph import components
from .ngramjoin import SIGNATURE, signature
from .shared import bucketed, cut, cut_by, dealing_rounds, numbered, portions, release, shuffle_parts, tidy

#: Words of a shingle, seed of the hashes, and the least similarity as a fraction.
SHINGLE, SEED, SIMILAR = 5, 42, (4, 5)
#: Shingles of the prefixes that a pair must share. Different sets of the least similarity share four.
SHARED = 2
#: Texts of the sample and frequent shingles taken from it; they set the order only, not the result.
SAMPLE, FREQUENT, OFTEN = 10_000, 20_000, 5
#: Turns in which a node is compared with about HAND - 1 others at random in each of KEYS of its lists, up to one that gives less
#: than the share 1 / FEW of the links before it; they set the cost only, too.
TURNS, HAND, KEYS, FEW = 3, 8, 3, 10


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in parts), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least SIMILAR."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order: the frequent ones (sorted, with their ranks) come last."""
    n, (up, down) = len(found), SIMILAR
    if n < up:  # a similar set is an equal one
        return found[:0]
    size = n - -(-n * up // down) + SHARED
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = frequent[at] == found
        found = np.concatenate([found[~late], found[late][np.argsort(rank[at[late]])]])
    return found[:size]


def frequent_shingles(docs: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur often in a sample of the texts, sorted, and their ranks from less to most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), size).view(np.int64))], names=["s"])

    share = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    often = some.mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    often = often.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    keys = np.array(often.column("s").to_numpy()).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def marked(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """row, fp (hash of the shingle set), n (its size), prefix, print (op3's fingerprint) and signature of rows (row, text)."""
    frequent, rank = frequent_shingles(rows, size)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                sets = [shingles(t.as_py(), size) for t in part.column("text")]
                heads = [prefix(s, frequent, rank) for s in sets]
                fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, heads)], dtype=np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *heads]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                near = np.array([simhash.fingerprint(t.as_py()) for t in part.column("text")], np.uint64).view(np.int64)
                bits = np.stack([signature(s) for s in sets], axis=1)
                columns = [part.column("row"), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), lists, pa.array(near), *map(pa.array, bits)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "fp", "n", "prefix", "print", *SIGNATURE])

    return rows.select("row", "text").mapInArrow(run, "row long, fp long, n long, prefix array<long>, print long, " + ", ".join(f"{b} long" for b in SIGNATURE))


def verified(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The pairs (hi, lo) whose texts (row, text) are similar. texts is in buckets by row, so only the texts of pairs move."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for part in portions(batch, "text_hi"):
                good = []
                for lo, a, b in zip(part.column("lo").to_pylist(), part.column("text_hi"), part.column("text_lo"), strict=True):
                    if lo != last:
                        last, held = lo, shingles(b.as_py(), size)
                    good.append(similar(shingles(a.as_py(), size), held))
                yield part.select(["hi", "lo"]).filter(pa.array(good, pa.bool_()))

    side = lambda k: texts.select(F.col("row").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("hi"), "hi").join(side("lo"), "lo").select("hi", "lo", "text_hi", "text_lo").mapInArrow(run, "hi long, lo long")


def _counted(pairs: DataFrame) -> DataFrame:
    """The distinct pairs that share enough shingles."""
    return pairs.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED).select("hi", "lo")


def _enough(entries: DataFrame) -> DataFrame:
    """The pairs (hi, lo, n_hi, n_lo, a row for each shingle that both prefixes have) that may be similar by the number of these.

    Of the two prefixes let w be the last shingle of the one that ends first. Up to w all shingles that both have are counted, and
    behind w the set whose prefix that is has no more than its rest: so both share the count and the larger rest at most."""
    up, down = SIMILAR
    rest = F.expr(f"(greatest(n_hi, n_lo) * {up} + {down - 1}) div {down} - {SHARED}")
    counted = entries.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("k"), F.first("n_hi").alias("n_hi"), F.first("n_lo").alias("n_lo"))
    return counted.where((F.col("k") >= SHARED) & (F.col("k") + rest >= _both())).select("hi", "lo")


def _both() -> Column:
    """What sets of such sizes must share to be similar."""
    up, down = SIMILAR
    return F.expr(f"((n_hi + n_lo) * {up} + {up + down - 1}) div {up + down}")


def _sizes() -> Column:
    return F.least("n_hi", "n_lo") * SIMILAR[1] >= F.greatest("n_hi", "n_lo") * SIMILAR[0]


def _fits() -> Column:
    """Whether a pair with its sizes and signatures may be similar: sets of such sizes must share `both`, and differ in the rest at most."""
    apart = sum((F.bit_count(F.col(f"{b}_hi").bitwiseXOR(F.col(f"{b}_lo"))) for b in SIGNATURE), F.lit(0))
    return _sizes() & (apart <= F.col("n_hi") + F.col("n_lo") - 2 * _both())


def _side(entries: DataFrame, k: str, *more: str) -> DataFrame:
    return entries.select(*more, F.col("row").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", *SIGNATURE)), *([F.col("root").alias(f"root_{k}")] if "root" in entries.columns else []))


def _fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(_side(nodes, "hi"), "hi").join(_side(nodes, "lo"), "lo").where(_fits()).select("hi", "lo")


def _by_fingerprint(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Candidates by op3's index: the nodes of one fingerprint, and of fingerprints that its links join."""
    known = nodes.where("n > 0").select("row", "print")
    first = cut(known.groupBy("print").agg(F.min("row").alias("lo")), "shingle-prints")
    near = simhash.links(first.select(F.col("print").alias("fp")))
    same = known.join(first, "print").where("row > lo").select(F.col("row").alias("hi"), "lo")
    side = lambda k: first.select(F.col("print").alias(k), F.col("lo").alias(f"row_{k}"))
    linked = near.join(side("hi"), "hi").join(side("lo"), "lo").select(F.greatest("row_hi", "row_lo").alias("hi"), F.least("row_hi", "row_lo").alias("lo"))
    return same.unionByName(linked), [first, near]


def _dealt(open_: DataFrame, turn: int) -> DataFrame:
    """Each node with a few others at random in some of its lists, the same ones for nodes that share most of their lists, if they are not connected."""
    order = F.xxhash64(F.lit(turn), "key")
    few = open_.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "key", "m"))).alias("keys"))  # a prefix at most
    few = few.select("row", F.inline(F.slice("keys", 1, KEYS))).withColumn("hand", F.pmod(F.xxhash64(F.lit(turn), "row", "key"), F.ceil(F.col("m") / HAND)))
    own = open_.groupBy("row").agg(*(F.first(c).alias(c) for c in ("n", "root", *SIGNATURE)))
    hand = cut(few.select("row", "key", "hand").join(own, "row"), "shingle-hands")
    met = _side(hand, "hi", "key", "hand").join(_side(hand, "lo", "key", "hand"), ["key", "hand"]).where((F.col("hi") > F.col("lo")) & (F.col("root_hi") != F.col("root_lo")) & _fits())
    found = cut(met.select("hi", "lo").distinct(), "shingle-near")
    release(hand)
    return found


def _all(open_: DataFrame) -> DataFrame:
    """All members of a list that are not connected."""
    met = _side(open_, "hi", "key").join(_side(open_, "lo", "key"), "key").where((F.col("hi") > F.col("lo")) & (F.col("root_hi") != F.col("root_lo")) & _fits())
    return cut(_enough(met), "shingle-near")


def links(nodes: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """hi, lo: links that join all similar texts of nodes (row, n, prefix, print, signature), in a table of `cut`."""
    listed = nodes.select("row", "n", F.explode("prefix").alias("key"))
    entries = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    shared = cut_by("key", 12 * entries, lambda some: some.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"), listed.select("key"), "shingle-keys")
    listed = cut_by("key", 24 * entries, lambda some: some.join(shared, "key", "left_semi"), listed, "shingle-lists")
    centre = cut(listed.groupBy("key").agg(F.min(F.struct("row", "n")).alias("c")).select("key", F.col("c.row").alias("lo"), F.col("c.n").alias("n_lo")), "shingle-centres")
    stars = listed.join(centre, "key").withColumnsRenamed({"row": "hi", "n": "n_hi"}).where((F.col("hi") > F.col("lo")) & _sizes())
    prints, held = _by_fingerprint(nodes)
    pairs = cut(_counted(stars).unionByName(prints).distinct(), "shingle-pairs")
    near = cut(_fitting(pairs, nodes), "shingle-near")
    found = cut(verified(near, texts, size), "shingle-stars")
    release(shared, centre, pairs, near, *held)
    open_, still = None, False
    for turn in [*range(TURNS), None]:
        if still and turn is not None:
            continue
        if open_ is None:
            label = cut(components(found).withColumnRenamed("node", "row"), "shingle-label")
            placed = cut(listed.join(label, "row", "left").select("key", "row", "n", F.coalesce("root", "row").alias("root")), "shingle-placed")
            apart = cut(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("m")).where("x < y").select("key", "m"), "shingle-apart")
            open_ = cut(placed.join(apart, "key").join(nodes.select("row", *SIGNATURE), "row"), "shingle-open")
            release(label, placed, apart)
        near = _all(open_) if turn is None else _dealt(open_, turn)
        more = cut(verified(near, texts, size), "shingle-more")
        n_more = more.count()
        still = n_more * FEW < found.count()
        before, found = found, cut(found.unionByName(more), "shingle-links")
        release(near, more, before)
        if n_more or turn is None:
            release(open_)
            open_ = None
    release(listed)
    return found


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Of each component of similar texts the row with the smallest doc_id, null last, and all columns of docs."""
    spark, bytes_ = docs.sparkSession, docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    rounds = dealing_rounds(bytes_)
    held = docs.select(numbered(F.col("text").cast("string"), rounds).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).dropFields("text").alias("own") if len(docs.columns) > 1 else F.lit(0).alias("own"))
    rows = bucketed(held, "row", "shingle-rows", shuffle_parts(spark, bytes_), rounds)
    prints = cut(marked(rows, size), "shingle-prints")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("row").alias("z"))
    ordered = cut(rows.select("row", order.alias("least")).join(prints.select("row", "fp"), "row"), "shingle-order")
    nodes = cut(ordered.groupBy("fp").agg(F.min("row").alias("row"), F.min("least").alias("least")), "shingle-nodes")
    kept = cut(prints.join(nodes.select("row"), "row", "left_semi").select("row", "n", "prefix", "print", *SIGNATURE), "shingle-kept")
    release(prints)
    found = links(kept, rows, size)
    label = cut(components(found).withColumnRenamed("node", "row"), "shingle-label")
    rooted = nodes.join(label, "row", "left").select(F.coalesce("root", "row").alias("root"), "least")
    keep = cut(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.z").alias("row")), "shingle-keep")
    release(kept, ordered, nodes, found, label)
    return rows.join(keep, "row", "left_semi").select(*(F.col("text") if c == "text" else F.col(f"own.{c}") for c in docs.columns))
