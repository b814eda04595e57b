"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most MAX_BITS = 2 bits share at least MIN_SHARED = 6
positional bytes. A posting list is kept for each choice of six positions and their bytes (28 lists for a fingerprint):
those who meet in one have reached the guaranteed minimum, and those who never meet have not. Lists of single positional bytes
would hold 1/256 of the corpus each. The tally of shared bytes and the Hamming distance of the pairs are verified.

Only distinct fingerprints are indexed. The members of a list differ in its two free bytes only. A list of more than
MAX_LIST members is not expanded into pairs: each member takes the 17 values of its free bytes that are at most one bit
away, and members that meet in one are linked to the smallest. Two members meet exactly if they differ in at most two
bits, so no link is lost and none is made up, and the rows are linear in the members.

Defined cases: null, empty and blank texts have no shingle and fingerprint zero, which is linked like any other; texts
of one or two words have one shingle, the whole sequence; a bit that is set in exactly half the shingles is 0; very long
texts are hashed CHUNK shingles at a time; rows with one doc_id twice are two rows with their own fingerprints; an empty
table gives no rows; columns besides doc_id and text are ignored by the operators.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, portions, release, tidy

SHINGLE, SEED, MAX_BITS, MIN_SHARED = 3, 42, 2, 6
#: Longest posting list that is expanded into pairs; longer ones are linked through one-bit variants of their free bytes.
MAX_LIST = 32
#: Shingle hashes are held as bits for so many at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(((ones * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                got = np.array([fingerprint(t.as_py(), size) for t in part.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _byte(column, i):
    return F.shiftrightunsigned(column, 8 * i).bitwiseAND(F.lit(255))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


#: Masks of six positions, and the bits of the two that are free.
MASKS = [sum(0xFF << 8 * i for i in held) for held in combinations(range(8), MIN_SHARED)]


def postings(fps: DataFrame) -> DataFrame:
    """n, block, fp: a row for each choice of six positions, with their bytes."""
    blocks = [F.struct(F.lit(n).cast("short").alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for n, m in enumerate(MASKS)]
    return fps.select("fp", F.inline(F.array(*blocks))).select("n", "block", "fp")


def links(fps: DataFrame) -> DataFrame:
    """hi, lo: links between distinct fingerprints that join all that differ in at most MAX_BITS bits."""
    most = MAX_LIST
    listed = postings(fps)
    sizes = cut(listed.groupBy("n", "block").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "simhash-sizes")
    listed = cut(listed.join(sizes, ["n", "block"]), "simhash-lists")
    small = listed.where(F.col("k") <= most)
    a, b = small.select("n", "block", F.col("fp").alias("hi")), small.select("n", "block", F.col("fp").alias("lo"))
    tally = sum((_byte(F.col("hi"), i) == _byte(F.col("lo"), i)).cast("int") for i in range(8))
    near = F.bit_count(F.col("hi").bitwiseXOR(F.col("lo"))) <= MAX_BITS
    pairs = a.join(b, ["n", "block"]).where("hi > lo").where(tally >= MIN_SHARED).where(near).select("hi", "lo")
    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in MASKS])
    flips = F.transform(F.get(free, F.col("n").cast("int")), lambda bit: F.col("fp").bitwiseXOR(bit))
    variants = cut(listed.where(F.col("k") > most).select("n", "block", "fp", F.explode(flips).alias("variant")), "simhash-variants")
    centre = cut(variants.groupBy("n", "block", "variant").agg(F.min("fp").alias("lo"), F.max("fp").alias("top")).where("lo < top").drop("top"), "simhash-centres")
    stars = variants.join(centre, ["n", "block", "variant"]).where("fp > lo").select(F.col("fp").alias("hi"), "lo")
    found = cut(pairs.unionByName(stars).distinct(), "simhash-links")
    release(sizes, listed, variants, centre)
    return found


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that can be reached over links, the document's own included."""
    prints = cut(fingerprints(docs, size), "simhash-prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    found = links(nodes.select("fp"))
    label = components(found)
    release(found)
    label = label.select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(label, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
