"""What the operators share: reading tables, the folder all machines see, cutting lineage, and bounded memory in workers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words in the contracts: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"
#: Bytes of text that a Python worker turns into objects at a time.
PORTION_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every machine sees: spark.checkpoint.dir. Where that is unset, local mode gets a folder of its own and
    a cluster an error, as its machines share no folder that could be guessed."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="quartzlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _collected(spark: SparkSession) -> None:
    """Plans that made a written table are garbage; their shuffle files go when the driver's JVM collects them."""
    if not spark.sparkContext.master.startswith("local["):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Bytes on disk of the written tables that a result is made from, for each task that writes it.
WRITE_BYTES = 1 << 20


def few(df: DataFrame, *like: DataFrame) -> DataFrame:
    """df, of about the size of the tables of `cut` that it is made from, dealt to as many tasks as their bytes ask for, one for each core at least.

    A session may have hundreds of parts for a shuffle, and a small table's files cost far more than its rows. Where the parts
    are not four times as many as needed, or the tables' bytes are not known, df stays as it is."""
    if not all(getattr(x, "written_to", None) for x in like):
        return df
    n = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(map(written_bytes, like)) / WRITE_BYTES))
    return df.repartition(n) if 4 * n <= shuffle_parts(df.sparkSession) else df


#: Tables made within each `passing` that is open.
_MADE: list[list[DataFrame]] = []


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables of `cut` and `bucketed` that are made meanwhile go at the end, but for those that are taken off the list."""
    _MADE.append(made := [])
    try:
        yield made
    finally:
        _MADE.pop()
        release(*made)


def cut(df: DataFrame, label: str, *like: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and lost executors cost nothing. like: see `few`."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, label)
    df = few(df, *like) if like else df
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to, found.table_name = path, None
    for made in _MADE[-1:]:
        made.append(found)
    _collected(spark)
    return found


#: Text that is dealt into buckets at a time, and the most times that a table is read for it.
ROUND_BYTES, MOST_ROUNDS = 64 << 20, 8


def dealing_rounds(size: int) -> int:
    """In how many rounds `bucketed` deals a table of so many bytes, so that a share of them is in shuffle files at a time."""
    return min(MOST_ROUNDS, max(1, math.ceil(size / ROUND_BYTES)))


def numbered(text, rounds: int):
    """A number for each row, in the order of the rows, whose remainder by `rounds` is the text's, whenever it is computed."""
    return F.monotonically_increasing_id() * rounds + F.pmod(F.xxhash64(text), F.lit(rounds))


def cut_by(key: str, size: int, make: Callable[[DataFrame], DataFrame], df: DataFrame, label: str) -> DataFrame:
    """`cut` of make(df), of which each row comes from rows of one key: one share of the keys after another, as a shuffle of about `size` bytes asks for."""
    spark, path, rounds = df.sparkSession, new_dir(df.sparkSession, label), dealing_rounds(size)
    for k in range(rounds):
        some = make(df if rounds == 1 else df.where(F.pmod(F.xxhash64(F.lit(label), key), F.lit(rounds)) == k))
        some.write.mode("append").option("compression", "zstd").parquet(path)
        _collected(spark)
    found = spark.read.schema(some.schema).parquet(path)
    found.written_to, found.table_name = path, None
    for made in _MADE[-1:]:
        made.append(found)
    return found


def bucketed(df: DataFrame, key: str, label: str, parts: int, rounds: int = 1) -> DataFrame:
    """`cut`, dealt into buckets by a key, so that later joins on the key do not shuffle this table again.

    With more than one round, which needs a key of `numbered`, each round deals the rows of one remainder and its shuffle files go before the next."""
    spark, path, name = df.sparkSession, new_dir(df.sparkSession, label), f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    for k in range(rounds):
        some = df if rounds == 1 else df.where(F.pmod(key, F.lit(rounds)) == k)
        to = some.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").format("parquet")
        (to.mode("append") if k else to.option("path", path)).saveAsTable(name)
        _collected(spark)
    found = spark.table(name)
    found.written_to, found.table_name = path, name
    for made in _MADE[-1:]:
        made.append(found)
    return found


def release(*tables: DataFrame) -> None:
    """Remove tables of `cut` and `bucketed` that no plan to come will read."""
    for found in tables:
        if found.table_name:
            found.sparkSession.sql(f"DROP TABLE IF EXISTS {found.table_name}")
        drop_dir(found.sparkSession, found.written_to)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours below the shared one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc32_of(column: str):
    """crc32 of a column's text, the split that the contracts use to hold rows out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Written tables of at most so many bytes on disk are broadcast, larger ones shuffled.
BROADCAST_BYTES = 4 << 20


def written_bytes(found: DataFrame) -> int:
    """Size on disk of a table of `cut`."""
    hadoop = found.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(found.written_to)
    return hadoop.getFileSystem(found.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()


def joined(large: DataFrame, small: DataFrame, keys, how: str) -> DataFrame:
    """A join whose small side, a table of `cut`, is broadcast if it is within the bound."""
    return large.join(F.broadcast(small) if written_bytes(small) <= BROADCAST_BYTES else small, keys, how)


def shuffle_parts(spark: SparkSession, size: int = 0, each: int = 64 << 20) -> int:
    """Parts of a shuffle of so many bytes: those of the session, or more if a part would be over `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def portions(batch: pa.RecordBatch, column: str = "text", most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many bytes of a text column; a longer text is a slice of its own."""
    after, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(after, (after[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def free_memory() -> None:
    """Give what a Python worker no longer uses back to the system; workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(function: Callable) -> Callable:
    """A function over the batches of a task that leaves the worker as small as it found it."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            free_memory()

    return run
