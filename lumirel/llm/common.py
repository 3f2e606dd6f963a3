"""What several operators share: the shared folder, text batches, hashes and the bounded routing filter."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the routing filter: 2**26 bits are 8 MB, whatever the size of the data.
ROUTE_BITS = 1 << 26
#: Bytes of text that are turned into arrays at once.
CHUNK_BYTES = 1 << 20
#: Rows and bytes that Spark hands to Python at once.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: One arena and no caches of freed memory in Python workers, and one thread each, as Spark fills the cores.
WORKER_ENVIRONMENT = {
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": "1048576",
    "MALLOC_TRIM_THRESHOLD_": "1048576",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "OMP_NUM_THREADS": "1",
    "OPENBLAS_NUM_THREADS": "1",
}
#: Parts that the rows of a hot key are dealt into before a join.
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a session of one machine gets a temporary folder; on a cluster, where
    such a folder would be one machine's own, it is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumirel-{name}-{uuid.uuid4().hex}"


def text_batches(spark: SparkSession) -> None:
    """Sets what bounds the memory of Python workers: the session's Arrow batches, and how workers hold freed memory.

    Rows here hold whole texts, so memory follows the batch. Workers are told to give blocks
    back as soon as they are free, since they live on beside a heap that has grown; settings of
    the environment reach workers that start later, and each set of them has workers of its own,
    so every operator sets the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.update(WORKER_ENVIRONMENT)


def kind(df: DataFrame, column: str) -> str:
    """The type of a column, as in a schema string."""
    return df.schema[column].dataType.simpleString()


def tidy(f: Callable) -> Callable:
    """A function over batches that gives its memory back when a task ends, as Python workers live on and serve later stages."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def cut(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """The frame's rows, written to the shared folder and read again: lost executors cost no recomputation, and lineage ends here.

    A table is read with its true size. A checkpoint keeps the planner's estimate of its origin, and estimates of joins are
    products, so that in a loop of joins they grow without end. scratch takes the table's path, for remove().
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    sc = spark.sparkContext
    for path in scratch:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    scratch.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def route_mark(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = ROUTE_BITS) -> DataFrame:
    """(row, routed): each row as a struct, and whether its key is among the wanted keys: true for all that are, and few others.

    The wanted keys are hashed into a bitmap of a fixed number of bits, so what is
    broadcast has a proven bound (bits / 8 bytes) at any data size; a filter that fills
    up routes more rows and changes no result, as the caller matches exactly later. Rows are
    structs so that no name of theirs meets a name of this function.
    """

    def slot(k: Column) -> Column:
        return F.pmod(F.xxhash64(k), F.lit(bits)) + 1

    marks = (
        wanted.select(slot(wanted_key).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marks"))
    )
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.select(F.struct(*_quoted(rows)).alias("row"), slot(key).alias("slot"))
        .withColumn("bucket", F.bitmap_bucket_number("slot"))
        .join(F.broadcast(marks), "bucket", "left")
        .select("row", byte.alias("byte"), F.pmod(at, F.lit(8)).cast("int").alias("bit"))
        .select("row", F.coalesce(F.expr("shiftright(byte, bit) & 1") == 1, F.lit(False)).alias("routed"))
    )


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def route_filter(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, bits: int = ROUTE_BITS) -> DataFrame:
    """Rows whose key may be among the wanted keys: all that are, and few others (see route_mark)."""
    return route_mark(rows, key, wanted, wanted_key, bits).filter("routed").select("row.*")


def join_hot(rows: DataFrame, lookup: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with lookup, which has few rows a key, by equal columns; a key that many rows share is dealt over tasks by the column spread."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [*on, "salt"], how).drop("salt")


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters each; a longer text has a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit value over the whole value."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 1 << 10
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans.

    A span goes through a mixer in blocks of eight bytes, one after the other. The mixer isn't
    linear, so spans don't collide by a rule of how their letters follow each other, as they do
    under sums of powers modulo 2**64; spans of up to eight bytes collide by chance alone
    with those of other lengths, and never among themselves.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    sizes = ends - starts
    h = mix64(sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9E3779B97F4A7C15))
    h = mix64(h ^ (blocks[starts] & _LOW_BYTES[np.minimum(sizes, 8)]))
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG_SPAN))
    at = 8
    while len(left):
        h[left] = mix64((h[left] + np.uint64(0xD6E8FEB86659FD93)) ^ (blocks[starts[left] + at] & _LOW_BYTES[np.minimum(sizes[left] - at, 8)]))
        at += 8
        left = left[sizes[left] > at]
    for i in np.flatnonzero(sizes > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in bytes."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = SPACE[data]
    turn = np.diff(gap)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9FB21C651E98DF25)
        h += words[k : k + n]
    return mix64(h)
