"""Shared pieces of the text operators: shared storage, Arrow text access and rolling hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 19
#: Odd base of the polynomial hashes (modulo 2**64), and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Rows and bytes of an Arrow batch, at most (a longer row is a batch of its own).  The defaults, 10,000 rows and 64 MB or
#: more, would put that many whole texts into one message to a Python worker, and as much again beside the heap of the JVM.
BATCH = {"maxRecordsPerBatch": 1_000, "maxBytesPerBatch": 1 << 21}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch to ``BATCH``; a session that asks for less keeps its own number."""
    for name, most in BATCH.items():
        name = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name).lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.  A cluster names it in ``spark.checkpoint.dir``; only a local session
    may go without and gets a temporary one."""
    bounded_batches(spark)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-"))
    return context.getCheckpointDir()


#: Spark (4.1 on; older ones do not know it) removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession):
    """Shuffle files of what is written inside go when it is written.  Otherwise they stay until the driver happens to
    collect its garbage, and those of all tables of a stage add up on the executors' disks."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2.  A null id counts as empty text and is not held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def trim() -> None:
    """Give this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        give = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give is not None:
            give(0)


def release(spark: SparkSession) -> None:
    """Collect the garbage of the driver, Python's and the JVM's.  What planning and watching the tasks of one table leaves
    is dead when it is written, but the JVM would let its heap grow over it up to the limit, table after table; a whole
    collection gives back what live objects do not need."""
    trim()
    spark.sparkContext._jvm.System.gc()


def lean(run):
    """``run`` for ``mapInArrow``; when a partition ends, the worker gives its free memory back to the system.  Workers wait
    for tasks of later stages, and what they keep adds up beside those tasks."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string (as UTF-8) or binary column and the offsets of its rows (one more than rows).  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    large = column.cast(pa.large_binary() if binary else pa.large_string())
    n = len(large)
    buffers = large.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[large.offset : large.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes together, at least one row each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((BASE, INVERSE)):
            steps_ = np.full(size, base, np.uint64)
            steps_[0] = 1
            _POWERS[k] = np.cumprod(steps_, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; see ``span_hashes``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, the same wherever the span stands."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


#: A prime and a base of it (fixed values).  Modulo a power of two, some long words are equal under every odd base.
PRIME, PRIME_BASE = (1 << 31) - 1, 1_103_515_245
_RESIDUES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def residues(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and PRIME_BASE**-i modulo PRIME for i < n."""
    for k, base in enumerate((PRIME_BASE, pow(PRIME_BASE, -1, PRIME))):
        while len(_RESIDUES[k]) < n:
            own = _RESIDUES[k]
            _RESIDUES[k] = np.concatenate([own, own * np.uint64(pow(base, len(own), PRIME)) % np.uint64(PRIME)])
    return _RESIDUES[0][:n], _RESIDUES[1][:n]


def sound_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans from two polynomials, one modulo 2**64 and one modulo a prime, and the length."""
    power, inverse = residues(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1] % np.uint64(PRIME), dtype=np.uint64, out=sums[1:])
    second = (sums[ends] - sums[starts]) % np.uint64(PRIME) * inverse[starts] % np.uint64(PRIME)
    first = span_hashes(prefix_hashes(data), starts, ends)
    return mix(first ^ mix(second << np.uint64(32) ^ (ends - starts).astype(np.uint64)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table() -> np.ndarray:
    """Per byte: 1 in a word (ASCII letters and digits, and every byte of a non-ASCII character)."""
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[65:91] = out[128:] = True
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


WORD, LOWER = word_table(), lower_table()


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some rows (words never cross rows), and for each row the first of its words."""
    inside = WORD[data] if inside is None else inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)
