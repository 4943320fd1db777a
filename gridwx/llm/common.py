"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Word hashes kept per Python worker before the table is dropped and refilled.
MEMO_LIMIT = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset, local mode gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path.isDefined():
        return path.get().rstrip("/")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


#: Takes the paths of the tables that stage() writes, where somebody collects them in this thread.
_COLLECTED: ContextVar[list[str] | None] = ContextVar("collected", default=None)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of the tables that stage() writes inside, in this thread: for a caller who deletes them."""
    paths: list[str] = []
    token = _COLLECTED.set(paths)
    try:
        yield paths
    finally:
        _COLLECTED.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that stage() wrote and nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors, computes Python once."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    if (collected := _COLLECTED.get()) is not None:
        collected.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class HashMemo(dict):
    """word (bytes) -> unsigned 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


    def of_text(self, raw: bytes, step: int = 1 << 20) -> np.ndarray:
        """Hashes of the words between ASCII white space, a long text's words step by step."""
        if len(raw) <= step:
            return self.hashes(raw.split())
        parts, at = [], 0
        while at < len(raw):
            gap = _GAP.search(raw, at + step)
            end = gap.start() if gap else len(raw)
            parts.append(self.hashes(raw[at:end].split()))
            at = end
        return np.concatenate(parts)


_GAP = re.compile(rb"[\x20\x09-\x0d]")
WORD_HASHES = HashMemo()
#: What empties the words that a worker remembers, by what remembers them.
MEMOS: dict[str, Callable[[], None]] = {"hashes": WORD_HASHES.clear}


def release() -> None:
    """Give back to the machine what is freed but kept by Arrow and the C library: an executor's workers share its memory, and
    those that wait for a task count too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def remember(name: str) -> None:
    """Workers serve one stage after another; this empties what those before have left but for `name`, and gives it back."""
    for other, clear in MEMOS.items():
        if other != name:
            clear()
    release()


def rolling(h: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of n consecutive word hashes; empty when there are fewer. A polynomial over 64-bit words, then mixed."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    # doubling builds windows of any length in log2(n) passes
    have, width, out, out_width = h, 1, None, 0
    power = seed | 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, out_width = have, width
            else:
                m = min(len(out), len(have) - out_width)
                out = out[:m] * np.uint64(power) + have[out_width : out_width + m]
                out_width += width
        rest >>= 1
        if rest:
            m = len(have) - width
            have = have[:m] * np.uint64(power) + have[width : width + m]
            power = power * power % (1 << 64)
            width *= 2
    return mix64(out[: len(h) - n + 1])


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64), pa.int64())


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches with these starts and sizes, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and sizes, one after another."""
    return flat[stretches(starts, sizes)]


class Lists:
    """Numbered lists of integers, one after another in an array that grows."""

    def __init__(self, kind: str) -> None:
        self.flat, self.used = np.empty(1 << 16, kind), 0
        self.starts, self.sizes, self.n = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None) -> None:
        """Lists of these sizes, which stand in flat one after another or at `starts`."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(self.used + len(flat), self.flat.dtype)))
        if self.n + len(sizes) > len(self.sizes):
            more = np.empty(self.n + len(sizes), np.int64)
            self.starts, self.sizes = np.concatenate((self.starts[: self.n], more)), np.concatenate((self.sizes[: self.n], more))
        new = slice(self.n, self.n + len(sizes))
        self.sizes[new] = sizes
        self.starts[new] = self.used + (np.cumsum(sizes) - sizes if starts is None else starts)
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += len(sizes)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists with these numbers, one after another, and their sizes."""
        sizes = self.sizes[numbers]
        return ragged(self.flat, self.starts[numbers], sizes), sizes


def newest(numbers: dict[str, int], before: int) -> list[str]:
    """The keys that a numbering dictionary got after it had `before`."""
    found = list(islice(reversed(numbers), len(numbers) - before))
    found.reverse()
    return found


def binary_array(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value per list of integers; the lists stand in flat one after another."""
    offsets = np.concatenate(([0], np.cumsum(sizes))) * flat.dtype.itemsize
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    raise ValueError("2 GB of integers or more in one batch")


def flat_values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """binary_array()'s integers, and how many each value has; a null counts as empty."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
    return raw.view(kind), np.diff(at) // np.dtype(kind).itemsize
