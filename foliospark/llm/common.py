"""Shared plumbing: scratch tables, Arrow batch slicing and hashed word streams.

Everything that runs on executors works on slices of an Arrow batch of bounded
size, so a worker's memory does not follow the batch size Spark happens to use.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 2 << 20
#: Entries that a worker keeps in a word cache before it starts anew.
CACHE_WORDS = 400_000

#: Spark's setting by which a query removes its shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Scratch:
    """Tables in the folder that all executors share (``spark.checkpoint.dir``).

    ``keep`` writes a frame as Parquet and reads it again, which cuts the lineage and
    survives lost executors. ``drop`` deletes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            root = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="foliospark-")
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.names: dict[str, str] = {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes ``frame`` and reads it again; the shuffle files of its plan go when the write ends."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._scratch_path = path
        self.names[path] = name
        return kept

    def drop(self, *frames: DataFrame) -> None:
        self._delete(frame._scratch_path for frame in frames)

    def drop_but(self, *names: str) -> None:
        """Deletes all tables that are left but those of these names."""
        self._delete([path for path, name in self.names.items() if name not in names])

    def _delete(self, paths: Iterable[str]) -> None:
        for name in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.pop(name, None)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets(batch.column(column))[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else ends[0] - ends[0]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    """Byte lengths as offsets from 0; nulls count as empty."""
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The rows of a text column as UTF-8 bytes; nulls become empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word (bytes) -> XXH64 as int, kept for the words of late."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps around)."""
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


def rolling(symbols: np.ndarray, size: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Hash of every run of ``size`` consecutive symbols (uint64), by doubling; shorter input gives none."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, part, length = None, 0, symbols, 1
    power = np.uint64(base)
    while True:  # binary decomposition of size: part holds hashes of runs of `length`
        if size & length:
            if out is None:
                out, have = part, length
            else:
                m = len(symbols) - (have + length) + 1
                out = out[:m] * power + part[have : have + m]
                have += length
        if have == size:
            return mixed(out[:n])
        m = len(symbols) - 2 * length + 1
        part = part[:m] * power + part[length : length + m]
        power = np.uint64(pow(int(power), 2, 1 << 64) | 1)
        length *= 2


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    part, length = values, 1
    while length * 2 <= size:
        part = np.minimum(part[:-length], part[length:])
        length *= 2
    rest = size - length
    return np.minimum(part[:n], part[rest : rest + n])


def inside(starts: np.ndarray, lengths: np.ndarray, size: int, total: int) -> np.ndarray:
    """True at each position of the concatenation where a run of ``size`` stays within its item."""
    ok = np.zeros(total + 1, np.int32)
    long = lengths >= size
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, starts[long] + lengths[long] - size + 1, -1)
    return np.cumsum(ok[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array for each row."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in values], dtype=np.int64)))
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))
