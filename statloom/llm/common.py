"""Shared helpers: scratch tables, word arrays and session-sized partition counts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space is the only separator; bytes.split() splits at just these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch.
BATCH_ROWS = 2000
#: Shuffle partitions for each file of a table that is written in few files.
PARTITIONS_A_FILE = 8
#: Words kept in a worker's hash cache before it starts anew, and bytes up to which one is kept.
CACHE_WORDS, CACHE_LONG = 150_000, 200


class Scratch:
    """Parquet tables in the shared folder of ``spark.checkpoint.dir``; they cut lineage and survive lost executors.

    Only where the setting is absent (tests, one machine) a temporary folder is set.
    With ``few``, tasks write several partitions one after another, into so many files for each core at least: a file for each partition would be small, and each costs processes on a local disk.
    ``drop`` deletes a table once nothing reads it any more; results may be read as long as the driver lives, so the rest goes when it ends.
    """

    def __init__(self, spark: SparkSession, name: str, few: int = 0):
        self.spark, self.few = spark, few
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.gettempdir() + "/statloom-scratch"
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:  # whole texts are large rows
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._delete, self.root, True)

    def save(self, df: DataFrame, few: int | None = None) -> DataFrame:
        """Write ``df`` and read it again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        if few := self.few if few is None else few:
            df = df.coalesce(max(few * self.spark.sparkContext.defaultParallelism, -(-partitions(self.spark) // PARTITIONS_A_FILE)))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.paths.pop(id(t), None):
                self._delete(found[1])

    def _delete(self, path: str, ending: bool = False) -> None:
        with contextlib.suppress(Exception) if ending else contextlib.nullcontext():  # the JVM may be gone by then
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, which the cluster sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """A unique long for each row; save the result before it is read twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def hash_share(share: float, *columns: str | Column) -> Column:
    """Whether a row's 64-bit hash is among the least share of all hashes; exact to 2**-64, so a bounded number of however many rows can be chosen."""
    if share >= 1.0:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(int(share * 2**64) - 2**63).cast("long")


class WordHashes(dict):
    """Word bytes -> 64-bit hash, bounded by ``CACHE_WORDS`` words of ``CACHE_LONG`` bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_LONG:
            self[word] = value
        return value


_hashes = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes add up to about ``most``; a larger single value is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser over an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd bases of the polynomial hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
SECOND_BASE = np.uint64(0xD6E8FEB86659FD93)


def rolling(words: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every run of ``k`` entries, from prefix sums and powers of the base."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(words), base, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
    return mix((sums[k:] - sums[:-k])[:n] * back)
