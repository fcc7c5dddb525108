"""Shared helpers: table access, lineage cuts, Arrow plumbing and byte-level text kernels."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, whatever the row count.
BATCH_BYTES = 16 << 20
#: Bytes of text that one numpy pass works on; arrays of eight bytes a character stay small.
PASS_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; everything goes through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, since one text can be as long as thousands of others."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's checkpoint folder or the one that ``spark.checkpoint.dir`` names.

    One of its own is made only where none is named and driver and executors are one process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc._jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kelpie-checkpoint-"))
    return sc.getCheckpointDir()


#: Whether Spark (from 4.1 on) removes what a query has shuffled once it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, lean: bool = False) -> DataFrame:
    """Cuts lineage in the shared folder; ``lean`` also removes what was shuffled on the way, which the result no longer needs."""
    shared_folder(df.sparkSession)
    if not lean:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        # A query is told when it is made, so this one is made anew.
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def table(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written as a table in the shared folder and read again, and its path.

    Unlike a checkpoint, which goes on with the sizes that the planner guessed for its plan, a table has sizes of its
    own.  Loops need that: guesses for joins multiply from round to round until they have millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kelpie-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(df: DataFrame, each: int) -> int:
    """As many partitions as keep each at about ``each`` bytes by the planner's estimate; the session's number at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An operator without statistics is estimated as almost endless.
    return max(least, min(math.ceil(size / each), 1 << 20)) if size < 1 << 60 else least


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ... that clash with no name an operator uses, and the new name of each."""
    name = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*name.values()), name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def encode(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column without a detour through str."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def passes(sizes: list[int], most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of items whose sizes add up to at most ``most`` (or of one larger item)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _odd_table(seed: int) -> np.ndarray:
    """256 well-mixed odd values from a splitmix sequence."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; wraps."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n; kept per process."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PASS_BYTES + 4096)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


TABLE = _odd_table(0xD1342543DE82EF95)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a sequence of 64-bit values, from prefix sums of value * BASE**i."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of several texts: byte spans, hashes and, per text, where its words begin."""

    __slots__ = ("buffer", "starts", "ends", "first", "hashes")

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b"\n".join(texts)
        self.buffer = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            self.buffer = LOWER[self.buffer]
        inside = np.empty(len(joined) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~WHITE[self.buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.starts, at)
        self.hashes = span_hashes(TABLE[self.buffer], self.starts, self.ends) if len(self.starts) else np.zeros(0, dtype=np.uint64)
