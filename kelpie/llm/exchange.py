"""Exchange of hashed keys between blocks of documents and buckets of keys.

Operators that need a count or a minimum over the whole corpus for every n-gram of every text work on blocks: a block
is some megabytes of documents, packed into one row.  Each block reduces its keys to distinct sorted ones, sends every
bucket (a range of the hash) one row of packed keys and values, gets one row of packed answers back in the same order,
and is joined with its answers.  So no key is hot: a key that a third of all rows hold comes at most once per block.

Keys keep BITS bits besides those that name the bucket; buckets grow with the data, and so does what tells keys apart.
A bucket of BUCKET_KEYS keys has a pair that cannot be told apart with a probability of BUCKET_KEYS**2 / 2**(BITS + 1),
0.4 %: about one key in 190 million counts with another.  An operator that must not miss a key sends a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, encode, partitions, settle, text_or_empty

#: Bytes of text of one block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of the input per partition of blocks, at most about.
PARTITION_BYTES = 128 << 20
BITS = 48
#: Distinct keys that one bucket gets from all blocks, about.
BUCKET_KEYS = 1_500_000
LEAST_BUCKETS = 64


def squeeze(data: bytes, level: int = 1) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def pack_rows(ids: list, texts: list[bytes]) -> bytes:
    """Documents of a block as one value; ids may be null."""
    table = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return squeeze(sink.getvalue().to_pybytes(), 3)


def unpack_rows(payload: bytes) -> tuple[list, list[bytes]]:
    table = pa.ipc.open_stream(expand(payload)).read_all()
    return table.column(0).to_pylist(), table.column(1).to_pylist()


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload, n_bytes), dealt out by block and written once to the shared folder.

    Block numbers are then fixed, and a join on them moves the other side only: texts travel once.
    """
    spark = bounded(docs.sparkSession)
    parts = partitions(docs, PARTITION_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack_rows(ids, texts)], pa.binary()), pa.array([size], pa.int64())], ["block", "payload", "n_bytes"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                if ids and size + len(text) > block_bytes:
                    yield close()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text) + 1
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    # An adaptive plan does not tell how its result is dealt out, and joins would deal the texts out again.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settle(rows.mapInArrow(run, "block long, payload binary, n_bytes long").repartition(parts, "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def bucket_bits(keys: float) -> int:
    """How many leading bits of a key name its bucket."""
    return max(LEAST_BUCKETS.bit_length() - 1, math.ceil(math.log2(max(1.0, keys / BUCKET_KEYS))))


def shorten(keys: np.ndarray, bits: int, kept: int = BITS) -> np.ndarray:
    """Keys without the bits that are not kept."""
    drop = np.uint64(max(0, 64 - bits - kept))
    return keys >> drop << drop


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Values below 256**width byte by byte, the lowest of all first: high bytes are mostly zero and pack to nothing."""
    raw = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width]
    return squeeze(np.ascontiguousarray(raw.T).tobytes())


def from_planes(data: bytes, width: int = 8) -> np.ndarray:
    raw = np.frombuffer(expand(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def split(keys: np.ndarray, bits: int, kept: int = BITS) -> Iterator[tuple[int, slice, bytes]]:
    """(bucket, where, packed keys) of sorted, shortened keys; what is packed are the steps from key to key."""
    names = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(names)) + 1
    local = keys << np.uint64(bits) >> np.uint64(64 - kept)
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
        if b > a:
            yield int(names[a]), slice(a, b), planes(np.diff(local[a:b], prepend=np.uint64(0)), kept // 8)


def unpack_keys(packed: bytes, kept: int = BITS) -> np.ndarray:
    return np.cumsum(from_planes(packed, kept // 8), dtype=np.uint64)


def merge(packed: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """For the keys of all rows in turn the number of each distinct key, and the rows' sizes."""
    parts = [unpack_keys(p) for p in packed]
    return distinct(np.concatenate(parts))[2], [len(x) for x in parts]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of every value among them.

    Unlike ``numpy.unique`` it does not look for the first place, for which that sorts several times slower.
    """
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.empty(len(values), dtype=bool)
    fresh[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    number = np.empty(len(values), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], number


def number_pairs(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each (key, check) among the sorted distinct ones, and the place of the first of each."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, order[fresh]


def gathered(answers: DataFrame) -> DataFrame:
    """(block, answer): a block's answers in the order of its buckets, which is that of its sorted keys."""
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("a")).select("block", F.transform("a", lambda x: x["answer"]).alias("answers"))


def answer_bytes(values: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(values).tobytes())


def joined_answers(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(expand, parts)), dtype=kind) if parts else np.zeros(0, dtype=kind)


def with_answers(own: DataFrame, answers: DataFrame | None, run: Callable[[int, bytes, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs over each block with its answers; blocks without keys come with none."""
    rows = own.select("block", "payload")
    if answers is None:
        rows = rows.withColumn("answers", F.expr("cast(null as array<binary>)"))
    else:
        rows = rows.join(gathered(answers), "block", "left").select("block", "payload", "answers")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, parts in zip(*(batch.column(c) for c in ("block", "payload", "answers"))):
                yield from run(block.as_py(), payload.as_py(), parts.as_py() or [])

    return rows.mapInArrow(over, schema)
