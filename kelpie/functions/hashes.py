"""Hashes that Spark has no built-in for, as Arrow-batched pandas UDFs; SHA-256 is built in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Where signatures start from (not the usual basis of FNV), and the prime.
FNV_BASIS, FNV_PRIME = 1469598103934665603, 1099511628211
CRC32C_POLYNOMIAL = 0x82F63B78


def fnv1a(data: bytes, value: int = FNV_BASIS) -> int:
    """FNV-1a over 64 bits."""
    for byte in data:
        value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return value


def crc32c_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1)
    return table


@F.pandas_udf(LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32 with the Castagnoli polynomial of binary values, unsigned; all values of a batch advance together."""
    table = crc32c_table()
    raw = [bytes(x) if x is not None else b"" for x in data]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    crc = np.full(len(raw), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    for i in range(int(falling[0]) if len(falling) else 0):
        live = order[: np.searchsorted(-falling, -i, side="left")]
        crc[live] = table[(crc[live] ^ flat[at[live] + i]) & 0xFF] ^ (crc[live] >> np.uint32(8))
    out = (crc ^ np.uint32(0xFFFFFFFF)).astype("int64")
    return pd.Series(out, index=data.index).where(data.notna(), None).astype("Int64")


@F.pandas_udf(StringType())
def xxh3_64(data: pd.Series) -> pd.Series:
    """XXH3 over 64 bits of binary values as 16 hex digits."""
    import xxhash

    return data.map(lambda x: xxhash.xxh3_64_hexdigest(bytes(x)), na_action="ignore")


def fnv1a_many(values: list[bytes], start: np.ndarray | None = None) -> np.ndarray:
    """FNV-1a of many values, each from its own start; all of them advance together, byte by byte."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    out = np.full(len(values), FNV_BASIS, dtype=np.uint64) if start is None else start.copy()
    flat = np.frombuffer(b"".join(values), dtype=np.uint8).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    prime = np.uint64(FNV_PRIME)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        live = order[: np.searchsorted(falling, -i, side="left")]
        out[live] = (out[live] ^ flat[first[live] + i]) * prime
    return out


def _hex(values: np.ndarray, digits: int) -> list[str]:
    return [f"{v:0{digits}x}" for v in (values & np.uint64((1 << 4 * digits) - 1)).tolist()]


@F.pandas_udf(StringType())
def key_set_signature(keys: pd.Series) -> pd.Series:
    """Six hex digits over a set of keys in order, each with a line end: the low 24 bits of FNV-1a; no keys give ''."""
    given = [None if ks is None else sorted(k.encode() for k in ks) for ks in keys]
    found = _hex(fnv1a_many([b"".join(k + b"\n" for k in ks or ()) for ks in given]), 6)
    return pd.Series([None if ks is None else h if ks else "" for ks, h in zip(given, found)], index=keys.index)


@F.pandas_udf(StringType())
def bucket_signature(buckets: pd.Series) -> pd.Series:
    """Twelve hex digits over sorted bucket numbers as eight little-endian bytes each: the low 48 bits of FNV-1a."""
    given = [None if bs is None else np.sort(np.asarray(bs, dtype="<i8")) for bs in buckets]
    found = _hex(fnv1a_many([b"" if bs is None else bs.tobytes() for bs in given]), 12)
    return pd.Series([None if bs is None else h if len(bs) else "" for bs, h in zip(given, found)], index=buckets.index)


def run_signatures(files: DataFrame) -> DataFrame:
    """(stem, sig, read_sig): signatures of a run's keys, and of its files' read signatures in the order of keys.

    Six hex digits each: FNV-1a over the keys with a line end after each, and over the bare read signatures; the latter
    is empty if any file has none.  ``files`` has a row per (stem, key).  Files are sorted in the shuffle and read one
    by one, so a run of any number of files is never gathered.
    """
    rows = files.select(F.col("stem").cast("string").alias("stem"), F.col("key").cast("string").alias("key"), F.coalesce(F.col("read_sig"), F.lit("")).alias("read_sig"))
    dealt = rows.repartition("stem").sortWithinPartitions("stem", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, reads, whole = None, FNV_BASIS, FNV_BASIS, True
        for batch in batches:
            out: list[tuple] = []
            for stem, key, read in zip(*(batch.column(c).to_pylist() for c in ("stem", "key", "read_sig"))):
                if now is not None and stem != now[0]:
                    out.append((now[0], f"{keys & 0xFFFFFF:06x}", f"{reads & 0xFFFFFF:06x}" if whole else ""))
                    keys, reads, whole = FNV_BASIS, FNV_BASIS, True
                now = (stem,)
                keys = fnv1a((key or "").encode() + b"\n", keys)
                whole = whole and read != ""
                reads = fnv1a(read.encode(), reads) if whole else reads
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["stem", "sig", "read_sig"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (now[0], f"{keys & 0xFFFFFF:06x}", f"{reads & 0xFFFFFF:06x}" if whole else "")], ["stem", "sig", "read_sig"])

    return dealt.mapInArrow(run, "stem string, sig string, read_sig string")


def _bare(text: Column) -> Column:
    return F.lower(F.trim(text))


def machine_hash(salt: Column, host: Column) -> Column:
    """The salted hash that stands for a machine."""
    from .urls import salted_hash

    return salted_hash(salt, F.concat(F.lit("machine:"), _bare(host)))


def location_hash(salt: Column, host: Column, path: Column) -> Column:
    """The salted hash that stands for a folder of a machine."""
    from .urls import posix_path, salted_hash

    return salted_hash(salt, F.concat(F.lit("location:"), _bare(host), F.lit("\x00"), posix_path(path)))


def volume_hash(salt: Column, host: Column, mount: Column) -> Column:
    """The salted hash that stands for a mounted volume of a machine."""
    from .urls import posix_path, salted_hash

    return salted_hash(salt, F.concat(F.lit("volume:"), _bare(host), F.lit("\x00"), posix_path(mount)))
