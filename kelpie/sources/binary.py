"""Binary records: cache sidecars and slot-store blocks, as Arrow-batched readers over ``binaryFile``.

A sidecar is little-endian: a 56-byte header, the key padded to eight bytes, a page bitmap (lowest bit first) and a
checksum per page.  What has another version, is cut short, or fails its checksum counts as absent, with the reason.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.hashes import crc32c_table

# Magics, versions and layouts of the formats.
SIDECAR_MAGIC, SIDECAR_VERSION = b"UCAC", 1
HEADER = struct.Struct("<4sIIIQQQB3sIII")
BLOCK_MAGIC, BLOCK_ALIGN = b"USBLOCK1", 4096
BLOCK_HEADER, BLOCK_ENTRY = struct.Struct("<8sQQII28xI"), struct.Struct("<IB3xQII")
PINNED, COMPLETE, SIZE_CONFIRMED = 1, 2, 4
SIDECAR = (
    "path string, error string, key string, page_size long, file_size long, atime long, origin_mtime long, cksum_kind int, origin_cksum long, generation long, "
    "pinned boolean, complete boolean, size_confirmed boolean, n_pages long, set_pages long, pages binary, crcs array<long>"
)
_table = crc32c_table().tolist()


def checksum(data: bytes) -> int:
    """CRC-32 with the Castagnoli polynomial of one value."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _table[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def parse_sidecar(data: bytes, with_pages: bool = True, check: bool = True) -> dict:
    """Fields of a sidecar, or its ``error``."""
    if len(data) < HEADER.size:
        return {"error": "short"}
    magic, version, page, flags, size, atime, mtime, kind, generation, cksum, key_len, crc = HEADER.unpack_from(data)
    if magic != SIDECAR_MAGIC or version != SIDECAR_VERSION:
        return {"error": "version"}
    if not 4096 <= page <= 1 << 20 or page & page - 1 or key_len > 1 << 16:
        return {"error": "header"}
    n = -(-size // page)
    at = -(-(HEADER.size + key_len) // 8) * 8
    bits = -(-n // 8)
    if len(data) < at + bits + 4 * n:
        return {"error": "short"}
    if check and checksum(data[:52] + bytes(4) + data[56 : at + bits + 4 * n]) != crc:
        return {"error": "checksum"}
    bitmap = data[at : at + bits]
    pages = np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little", count=n) if n else np.zeros(0, np.uint8)
    return {
        "key": data[HEADER.size : HEADER.size + key_len].decode("utf-8", "replace"), "page_size": page, "file_size": size, "atime": atime, "origin_mtime": mtime, "cksum_kind": kind, "origin_cksum": cksum,
        "generation": int.from_bytes(generation, "little"), "pinned": bool(flags & PINNED), "complete": bool(flags & COMPLETE), "size_confirmed": bool(flags & SIZE_CONFIRMED), "n_pages": n, "set_pages": int(pages.sum()),
        "pages": bitmap if with_pages else None, "crcs": np.frombuffer(data, dtype="<u4", count=n, offset=at + bits).astype(np.int64).tolist() if with_pages else None,
    }


def load_sidecars(spark: SparkSession, path: str, pages: bool = True, check: bool = True) -> DataFrame:
    """One row per ``*.meta`` file below a folder; without ``pages`` the bitmap and checksums are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta").option("recursiveFileLookup", True).load(path)
    names = [f.split(" ")[0] for f in SIDECAR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                row = {"path": name, **parse_sidecar(content.as_py(), pages, check)}
                yield pa.RecordBatch.from_pylist([{n: row.get(n) for n in names}], schema=SIDECAR_ARROW)

    return files.select("path", "content").mapInArrow(run, SIDECAR)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
SIDECAR_ARROW = pa.schema([(f.split(" ")[0], _KINDS[f.split(" ")[1]]) for f in SIDECAR.split(", ")])


def explode_pages(sidecars: DataFrame) -> DataFrame:
    """(key, page, crc) of the pages that are present."""
    rows = sidecars.where("error IS NULL").select("key", "pages", F.posexplode("crcs").alias("page", "crc"))
    byte = F.conv(F.hex(F.expr("substring(pages, page div 8 + 1, 1)")), 16, 10).cast("int")
    return rows.where(F.getbit(byte, F.col("page") % 8) == 1).select("key", "page", "crc")


BLOCKS = "path string, block long, valid boolean, slot long, kind int, off long, len long, crc long"
BLOCKS_ARROW = pa.schema([(f.split(" ")[0], _KINDS[f.split(" ")[1]]) for f in BLOCKS.split(", ")])


def parse_blocks(data: bytes, store_id: int) -> Iterator[tuple[int, bool, int | None, int | None, int | None, int | None, int | None]]:
    """Entries of a store's commit blocks; a bad block is debris, and the scan goes on one alignment later."""
    at = 0
    while at + 64 <= len(data):
        magic, store, length, n, entries_crc, crc = BLOCK_HEADER.unpack_from(data, at)
        end = at + 64 + n * BLOCK_ENTRY.size
        good = magic == BLOCK_MAGIC and store == store_id and end <= len(data) and length >= end - at and checksum(data[at : at + 60]) == crc and checksum(data[at + 64 : end]) == entries_crc
        if not good:
            at += BLOCK_ALIGN
            continue
        for i in range(n):
            slot, kind, off, size, record_crc = BLOCK_ENTRY.unpack_from(data, at + 64 + i * BLOCK_ENTRY.size)
            yield at, True, slot, kind, off, size, record_crc
        at += -(-length // BLOCK_ALIGN) * BLOCK_ALIGN


def load_slot_blocks(spark: SparkSession, path: str, store_id: int, suffix: str = "*.slots") -> DataFrame:
    """One row per slot entry; ``newest_slots`` keeps the last of each slot."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = [(name, *row) for row in parse_blocks(content.as_py(), store_id)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCKS_ARROW)], schema=BLOCKS_ARROW)

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def zigzag_varints(data: bytes) -> list[int]:
    """Signed numbers of a run of base-128 values, lowest group first."""
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            out.append(value >> 1 ^ -(value & 1))
            value = shift = 0
    return out


def delta_decode(data: bytes) -> list[int]:
    """Numbers whose differences are stored."""
    return np.cumsum(np.array(zigzag_varints(data), dtype=np.int64)).tolist()


def scrub(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """(key, pages, bad): pages whose bytes do not have their checksum."""
    from kelpie.functions.hashes import crc32c

    checked = pages.join(contents, ["key", "page"]).withColumn("bad", crc32c("content") != F.col("crc"))
    return checked.groupBy("key").agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad"))
