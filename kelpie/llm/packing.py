"""Packing of tokenised documents into fixed sequences.

A document is its ids followed by one end id.  It is cut at multiples of the sequence length; whole pieces fill a
sequence each, without a shuffle, and what is left over is packed first-fit decreasing with a tournament tree over bin
capacities, in randomised groups of documents that tasks handle independently.

Nulls and empty texts are one end id.  Repeated doc_ids are separate documents.  A document's deal is drawn from its
doc_id and its place in its input partition, so that repeated rows part; which sequence a piece gets therefore depends
on how the input is partitioned, what the pieces are does not.  Ties in length are broken by the deal and then by order.
An empty table gives no rows; other columns are ignored.  Only lengths travel: ids stay in the task that made them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded, mix, settle

LENGTH = 1024
END_ID = 0
#: Leftover pieces that one group packs, about; a group's memory and time follow it.
GROUP = 16384


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item in the given order, and the number of bins; items must be sorted by falling size.

    A tournament tree holds the largest free capacity below each node; the leftmost bin that fits is found by one
    descent.
    """
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets, used = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    for item, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        place = node - width
        bins[item], offsets[item] = place, capacity - tree[node]
        used = max(used, place + 1)
        tree[node] -= size
        node >>= 1
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
    return bins, offsets, used


def pieces(docs: DataFrame, json_path: str, ranks_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and ``deal``, a random number of the document."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())):
                ids = np.append(tokens.encode(text or "", json_path, ranks_path), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                deal = mix(np.array([(doc or 0) * 2654435761 + seen + at & (1 << 63) - 1], dtype=np.uint64)).view(np.int64)[0]
                for start in range(0, n, length):
                    part = ids[start : start + length]
                    for out, value in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), n, int(deal))):
                        out.append(value)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
    )


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows of ``pieces``.

    Whole pieces are sequences of their own and stay where they are: they get odd numbers.  The others are dealt into
    groups; a group's sequences get even numbers in strides, so that no group's depend on another's size.
    """
    cut = settle(cut)
    whole = cut.where(F.col("length") == length).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = cut.where(F.col("length") < length)
    groups = max(1, math.ceil(rest.count() / group))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        deal, size, start = (table.column(c).to_numpy() for c in ("deal", "length", "start"))
        order = np.lexsort((start, deal, -size))
        place, offset = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        place[order], offset[order], _ = first_fit_decreasing(size[order], length)
        table = table.drop_columns(["deal", "dealt"])
        return table.append_column("sequence_id", pa.array(2 * (place * groups + number))).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("dealt", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("dealt").applyInArrow(run, SCHEMA))


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Every piece of every document with its place; see the module's text."""
    return pack(pieces(docs, tokens.vocabulary(f"{vocabulary}.json"), tokens.vocabulary(f"{vocabulary}.tiktoken"), length), length)
