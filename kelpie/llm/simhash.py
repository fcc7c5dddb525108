"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint is the bitwise majority over the XXH64 values of a text's word shingles.  Links (at most
``radius`` differing bits) are found with 2**(radius+1)-1 masks: bit position i gets a vector m(i) of radius+1 bits
and the mask of a non-zero vector v keeps the positions where the scalar product <m(i), v> is odd.  Whatever at most
``radius`` positions differ, their vectors leave some non-zero v orthogonal to all of them, so the pair agrees on the
whole mask of v: every linked pair meets in some table, without exception.

Nulls and empty texts have the fingerprint zero and link with each other like any other value.  Rows of one document
may repeat; a component is over fingerprints, so repeats share it, and rows of one doc_id with different texts are told
apart.  A row whose doc_id is null links like any other and names no component; a component of such rows only has none.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, column_bytes, renamed, settle
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Groups up to this size are linked by comparing neighbours at every offset; larger ones by search.
SMALL_GROUP = 8
#: Groups beyond this size are split again by a second family of masks.
LARGE_GROUP = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text (UTF-8)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), 255):  # sums of up to 255 ones fit a byte
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    ones = np.packbits(counts * 2 > len(values), bitorder="little")
    return int(ones.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``keep`` and fp, the fingerprint as a signed long; one row per input row."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle, seed) for t in column_bytes(batch.column("__text"))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found.view(np.int64))], [*keep, "fp"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "fp long"]))


def masks(radius: int, turn: int = 0) -> list[int]:
    """The covering masks over 64 positions; ``turn`` gives another, equally covering, family."""
    size = 1 << (radius + 1)
    if turn:
        order = np.random.default_rng(turn).permutation(64)
    else:
        order = np.arange(64)
    vectors = [int(order[i]) % (size - 1) + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() & 1) for v in range(1, size)]


def _search(values: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """Local components as (members, root) over positions, each reached by direct links."""
    left = np.arange(len(values))
    out = []
    while len(left):
        root, members, queue = int(left[0]), [], [int(left[0])]
        left = left[1:]
        while queue and len(left):
            near = np.bitwise_count(values[left] ^ values[queue.pop()]) <= radius
            if near.any():
                got = left[near]
                members.append(got)
                queue.extend(got.tolist())
                left = left[~near]
        if members:
            out.append((np.concatenate(members), root))
    return out


def _split_search(values: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """Like ``_search``, but a large group is first dealt out by a second covering family, so no pair is lost."""
    if len(values) <= LARGE_GROUP:
        return _search(values, radius)
    out = []
    for mask in masks(radius, turn=1):
        key = values & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                out += [(part[members], int(part[root])) for members, root in _search(values[part], radius)]
    return out


def link_groups(keys: np.ndarray, values: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ids whose values lie within ``radius`` and share a key; a large group gives a forest, never all its pairs."""
    order = np.argsort(keys, kind="stable")
    keys, values, ids = keys[order], values[order], ids[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    sizes = np.diff(cuts)
    a, b = [], []
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL_GROUP))
    if len(small):
        rows = np.flatnonzero(np.isin(group, small))
        for step in range(1, int(sizes[small].max())):
            left, right = rows[:-step], rows[step:]
            hit = (group[left] == group[right]) & (np.bitwise_count(values[left] ^ values[right]) <= radius)
            a.append(ids[left[hit]])
            b.append(ids[right[hit]])
    for g in np.flatnonzero(sizes > SMALL_GROUP):
        at = slice(cuts[g], cuts[g + 1])
        for members, root in _split_search(values[at], radius):
            a.append(ids[at][members])
            b.append(np.full(len(members), ids[at][root]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between fingerprints that connect whatever is linked; ``unique`` has one row (fp) per distinct one."""
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks(radius))))
    rows = unique.select("fp", F.explode(tables).alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        k, fp = (table.column(c).to_numpy() for c in ("k", "fp"))
        a, b = link_groups(k, fp.view(np.uint64), fp, radius)
        if len(a):
            pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    # Rows of one key meet in one partition; the key is a hash, and a false meeting is undone by comparing fingerprints.
    return rows.repartition("k").mapInArrow(run, "a long, b long")


def least_of_components(marked: DataFrame, value: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, least): of every fingerprint in ``marked`` the smallest value of its component's rows, null if it has none."""
    unique = settle(marked.groupBy("fp").agg(F.min(value).alias("least")))
    named = unique.join(connected_components(links(unique.select("fp"), radius)).withColumnRenamed("node", "fp"), "fp", "left")
    # Settled, so that a component of a third of all fingerprints can be split in the join.
    least = settle(named.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("among")))
    return named.join(least, "component", "left").select("fp", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("among")).alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component is the smallest doc_id reachable over links."""
    marked = settle(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, seed))
    member = least_of_components(marked, F.col("doc_id"), radius)
    return marked.join(member, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """Of each component one row with all its columns: that of the smallest doc_id, null ids last, then of the smallest
    digest of the text.  Rows of one doc_id and one text are repeats, of which the one of the smallest hash stays; rows
    of one doc_id with texts that do not link all stay.
    """
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows, name = renamed(docs)
    rows = rows.withColumns({"id": F.col(name["doc_id"]).cast("long"), "sha": F.sha2(F.coalesce(F.col(name["text"]).cast("string"), F.lit("")), 256)})
    marked = settle(fingerprints(docs.select(F.col("doc_id").cast("long").alias("id"), sha.alias("sha"), "text"), shingle, seed, ("id", "sha")))
    first = least_of_components(marked, F.struct(F.col("id").isNull().alias("nameless"), "id", "sha"), radius)
    chosen = first.select(F.col("least.id").alias("chosen"), F.col("least.sha").alias("digest")).distinct()
    kept = rows.join(chosen, rows.id.eqNullSafe(F.col("chosen")) & (rows.sha == F.col("digest")), "left_semi")
    own = list(name.values())
    ordered = [c for c, kind in kept.dtypes if c in own and "map<" not in kind]
    one = kept.groupBy("id", "sha").agg(F.min_by(F.struct(*own), F.struct(F.xxhash64(*ordered), *(c for c in ordered))).alias("row"))
    return one.select(*(F.col(f"row.{c}").alias(own) for own, c in name.items()))
