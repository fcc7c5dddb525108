"""Document fingerprints from prefix polynomial hashes.

For a text of code points c_0, c_1, ... the prefix arrays H[i] = sum of (c_j + 1) * B**j for j < i, modulo two primes,
answer in constant time whether two spans are equal (of one text or of two), and by binary search how far two texts
agree from given places.  A fingerprint holds the hash of the whole text, its length and two sketches: the hashes of
all spans of ``SPAN`` code points, and those of ``SHORT_SPAN``, dealt into bins, of each bin the smallest.  Likeness
compares sketches, those of the short spans if either text is shorter than ``SHORT`` code points, and estimates the share
of content two texts have in common (1 for equal texts).  ``compare_spans`` answers questions about spans of documents.

A null text is empty; two empty texts are alike (1), an empty and another one are not (0).  Documents are taken by
descending doc_id, null ids last, equal ids by text; repeated rows follow each other.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, mix, partitions, text_or_empty

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 24
BINS = 64
BIN_BITS = 12
#: Bytes of the input per range of doc_id, about.
RANGE_BYTES = 128 << 20
EMPTY_BIN = "---"
#: Texts below SHORT code points are compared by spans of SHORT_SPAN in SHORT_BINS bins.
SHORT, SHORT_SPAN, SHORT_BINS = 4 * SPAN, 3, 32

_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(which: int, n: int, sign: int = 1) -> np.ndarray:
    """B**i (or B**-i) modulo the prime, i <= n; grows by doubling and is kept per process."""
    kept = _tables.get((which, sign))
    if kept is None or len(kept) <= n:
        p, kept = PRIMES[which], np.ones(1, dtype=np.uint64)
        while len(kept) <= max(n, 4096):
            kept = np.concatenate([kept, kept * np.uint64(pow(BASES[which], sign * len(kept), p)) % np.uint64(p)])
        _tables[which, sign] = kept
    return kept


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHashes:
    """Prefix arrays of one text."""

    __slots__ = ("n", "arrays")

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        values = codes.astype(np.uint64) + np.uint64(1)
        self.arrays = []
        for which, p in enumerate(PRIMES):
            h = np.zeros(self.n + 1, dtype=np.uint64)
            # Each product is below 2**52 before it is reduced, each sum of 2**31 reduced ones below 2**62.
            np.cumsum(values * _powers(which, self.n)[: self.n] % np.uint64(p), out=h[1:])
            self.arrays.append(h % np.uint64(p))

    def digest(self) -> int:
        return int(self.arrays[0][-1]) << 31 | int(self.arrays[1][-1])

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        """Whether two spans are equal (up to a false yes in about 2**62)."""
        if start + length > self.n or other_start + length > other.n:
            return False
        for which, p in enumerate(PRIMES):
            a = int(self.arrays[which][start + length]) - int(self.arrays[which][start])
            b = int(other.arrays[which][other_start + length]) - int(other.arrays[which][other_start])
            if (a * pow(BASES[which], other_start, p) - b * pow(BASES[which], start, p)) % p:
                return False
        return True

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """The most code points that agree from the two places on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """A hash of every span of that length, whatever its place (of the whole text if it is shorter)."""
        if self.n < length:
            return mix(np.array([self.digest()], dtype=np.uint64)) if self.n else np.zeros(0, dtype=np.uint64)
        parts = []
        for which, p in enumerate(PRIMES):
            h, q = self.arrays[which], np.uint64(p)
            parts.append((h[length:] + q - h[:-length]) % q * _powers(which, self.n, -1)[: self.n - length + 1] % q)
        return mix(parts[0] << np.uint64(31) | parts[1])

    def sketch(self, span: int, bins: int) -> str:
        """Of the hashes of all spans the smallest of each bin, shortened."""
        found = self.spans(span)
        shift = np.uint64(64 - bins.bit_length() + 1)
        found.sort()
        edges = np.arange(bins, dtype=np.uint64) << shift
        first = np.searchsorted(found, edges)
        last = np.append(first[1:], len(found))
        mask = (1 << BIN_BITS) - 1
        low = (mix(found[np.minimum(first, len(found) - 1)]) & np.uint64(mask)).tolist() if len(found) else [0] * bins
        return "".join(f"{v:03x}" if a < b else EMPTY_BIN for v, a, b in zip(low, first.tolist(), last.tolist()))

    def fingerprint(self) -> str:
        """Hash, length and sketches as text; equal texts have equal fingerprints.

        Texts from eight times SHORT on have no sketch of short spans: a short text is at most a fifth of them.
        """
        short = self.sketch(SHORT_SPAN, SHORT_BINS) if self.n < 8 * SHORT else ""
        return f"{self.digest():016x}{self.n:08x}{self.sketch(SPAN, BINS)}{short}"


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of content in common, 2J/(1+J) for the share J of bins that agree."""
    if a == b:
        return 1.0
    low, high = sorted((int(a[16:24], 16), int(b[16:24], 16)))
    if low < SHORT:
        if high >= 8 * SHORT:
            # The two can share no more than all of the shorter one.
            return 0.0
        start, stop = 24 + 3 * BINS, 24 + 3 * (BINS + SHORT_BINS)
    else:
        start, stop = 24, 24 + 3 * BINS
    x, y = ([s[i : i + 3] for i in range(start, stop, 3)] for s in (a, b))
    filled = [(p, q) for p, q in zip(x, y) if p != EMPTY_BIN or q != EMPTY_BIN]
    if not filled:
        return 0.0
    j = sum(p == q for p, q in filled) / len(filled)
    return 2 * j / (1 + j)


def _buckets(docs: DataFrame, parts: int) -> tuple[list[int], dict[int, int]]:
    """Splits of doc_id into ranges of about equal counts, and each range's largest id; both as many as there are ranges."""
    marks = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", marks, 10_000)).first()[0] if marks else []
    splits = sorted(set(found or []))
    heads = docs.groupBy(_bucket(splits).alias("b")).agg(F.max("doc_id").alias("m")).collect()
    return splits, {r.b: r.m for r in heads}


def _bucket(splits: list[int]):
    """How many splits are at most doc_id, looked up in two steps of about the root of their number."""
    if not splits:
        return F.lit(0)
    width = math.isqrt(len(splits)) + 1
    rows = [splits[i : i + width] for i in range(0, len(splits), width)]
    at_most = lambda xs: F.size(F.filter(F.array(*map(F.lit, xs)), lambda s: s <= F.col("doc_id")))
    if len(rows) == 1:
        return at_most(splits)
    coarse = at_most([r[0] for r in rows[1:]])
    fine = F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in rows)), coarse + 1)
    return coarse * width + F.size(F.filter(fine, lambda s: s <= F.col("doc_id")))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def edit(text: str, following: str) -> str:
    """The last half replaced by the first as many code points (or all) of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses; one row per input row.

    The texts are shuffled once, to ranges of doc_id; the first row of a range travels to the range before it too.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    parts = partitions(docs, RANGE_BYTES)
    splits, heads = _buckets(docs.select("doc_id"), parts)
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    order = sorted(heads, reverse=True)
    size = len(splits) + 1
    # The head of a range follows the last row of the range before it (descending); the very first follows the very last.
    guest_of = [-1] * size
    for before, after in zip(order, order[1:] + order[:1]):
        guest_of[after] = before
    bucket = _bucket(splits)
    head = F.element_at(F.array(*(F.lit(heads.get(b)).cast("long") for b in range(size))), F.col("b") + 1)
    target = F.element_at(F.array(*map(F.lit, guest_of)), F.col("b") + 1)
    placed = docs.withColumn("b", bucket)
    places = F.when(F.col("doc_id").eqNullSafe(head), F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.struct(target.alias("b"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")))
    )
    dealt = placed.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.b", "p.guest")
    dealt = dealt.repartitionById(size, F.col("b").cast("int")).sortWithinPartitions(F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None  # (doc_id, text, hashes, fingerprint)
        closed = False
        for batch in batches:
            out: list[tuple] = []
            for doc, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest"))):
                if closed:
                    break
                closed = bool(guest)
                hashes = PrefixHashes(code_points(text))
                now = (doc, text, hashes, hashes.fingerprint())
                if pending is not None:
                    out.append(_row(pending, now))
                pending = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], schema=ARROW)

    return dealt.select("doc_id", "text", "guest").mapInArrow(run, SCHEMA)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])


def _row(this: tuple, following: tuple) -> tuple:
    doc, text, hashes, mark = this
    edited = edit(text, following[1])
    other = PrefixHashes(code_points(edited))
    edited_mark = other.fingerprint()
    return (
        doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark, edited_mark,
        likeness(mark, edited_mark), likeness(mark, following[3]), hashes.common_extension(0, other, 0),
    )


QUESTIONS = "left_id long, left_start long, right_id long, right_start long, length long"


def compare_spans(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers (left_id, left_start, right_id, right_start, length): are the two spans equal, and how far do they agree?

    Adds ``equal`` (false where a span reaches beyond its text) and ``extension``, the code points that agree from the
    two starts on.  A question about an id that is null or not there has null answers; starts count from 0, negative or
    null ones have null answers too.  Ids should be unique; of several texts the smallest is taken.  Prefix arrays are
    built per pair of texts and answer all its questions; a pair with many is split by the join's own skew handling.
    """
    bounded(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(text_or_empty().cast("string")).alias("text"))
    asked = questions.selectExpr(*(f"cast({c.split()[0]} AS long) AS {c.split()[0]}" for c in QUESTIONS.split(", ")))
    left, right = (texts.select(F.col("doc_id").alias(f"{s}_id"), F.col("text").alias(f"{s}_text")) for s in ("left", "right"))
    rows = asked.join(left, "left_id", "left").join(right, "right_id", "left").sortWithinPartitions("left_id", "right_id")
    names = [c.split()[0] for c in QUESTIONS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}

        def hashes(side: str, doc: int, text: str) -> PrefixHashes:
            if kept.get(side, (None,))[0] != doc:
                kept[side] = doc, PrefixHashes(code_points(text))
            return kept[side][1]

        for batch in batches:
            equal, extension = [], []
            for a, i, b, j, n, x, y in zip(*(batch.column(c).to_pylist() for c in (*names, "left_text", "right_text"))):
                if None in (i, j, x, y) or i < 0 or j < 0:
                    equal.append(None)
                    extension.append(None)
                    continue
                one, two = hashes("left", a, x), hashes("right", b, y)
                equal.append(None if n is None or n < 0 else one.equal(i, two, j, n))
                extension.append(one.common_extension(i, two, j) if i <= one.n and j <= two.n else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(equal, pa.bool_()), pa.array(extension, pa.int64())], [*names, "equal", "extension"])

    return rows.select(*names, "left_text", "right_text").mapInArrow(run, f"{QUESTIONS}, equal boolean, extension long")
