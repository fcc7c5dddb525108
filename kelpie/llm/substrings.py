"""Substring deduplication with suffix automata of reference shards.

A word goes if a window of WINDOW consecutive words that covers it also starts in a document with a smaller doc_id.

Candidates: of every window the smallest of its shorter grams (a minimiser) is looked up over the whole corpus; equal
windows have equal minimisers, so a window whose minimiser lies in one document alone is settled.  For the others the
smallest and largest document with the window are found; two windows count as one only if two independent hashes, of 54
bits at least and of 64, agree, so no clash hides a window.  References: the spans of a document whose windows it
is the first to hold, dealt into shards by document; from each shard's spans a suffix automaton over words is built,
whose states know the smallest document of what they stand for.  The maximal candidate spans of all documents, each
distinct one once, are streamed through the automaton of the shard that holds their first document; the matching
statistics decide, word by word, so no hash does.  Automata are bounded by their shard; they are sent to the tasks
that need them instead of to all, since together they grow with the corpus.

Judged on the input: what is removed elsewhere changes nothing.  Nulls and empty texts have no words; rows that repeat
a doc_id do not remove each other's words; a null doc_id comes after all others.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .automaton import SuffixAutomaton
from .common import Words, mix, passes, settle, span_hashes

WINDOW = 13
GRAM = 7
LAST = (1 << 63) - 1
#: What the second hash of a window starts from.
CHECK = np.uint64(0xA0761D6478BD642F)
#: Bytes of text per shard of references, and bytes of candidate spans that one task streams, about.
SHARD_BYTES = 4 << 20
STREAM_BYTES = 4 << 20
#: Most shards that are told apart as busy.
BUSY_SHARDS = 100_000


class Windows:
    """Windows of a block's texts: word hashes, where windows start, and their text's number."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for a, b in passes([len(t) for t in texts]):
            words = Words(texts[a:b], False)
            hashes.append(words.hashes)
            counts.append(np.diff(words.first))
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        each = np.maximum(0, self.counts - window + 1)
        self.text = np.repeat(np.arange(len(texts)), each)
        self.before = np.concatenate(([0], np.cumsum(each)))
        self.start = np.arange(len(self.text)) - np.repeat(self.before[:-1] - self.first[:-1], each)

    def minimisers(self, gram: int) -> np.ndarray:
        """Of each window the smallest hash of its grams."""
        n = len(self.hashes) - gram + 1
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        at = np.arange(n)
        grams = span_hashes(self.hashes, at, at + gram)
        least = grams[: n - self.window + gram].copy()
        for k in range(1, self.window - gram + 1):
            np.minimum(least, grams[k : k + len(least)], out=least)
        return least[self.start]

    def keys(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the chosen windows."""
        return span_hashes(self.hashes, self.start[which], self.start[which] + self.window)

    def checks(self, which: np.ndarray) -> np.ndarray:
        """Other hashes of the chosen windows, of the same words by another function."""
        return span_hashes(mix(self.hashes ^ CHECK), self.start[which], self.start[which] + self.window)


def _ranks(ids: list) -> np.ndarray:
    return np.array([LAST if d is None else d for d in ids], dtype=np.int64)


def _ask_minimisers(own: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(bucket, block, keys, values): minimisers of a block, and whether one or more documents there have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block"), batch.column("payload")):
                ids, texts = X.unpack_rows(payload.as_py())
                w = Windows(texts, window)
                keys, number = np.unique(X.shorten(mix(w.minimisers(gram)), bits), return_inverse=True)
                if not len(keys):
                    continue
                low, high = np.full(len(keys), len(ids)), np.full(len(keys), -1)
                np.minimum.at(low, number, w.text)
                np.maximum.at(high, number, w.text)
                several = (low < high).astype(np.uint8)
                rows = [(name, block.as_py(), packed, X.squeeze(several[at].tobytes())) for name, at, packed in X.split(keys, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "vals"])

    return own.select("block", "payload").mapInArrow(run, "bucket int, block long, keys binary, vals binary")


def _answer_minimisers(asked: DataFrame) -> DataFrame:
    """(bucket, block, answer): a byte per key, 1 if several documents of a block or several blocks have it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, sizes = X.merge(table.column("keys").to_pylist())
        several = X.joined_answers(table.column("vals").to_pylist(), np.uint8)
        total = int(number.max()) + 1
        rows = np.bincount(number, minlength=total)
        many = np.zeros(total, dtype=np.uint8)
        np.maximum.at(many, number, several)
        shared = (many | (rows > 1)).astype(np.uint8)[number]
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "answer": pa.array([X.squeeze(x.tobytes()) for x in np.split(shared, cuts)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, answer binary")


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _flags(w: Windows, parts: list[bytes], gram: int, small: int) -> np.ndarray:
    """Which windows of a block have a minimiser that several documents may have."""
    _, number = np.unique(X.shorten(mix(w.minimisers(gram)), small), return_inverse=True)
    return X.joined_answers(parts, np.uint8)[number].astype(bool) if len(number) else np.zeros(0, dtype=bool)


def _ask_windows(own: DataFrame, answers: DataFrame, window: int, gram: int, small: int, bits: int, kept: int) -> DataFrame:
    """(bucket, block, keys, checks, lows, more): the windows that may be shared, with the smallest document of each and whether there is another."""

    def run(block: int, payload: bytes, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = X.unpack_rows(payload)
        w = Windows(texts, window)
        shared = _flags(w, parts, gram, small)
        keys, checks = X.shorten(w.keys(shared), bits, kept), w.checks(shared)
        number, at = X.number_pairs(keys, checks)
        keys, checks = keys[at], checks[at]
        if not len(keys):
            return
        rank = _ranks(ids)[w.text[shared]]
        low, high = np.full(len(keys), LAST), np.full(len(keys), -LAST - 1)
        np.minimum.at(low, number, rank)
        np.maximum.at(high, number, rank)
        # Of the largest it matters only whether it is another one.
        more = (high > low).astype(np.uint8)
        rows = [(name, block, packed, checks[at].tobytes(), X.planes(low[at].view(np.uint64)), X.squeeze(more[at].tobytes())) for name, at, packed in X.split(keys, bits, kept)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["bucket", "block", "keys", "checks", "lows", "more"])

    return X.with_answers(own, answers, run, "bucket int, block long, keys binary, checks binary, lows binary, more binary")


def _answer_windows(asked: DataFrame, kept: int) -> DataFrame:
    """(bucket, block, answer): per key the smallest document, and whether a larger one has it too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("keys", "checks", "lows", "more")]
        keys = [X.unpack_keys(k, kept) for k in columns[0]]
        number, first = X.number_pairs(np.concatenate(keys), np.frombuffer(b"".join(columns[1]), dtype="<u8"))
        low = np.concatenate([X.from_planes(x) for x in columns[2]]).view(np.int64)
        total = len(first)
        least, most, many = np.full(total, LAST), np.full(total, -LAST - 1), np.zeros(total, dtype=np.uint8)
        np.minimum.at(least, number, low)
        np.maximum.at(most, number, low)
        np.maximum.at(many, number, X.joined_answers(columns[3], np.uint8))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = [X.squeeze(a.tobytes() + b.tobytes()) for a, b in zip(np.split(least[number], cuts), np.split((many | (least < most)).astype(np.uint8)[number], cuts))]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "answer": pa.array(answers, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, answer binary")


def _runs(chosen: np.ndarray, text: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of maximal runs of consecutive chosen windows of one text and one group."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text[at]) != 0) | (np.diff(group[at]) != 0)) + 1
    return list(zip(at[np.append(0, cut)].tolist(), at[np.append(cut, len(at)) - 1].tolist()))


DONE, REFERENCE, ASKED, PLACES = range(4)
SPANS = "kind int, block long, shard long, size long, spans binary, doc_id long, n_words long, kept_sha256 string"
ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("size", pa.int64()), ("spans", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())])


def _spans(own: DataFrame, small_answers: DataFrame, answers: DataFrame, window: int, gram: int, small: int, bits: int, kept: int, shards: int) -> DataFrame:
    """Rows of four kinds: documents that lose nothing, and per block and shard the reference spans, the distinct
    candidate spans, and (per block) the places of candidates as (text, start, shard, windows, where these begin among the shard's)."""

    def run(block: int, payload: bytes, first_parts: list[bytes], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = X.unpack_rows(payload)
        w = Windows(texts, window)
        shared = _flags(w, first_parts, gram, small)
        number, _ = X.number_pairs(X.shorten(w.keys(shared), bits, kept), w.checks(shared))
        raw = [X.expand(p) for p in parts]
        rank = _ranks(ids)[w.text]
        first, own_window = np.full(len(w.text), LAST), np.zeros(len(w.text), dtype=bool)
        if len(number):
            least = np.concatenate([np.frombuffer(r[: len(r) // 9 * 8], dtype="<i8") for r in raw])[number]
            several = np.concatenate([np.frombuffer(r[len(r) // 9 * 8 :], dtype=np.uint8) for r in raw])[number]
            first[shared] = least
            own_window[shared] = (several > 0) & (least == rank[shared])
        shard = (mix(first.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        split: dict[int, list[bytes]] = {}

        def words(a: int, b: int) -> tuple[int, int, bytes]:
            i = int(w.text[a])
            if i not in split:
                split.clear()  # runs come text by text
                split[i] = texts[i].split()
            start = int(w.start[a] - w.first[i])
            return i, start, b" ".join(split[i][start : start + b - a + window])

        rows: list[tuple] = []
        references: dict[int, tuple[list, list]] = {}
        for a, b in _runs(own_window, w.text, shard):
            _, _, span = words(a, b)
            docs, spans = references.setdefault(int(shard[a]), ([], []))
            docs.append(int(rank[a]))
            spans.append(span)
        for s, (docs, spans) in references.items():
            rows.append((REFERENCE, block, s, sum(map(len, spans)), X.pack_rows(docs, spans), None, None, None))
        asked: dict[int, dict[bytes, int]] = {}
        windows: dict[int, int] = {}
        places: list[tuple[int, int, int, int, int]] = []
        for a, b in _runs(first < rank, w.text, shard):
            i, start, span = words(a, b)
            s, n = int(shard[a]), b - a + 1
            known = asked.setdefault(s, {})
            if span not in known:
                known[span] = windows.get(s, 0)
                windows[s] = known[span] + n
            places.append((i, start, s, n, known[span]))
        for s, known in asked.items():
            rows.append((ASKED, block, s, sum(map(len, known)), X.pack_rows([0] * len(known), list(known)), None, None, None))
        if places:
            rows.append((PLACES, block, None, None, X.answer_bytes(np.array(places, dtype=np.int64)), None, None, None))
        waiting = {p[0] for p in places}
        for i, text in enumerate(texts):
            if i not in waiting:
                own_words = text.split()
                rows.append((DONE, block, None, None, None, ids[i], len(own_words), kept_digest(own_words)))
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096]), ARROW)], schema=ARROW)

    rows = own.select("block", "payload").join(X.gathered(small_answers).withColumnRenamed("answers", "small"), "block", "left").join(X.gathered(answers), "block", "left").select("block", "payload", "small", "answers")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, few, more in zip(*(batch.column(c) for c in ("block", "payload", "small", "answers"))):
                yield from run(block.as_py(), payload.as_py(), few.as_py() or [], more.as_py() or [])

    return rows.mapInArrow(over, SPANS)


def _stream(spans: DataFrame, window: int) -> DataFrame:
    """(block, shard, firsts): of each candidate span of a block the smallest reference document of every window.

    A shard that is asked for more than others is served by several tasks, each with its automaton.
    """
    asked = spans.where(F.col("kind") == ASKED)
    total = asked.agg(F.sum("size")).first()[0] or 0
    # Each busy shard has over 1 / BUSY_SHARDS of all that is asked, so there are at most BUSY_SHARDS: a proven bound.
    busy = asked.groupBy("shard").agg(F.sum("size").alias("size")).where(F.col("size") > max(STREAM_BYTES, total / BUSY_SHARDS))
    busy = F.broadcast(busy.select("shard", F.ceil(F.col("size") / STREAM_BYTES).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    queries = asked.join(busy, "shard", "left").select("shard", F.pmod(F.xxhash64("block"), parts).cast("int").alias("part"), "block", F.lit(False).alias("reference"), "spans")
    references = spans.where(F.col("kind") == REFERENCE).join(busy, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "block", F.lit(True).alias("reference"), "spans")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks, reference, packed = (table.column(c).to_pylist() for c in ("block", "reference", "spans"))
        known = (span for r, p in zip(reference, packed) if r for span in zip(*X.unpack_rows(p)))
        automaton = SuffixAutomaton(((doc, text.split()) for doc, text in known), window)
        out: list[tuple[int, bytes]] = []
        # Copies ask for the same span from many blocks: it is streamed once.
        met: dict[bytes, list[int]] = {}
        for block, r, p in zip(blocks, reference, packed):
            if not r:
                found: list[int] = []
                for text in X.unpack_rows(p)[1]:
                    if text not in met:
                        met[text] = automaton.statistics(text.split())
                    found += met[text]
                out.append((block, X.answer_bytes(np.array(found, dtype=np.int64))))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "shard": pa.array([key[0].as_py()] * len(out), pa.int64()), "firsts": pa.array([f for _, f in out], pa.binary())})

    return references.unionByName(queries).groupBy("shard", "part").applyInArrow(run, "block long, shard long, firsts binary")


def _finish(own: DataFrame, places: DataFrame, found: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Removes what the matching statistics confirm from the documents with candidates."""
    per_block = found.groupBy("block").agg(F.collect_list(F.struct("shard", "firsts")).alias("found"))
    rows = own.select("block", "payload").join(places.join(per_block, "block"), "block").select("block", "payload", "spans", "found")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, spots, answers in zip(batch.column("payload"), batch.column("spans"), batch.column("found")):
                yield from finish(payload.as_py(), X.joined_answers([spots.as_py()], "<i8").reshape(-1, 5).tolist(), {a["shard"]: X.joined_answers([a["firsts"]], "<i8") for a in answers.as_py()})

    def finish(payload: bytes, spots: list[list[int]], firsts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, texts = X.unpack_rows(payload)
        of: dict[int, list] = {}
        for spot in spots:
            of.setdefault(spot[0], []).append(spot)
        out: list[tuple] = []
        for i, mine in of.items():
            words = texts[i].split()
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for _, start, shard, n, begin in mine:
                at = start + np.flatnonzero(firsts[shard][begin : begin + n] < (LAST if ids[i] is None else ids[i]))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            covered = np.cumsum(gone)[:-1] > 0
            kept = [x for x, c in zip(words, covered.tolist()) if not c] if covered.any() else words
            extra = (b" ".join(kept).decode("utf-8", "surrogatepass"), hashlib.sha256(texts[i]).hexdigest()) if keep_text else (None, None)
            out.append((ids[i], len(words), len(words) - len(kept), kept_digest(kept), *extra))
        for a in range(0, len(out), 2048):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 2048]), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "source_sha256"])

    return rows.mapInArrow(over, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, source_sha256 string")


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, block_bytes: int = X.BLOCK_BYTES, kept: int = X.BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, source_sha256) of every row.

    ``kept`` in the result, the words left, and the digest of the whole text are null unless asked for, and where no candidate is.
    The argument ``kept`` is the number of bits of a window's first hash that travel, beside those of its bucket.
    """
    own = X.blocks(docs, block_bytes)
    size = own.agg(F.sum("n_bytes")).first()[0] or 0
    small, bits = X.bucket_bits(size / 24), max(8, X.bucket_bits(size / 6))
    shards = max(X.LEAST_BUCKETS, math.ceil(size / SHARD_BYTES))
    flags = settle(_answer_minimisers(_ask_minimisers(own, window, gram, small)))
    answers = _answer_windows(_ask_windows(own, flags, window, gram, small, bits, kept), kept)
    spans = settle(_spans(own, flags, answers, window, gram, small, bits, kept, shards))
    none = F.lit(None).cast("string")
    done = spans.where(F.col("kind") == DONE).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", none.alias("kept"), none.alias("source_sha256"))
    places = spans.where(F.col("kind") == PLACES).select("block", "spans")
    return done.unionByName(_finish(own, places, _stream(spans, window), window, keep_text))


ORACLE = f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
    w AS (
        SELECT r, doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS span
        FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW})),
    s AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY span) AS least FROM w) WHERE coalesce(doc_id > least, least IS NOT NULL)),
    g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM s),
    a AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN a USING (r)"""
