"""SentencePiece encoding and decoding with seeded merge-dropout.

A byte-pair model is encoded by an agenda: of all neighbouring pieces that form a piece, the one of the best score
(leftmost at ties) is merged, until none is left.  Under dropout each candidate merge is skipped, once and for all,
when a hash of its place in the word keyed with the seed falls below the rate, so texts come out in varied
segmentations of the same merge type, which decode to the very same text.  A rate of 0 is the model's own encoding.

Words (with the space before them) do not merge with each other in these models, so the agenda runs over many words at
once.  The key of a merge is (seed, doc_id, place of the word in the text, span in the word), so every occurrence of a
word is drawn anew.  The model's own pieces of a word are kept with the merges that it considers: an occurrence in which
none of those is skipped has the very same pieces.  Of the others, one of each set of skipped merges has an agenda of its
own, and those for which every merge that it considered is drawn as for it have its pieces.  All that are left have an
agenda each, and so has a word that a batch holds few times.

Spaces become the model's space mark, one more before the text; characters that are no piece become their bytes.  A
space mark of the text itself is spelt as bytes, so it is not taken for a space: decoding gives back every text.
Nulls and empty texts have no pieces.  Repeated rows are encoded one by one.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, column_bytes, mix, passes

SPACE = "▁"
RATE, SEED = 0.1, 17
#: The spaces before a word and the word; or spaces that end a text.
WORD = re.compile(r" *[^ ]+| +")
#: Longest word, in symbols, that is merged side by side with others; a longer one has an agenda of its own.
SIDE_BY_SIDE = 48
#: Bytes of kept words in each of two generations, and occurrences drawn at a time.
KEPT_BYTES = 32 << 20
DRAWN = 1 << 15
#: Occurrences in a batch from which a word is kept, and words that are merged side by side.
OFTEN, ABREAST = 5, 1 << 13
#: Pieces that are joined or decoded at a time, about.
AT_ONCE = 1 << 18
#: The place in the order of merges of what is no merge.
NONE = np.int64((1 << 31) - 1)
_models: dict[str, Model] = {}


class Model:
    """The pieces of a byte-pair model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback is needed")
        pieces = proto.pieces
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.value: list[bytes] = []
        for i, p in enumerate(pieces):
            self.value.append(b"")
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.value[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                self.ids[p.piece] = i
                self.value[i] = p.piece.replace(SPACE, " ").encode()
        ids = self.ids
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in ids):
            raise ValueError("a model in which no piece spans two words is needed")
        # Pairs of pieces that form a piece, as sorted keys, and the piece they form.
        pairs = sorted((ids[x[:k]] << 32 | ids[x[k:]], i) for x, i in ids.items() for k in range(1, len(x)) if x[:k] in ids and x[k:] in ids)
        self.pair = np.array([k for k, _ in pairs], dtype=np.int64)
        self.merged = np.array([i for _, i in pairs], dtype=np.int64)
        self._hash()
        # Places by falling score; equal scores share a place, so that ties go to the left.
        self.rank = np.unique(np.array([-p.score for p in pieces]), return_inverse=True)[1].astype(np.int64)
        self.of_pair = dict(pairs)
        # A space stands for the model's space mark; a space mark of the text has no piece.
        self.characters = {c: i for c, i in ids.items() if len(c) == 1 and c != SPACE} | {" ": ids[SPACE]}
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        self.of_point[[ord(c) for c in self.characters]] = list(self.characters.values())
        self.of_byte = np.array(self.bytes, dtype=np.int32)
        self.values = pa.array(self.value, pa.large_binary())

    def _hash(self) -> None:
        """A table of the pairs by hash, four places a pair; a pair lies at most ``probes`` places after its own."""
        self.shift = np.uint64(64 - max(1, (4 * len(self.pair)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.table_key, self.table_merged = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        left, self.probes = np.arange(len(self.pair)), 0
        while len(left):
            at = (self._slot(self.pair[left]) + self.probes) % size
            free = self.table_key[at] < 0
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(left), dtype=bool)
            mine[first] = True
            mine &= free
            self.table_key[at[mine]], self.table_merged[at[mine]] = self.pair[left[mine]], self.merged[left[mine]]
            left, self.probes = left[~mine], self.probes + 1

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, pair: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, or -1."""
        slot = self._slot(pair)
        found = np.where(self.table_key[slot] == pair, self.table_merged[slot], -1)
        # A pair whose own place holds another one, or that is none, may lie further on.
        left = np.flatnonzero((found < 0) & (self.table_key[slot] >= 0))
        for k in range(1, self.probes):
            if not len(left):
                break
            at = (slot[left] + k) % len(self.table_key)
            held = self.table_key[at]
            hit = held == pair[left]
            found[left[hit]] = self.table_merged[at[hit]]
            left = left[~hit]
        return found

    def symbols(self, word: str) -> list[int]:
        """A word's characters as pieces, or their bytes."""
        out: list[int] = []
        for c in word:
            i = self.characters.get(c)
            if i is None:
                out.extend(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def all_symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of many words (UTF-8), joined, and how many each has."""
        joined = b"".join(words)
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        raw = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        leads = np.flatnonzero((raw & 0xC0) != 0x80)
        # Characters before each word's end.
        upto = np.searchsorted(leads, ends)
        out = self.of_point[points]
        bare = np.flatnonzero(out < 0)
        if len(bare):
            width = np.ones(len(out), dtype=np.int64)
            width[bare] = np.diff(np.append(leads, len(raw)))[bare]
            before = np.concatenate(([0], np.cumsum(width)))
            out = np.repeat(out, width)
            out[_rows(before[bare], width[bare])] = self.of_byte[raw[_rows(leads[bare], width[bare])]]
            upto = before[upto]
        return out, np.diff(upto, prepend=0)


def load(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def word_key(word: str, seed: int, variant: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed << 16 | variant)


def _skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, stop: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge of [start, middle) and [middle, stop) of the word with that key is dropped."""
    return _drawn(mix(_place(start, middle, stop)), key, rate)


def _place(start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (start << np.uint64(42)) ^ (middle << np.uint64(21)) ^ stop


def _drawn(place: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    return (mix(place ^ key) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _rows(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, ... of each of several stretches, joined."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def agenda(symbols: list[int], key: int, model: Model, rate: float, seen: list | None = None) -> list[int]:
    """The pieces of one word of any length, by a heap of candidate merges."""
    n = len(symbols)
    sym, left, right, stop = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def consider(a: int) -> None:
        b = right[a]
        if a < 0 or b >= n:
            return
        merged = model.of_pair.get(sym[a] << 32 | sym[b])
        if merged is not None and seen is not None:
            seen.append((a, b, stop[b]))
        if merged is not None and not (rate and _skipped(*np.array([[key], [a], [b], [stop[b]]], dtype=np.uint64), rate)[0]):
            heapq.heappush(heap, (int(model.rank[merged]), a, b, merged))

    for a in range(n - 1):
        consider(a)
    gone = [False] * n
    while heap:
        _, a, b, merged = heapq.heappop(heap)
        # A candidate is stale once either side has been merged: it then forms something else.
        if gone[a] or gone[b] or right[a] != b or model.of_pair.get(sym[a] << 32 | sym[b]) != merged:
            continue
        sym[a], gone[b], stop[a], right[a] = merged, True, stop[b], right[b]
        if right[b] < n:
            left[right[b]] = a
        consider(left[a]) if left[a] >= 0 else None
        consider(a)
    return [s for s, g in zip(sym, gone) if not g]


def side_by_side(words: list[list[int]], keys: list[int], model: Model, rate: float) -> list[bytes]:
    """The pieces (unsigned 32-bit, little-endian) of many short words; every round merges the best pair of each."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    found = merge_all(np.array([s for w in words for s in w], dtype=np.int32), sizes, np.array(keys, dtype=np.uint64), model, rate)
    return cut(*found)


def cut(pieces: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Stretches of ids as unsigned 32-bit little-endian values."""
    raw = pieces.astype("<u4", copy=False).tobytes()
    return [raw[a:b] for a, b in zip((first * 4).tolist(), ((first + size) * 4).tolist())]


def merge_all(sym: np.ndarray, sizes: np.ndarray, key: np.ndarray, model: Model, rate: float, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``side_by_side`` over joined symbols: pieces, and where those of each word begin and how many they are.

    ``seen`` takes the (words, places) of the merges that were considered.
    """
    sym = sym.astype(np.int32)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)))
    start = (np.arange(len(sym)) - first[:-1][word]).astype(np.uint32)
    stop = start + np.uint32(1)
    done: list[np.ndarray] = []
    out_first, out_size, n_done = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 0
    rank = np.full(len(sym), NONE)
    form = np.zeros(len(sym), dtype=np.int32)

    def spans(at: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x.astype(np.uint64) for x in (start[at], start[at + 1], stop[at + 1]))

    def consider(at: np.ndarray) -> None:
        """Candidates that begin at the given places."""
        rank[at] = NONE
        at = at[at + 1 < len(sym)]
        at = at[word[at] == word[at + 1]]
        merged = model.find(sym[at].astype(np.int64) << 32 | sym[at + 1])
        hit = merged >= 0
        at, merged = at[hit], merged[hit]
        if seen is not None:
            seen.append((word[at], mix(_place(*spans(at)))))
        if rate and len(at):
            stay = ~_skipped(key[word[at]], *spans(at), rate)
            at, merged = at[stay], merged[stay]
        form[at] = merged
        rank[at] = model.rank[merged]

    consider(np.arange(len(sym)))
    while len(sym):
        begins = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1))
        best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), begins)
        ended = best >> 32 == NONE
        at = best[~ended] & 0xFFFFFFFF
        keep = np.ones(len(sym), dtype=bool)
        if ended.any():
            size = np.diff(np.append(begins, len(sym)))
            over, n = np.repeat(ended, size), size[ended]
            whole = word[begins[ended]]
            out_first[whole], out_size[whole] = n_done + np.cumsum(n) - n, n
            done.append(sym[over])
            n_done += len(done[-1])
            keep = ~over
        sym[at], stop[at] = form[at], stop[at + 1]
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        sym, word, start, stop, rank, form = (x[keep] for x in (sym, word, start, stop, rank, form))
        if not len(sym):
            break
        at = moved[at]
        touched = np.zeros(len(sym) + 1, dtype=bool)
        touched[at] = touched[at - 1] = True  # the place before the first is the spare one at the end
        consider(np.flatnonzero(touched[:-1]))
    return np.concatenate(done) if done else sym, out_first, out_size


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts (UTF-8), those of all texts in turn by number, and how many each text has.

    Words are those of ``WORD`` in a space and the text: each begins with the text or where spaces begin.
    """
    joined = b"".join([b" " + t for t in texts if t])
    ends = np.cumsum(np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64))
    space = np.frombuffer(joined, dtype=np.uint8) == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[ends[ends < len(joined)]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(joined)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, ends), prepend=0)


_encoders: dict[tuple, Encoder] = {}


def encoder_for(path: str, rate: float, seed: int) -> Encoder:
    """One encoder per process, so that tasks find the words that earlier ones have met."""
    key = (path, rate, seed)
    if key not in _encoders:
        _encoders[key] = Encoder(path, rate, seed)
    return _encoders[key]


class Kept:
    """A dictionary bounded by bytes: when the young generation is full it becomes the old one, and what is met again is young again."""

    def __init__(self, most: int = KEPT_BYTES):
        self.most, self.size = most, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.pop(key, None)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += 250 + sum(map(len, value))


class Stretches:
    """Stretches of values, joined: those of each item, and how many each has."""

    def __init__(self, parts: list[bytes], kind: type):
        self.values = np.frombuffer(b"".join(parts), dtype=kind)
        self.size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // np.dtype(kind).itemsize
        self.first = np.cumsum(self.size) - self.size

    def of(self, items: np.ndarray) -> np.ndarray:
        return self.values[_rows(self.first[items], self.size[items])]


class Pieces:
    """Pieces of each occurrence of a word: those of its word at first, until others are put in their place."""

    def __init__(self, own: Stretches, at: np.ndarray):
        self.parts, self.n = [own.values], len(own.values)
        self.first, self.size = own.first[at], own.size[at]

    def put(self, where: np.ndarray, pieces: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.first[where], self.size[where] = first + self.n, size
        self.parts.append(pieces)
        self.n += len(pieces)

    def joined(self) -> np.ndarray:
        """The pieces of all occurrences in turn."""
        found = np.concatenate(self.parts)
        steps = range(0, len(self.first), AT_ONCE)
        return np.concatenate([found[:0], *(found[_rows(self.first[a : a + AT_ONCE], self.size[a : a + AT_ONCE])] for a in steps)])


class Encoder:
    """Encodes texts with one model, rate and seed.

    A kept word has its own pieces, its symbols and the places of the merges considered for them.
    """

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED, kept_bytes: int = KEPT_BYTES):
        self.model, self.rate, self.seed = load(path), rate, seed
        self.words = Kept(kept_bytes)

    def encode_batch(self, texts: list[str], docs: list[int | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit little-endian values; the draws are those of the given documents."""
        pieces, sizes = self.encode_joined([t.encode("utf-8", "surrogatepass") for t in texts], docs)
        return cut(pieces, np.cumsum(sizes) - sizes, sizes)

    def encode_joined(self, texts: list[bytes], docs: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8) in turn, and how many each text has."""
        words, at, sizes = split_words(texts)
        often = np.bincount(at, minlength=len(words)) >= OFTEN
        kept = [self.words.get(w) for w in words]
        fresh = [i for i, k in enumerate(kept) if k is None and (often[i] or not self.rate)]
        for a in range(0, len(fresh), ABREAST):
            some = fresh[a : a + ABREAST]
            for i, found in zip(some, self._learn([words[i] for i in some])):
                kept[i] = found
                self.words.put(words[i], found)
        own = Stretches([k[0] if k else b"" for k in kept], np.int32)
        pieces = Pieces(own, at)
        if self.rate and len(at):
            of_doc = np.array([word_key(str(d), self.seed, 0) for d in docs], dtype=np.uint64)
            place = _rows(np.zeros(len(texts), dtype=np.int64), sizes)
            key = mix(np.repeat(of_doc, sizes) ^ mix(place.astype(np.uint64) + np.uint64(1)))
            alone = np.array([k is None for k in kept])[at]
            self._draw(np.flatnonzero(~alone), at, key, kept, pieces)
            self._encode(np.flatnonzero(alone), at, words, key, pieces)
        ends = np.cumsum(sizes)
        joined, n = pieces.joined(), np.concatenate(([0], np.cumsum(pieces.size)))
        return joined, n[ends] - n[ends - sizes]

    def _encode(self, where: np.ndarray, at: np.ndarray, words: list[bytes], key: np.ndarray, pieces: Pieces) -> None:
        """Gives the words that occur at ``where`` an agenda each."""
        for a in range(0, len(where), ABREAST):
            some = where[a : a + ABREAST]
            self._agendas(some, *self.model.all_symbols([words[i] for i in at[some].tolist()]), key, pieces)

    def _agendas(self, where: np.ndarray, symbols: np.ndarray, size: np.ndarray, key: np.ndarray, pieces: Pieces, seen: list | None = None) -> None:
        """Pieces of the occurrences at ``where``, whose symbols are joined, under the draws of their keys."""
        first, short = np.cumsum(size) - size, size <= SIDE_BY_SIDE
        if not short.all():
            for k in np.flatnonzero(~short).tolist():
                ids = np.array(agenda(symbols[first[k] : first[k] + size[k]].tolist(), int(key[where[k]]), self.model, self.rate), dtype=np.int32)
                pieces.put(where[k : k + 1], ids, np.zeros(1, dtype=np.int64), np.array([len(ids)]))
            symbols, size, where = symbols[_rows(first[short], size[short])], size[short], where[short]
        pieces.put(where, *merge_all(symbols, size, key[where], self.model, self.rate, seen))

    def _draw(self, where: np.ndarray, at: np.ndarray, key: np.ndarray, kept: list, pieces: Pieces) -> None:
        """Puts other pieces in the place of the own ones of kept words wherever a merge is skipped."""
        places = Stretches([k[2] if k else b"" for k in kept], np.uint64)
        symbols = Stretches([k[1] if k else b"" for k in kept], np.int32)
        hits, marks = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for a in range(0, len(where), DRAWN):
            some = where[a : a + DRAWN]
            n = places.size[at[some]]
            skipped = np.flatnonzero(_drawn(places.of(at[some]), np.repeat(key[some], n), self.rate))
            if len(skipped):
                ends = np.cumsum(n)
                who = np.searchsorted(ends, skipped, "right")
                begins = np.concatenate(([0], np.flatnonzero(who[1:] != who[:-1]) + 1))
                hits.append(some[who[begins]])
                # Tells sets of skipped merges apart; sets that it does not tell apart only share a group.
                marks.append(np.add.reduceat(mix((skipped - (ends - n)[who]).astype(np.uint64) + np.uint64(1)), begins))
        hit = np.concatenate(hits)
        group = mix(np.concatenate(marks) ^ mix(at[hit].astype(np.uint64)))
        order = np.argsort(group)
        hit, group = hit[order], group[order]
        fresh = np.ones(len(hit), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (at[hit[1:]] != at[hit[:-1]]) | (symbols.size[at[hit[1:]]] > SIDE_BY_SIDE)
        begins = np.flatnonzero(fresh)
        size = np.diff(np.append(begins, len(hit)))
        lone, several = hit[begins[size == 1]], np.flatnonzero(size > 1)
        rest = [lone]
        for a in range(0, len(several), ABREAST):
            some = several[a : a + ABREAST]
            rest.append(self._follow(hit, begins[some], size[some], at, key, symbols, pieces))
        left = np.concatenate(rest)
        for a in range(0, len(left), ABREAST):
            some = left[a : a + ABREAST]
            self._agendas(some, symbols.of(at[some]), symbols.size[at[some]], key, pieces)

    def _follow(self, hit: np.ndarray, begins: np.ndarray, size: np.ndarray, at: np.ndarray, key: np.ndarray, symbols: Stretches, pieces: Pieces) -> np.ndarray:
        """Gives the first of each group of occurrences of a word an agenda, and its pieces to those that draw alike; returns the rest."""
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        heads = hit[begins]
        self._agendas(heads, symbols.of(at[heads]), symbols.size[at[heads]], key, pieces, seen)
        word, place = (np.concatenate(x) for x in zip(*seen))
        order = np.argsort(word, kind="stable")
        place = place[order]
        n = np.bincount(word, minlength=len(heads))
        first = np.cumsum(n) - n
        drawn = _drawn(place, np.repeat(key[heads], n), self.rate)
        rest = []
        for a, b in passes((size - 1).tolist(), DRAWN):
            head = np.repeat(np.arange(a, b), size[a:b] - 1)
            others = hit[_rows(begins[a:b] + 1, size[a:b] - 1)]
            for c in range(0, len(others), DRAWN):
                who, of = others[c : c + DRAWN], head[c : c + DRAWN]
                rows = _rows(first[of], n[of])
                differs = _drawn(place[rows], np.repeat(key[who], n[of]), self.rate) != drawn[rows]
                same = np.ones(len(who), dtype=bool)
                same[np.repeat(np.arange(len(who)), n[of])[differs]] = False
                pieces.first[who[same]], pieces.size[who[same]] = pieces.first[heads[of[same]]], pieces.size[heads[of[same]]]
                rest.append(who[~same])
        return np.concatenate(rest)

    def _learn(self, words: list[bytes]) -> list[tuple[bytes, bytes, bytes]]:
        """(own pieces, symbols, places of the merges considered) of each word."""
        symbols, sizes = self.model.all_symbols(words)
        first = np.cumsum(sizes) - sizes
        raw = cut(symbols, first, sizes)
        short, long = np.flatnonzero(sizes <= SIDE_BY_SIDE), np.flatnonzero(sizes > SIDE_BY_SIDE)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        joined = symbols[_rows(first[short], sizes[short])]
        found = cut(*merge_all(joined, sizes[short], np.zeros(len(short), dtype=np.uint64), self.model, 0.0, seen))
        word, place = (np.concatenate(x) for x in zip(*seen))
        order = np.argsort(word, kind="stable")
        cuts = (np.searchsorted(word[order], np.arange(len(short) + 1)) * 8).tolist()
        places = place[order].tobytes()
        out: list = [None] * len(words)
        for k, i in enumerate(short.tolist()):
            out[i] = found[k], raw[i], places[cuts[k] : cuts[k + 1]]
        for i in long.tolist():
            considered: list[tuple[int, int, int]] = []
            ids = np.array(agenda(symbols[first[i] : first[i] + sizes[i]].tolist(), 0, self.model, 0.0, considered), dtype="<u4").tobytes()
            spans = np.array(considered, dtype=np.uint64).reshape(-1, 3).T
            out[i] = ids, raw[i], mix(_place(*spans)).tobytes()
        return out

    def decode_joined(self, pieces: np.ndarray, sizes: np.ndarray) -> Iterator[bytes]:
        """The texts (UTF-8) that stretches of ids stand for, one after the other."""
        ends = np.cumsum(sizes)
        for a, b in passes(sizes.tolist(), AT_ONCE):
            low = ends[a] - sizes[a]
            taken = self.model.values.take(pa.array(pieces[low : ends[b - 1]]))
            _, offsets, data = taken.buffers()
            at = np.frombuffer(offsets, dtype=np.int64, count=len(taken) + 1)
            data = memoryview(data) if data is not None else memoryview(b"")
            for c, d in zip(at[ends[a:b] - sizes[a:b] - low].tolist(), at[ends[a:b] - low].tolist()):
                yield bytes(data[c + 1 : d])  # without the space before the text

    def decode(self, ids: bytes) -> bytes:
        """The text (UTF-8) that ids stand for."""
        return b"".join(map(self.model.value.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))[1:]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, ids) of every row."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, rate, seed)
        for batch in batches:
            pieces, sizes = encoder.encode_joined(column_bytes(batch.column("text")), batch.column("doc_id").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(pieces, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = [encoder.decode(np.array(x or [], dtype="<u4").tobytes()).decode("utf-8", "surrogatepass") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256) of every row: what was encoded, and what it decodes to."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, rate, seed)
        for batch in batches:
            pieces, sizes = encoder.encode_joined(column_bytes(batch.column("text")), batch.column("doc_id").to_pylist())
            raw, ends = memoryview(pieces.astype("<u4", copy=False)).cast("B"), np.cumsum(sizes)
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(((ends - sizes) * 4).tolist(), (ends * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in encoder.decode_joined(pieces, sizes)], pa.string()),
                ],
                ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
