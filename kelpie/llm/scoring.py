"""Language-model scores from a weighted backoff automaton over word n-grams.

States are the n-gram contexts seen in training; a state has an arc for every word seen after it and a failure arc to
the context without its first word.  Arcs carry log10 probabilities of a hierarchical Dirichlet smoothing,

    p_1(w) = (c(w) + 1) / (N + V + 1),   p_k(w | h) = (c(h w) + m * p_{k-1}(w | h')) / (c(h) + m),

and the failure arc of h carries log10(m / (c(h) + m)), so a word that was never seen after h costs exactly its
smoothed probability.  An arc leads to the longest suffix of context and word that is a state.  A text is read in one
traversal from left to right that begins in the state of the text's beginning, carries the state from word to word and
adds up the weights of all arcs taken.

Counts cover every training text.  They stay distributed: each block of documents asks for the counts of its own
n-grams (see ``exchange``) and builds the part of the automaton that its texts can reach.  Orders are asked in turn: an
n-gram can only occur in another block if both n-grams within it, one word shorter, do; the others' counts are the
block's own and are never sent.

Words are maximal runs of other than ASCII white space, with A-Z lowered, and each text ends with an end token.  A null
text is empty: one end token.  Repeated rows count and are scored one by one; a null doc_id is never held out.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import Words, mix, passes, settle

ORDER = 3
#: Weight of the shorter context's probability; chosen on a split within the training rows.
MASS = 8.0
FOLD, HELD_OUT = 7, 2
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Tokens of the texts that one part of the automaton is built for, about.
PART_TOKENS = 1 << 17
#: Texts from which they are read side by side; what fewer have left is read text by text.
ABREAST = 24
#: States that every automaton has: the empty context, and the beginning of a text.
ROOT, START = 0, 1


def held_out(doc: int | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % FOLD == HELD_OUT


class Grams:
    """The n-grams that end at each token of a block, by order.

    ``number[k]`` has, per token, the number of the (k+1)-gram that ends there among the block's distinct ones, or -1
    where it would reach beyond the one mark that stands before a text; ``keys[k]`` has their hashes, ``at[k]`` a place
    where each ends and ``own[k]`` how often each occurs in the block's training texts.
    """

    def __init__(self, payload: bytes, order: int, bits: int):
        self.ids, texts = X.unpack_rows(payload)
        hashes, sizes = [], []
        for a, b in passes([len(t) for t in texts]):
            words = Words(texts[a:b], True)
            counts = np.diff(words.first)
            # Every text's words, then its end.
            hashes.append(np.insert(words.hashes, words.first[1:], END))
            sizes.append(counts + 1)
        self.sizes = np.concatenate(sizes)
        token = mix(np.concatenate(hashes))
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        self.training = ~np.array([held_out(d) for d in self.ids], dtype=bool)
        weight = np.repeat(self.training, self.sizes)
        #: How many words stand before each token in its text.
        self.place = np.arange(len(token)) - np.repeat(self.first[:-1], self.sizes)
        self.keys, self.number, self.at, self.own = [], [], [], []
        gram = token
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate(([BEGIN], gram[:-1]))
                if k == 2:
                    before[self.first[:-1]] = BEGIN
                gram = mix(before * STEP + token + np.uint64(k))
            valid = np.flatnonzero(self.place >= k - 2)
            keys, at, number = X.distinct(X.shorten(gram[valid], bits))
            self.keys.append(keys)
            self.at.append(valid[at])
            self.number.append(np.full(len(token), -1, dtype=np.int32))
            self.number[-1][valid] = number
            self.own.append(np.bincount(number, weights=weight[valid], minlength=len(keys)).astype(np.int64))
        #: Counts in all training texts, and whether other blocks have the n-gram, as far as answers are in.
        self.total: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []

    def asked(self) -> np.ndarray:
        """Of the next order to be answered, which n-grams can occur in other blocks."""
        k = len(self.total)
        if k == 0:
            return np.ones(len(self.keys[0]), dtype=bool)
        at, lower, shared = self.at[k], self.number[k - 1], self.shared[-1]
        # The n-gram without its first word, and without its last; before a text's first word all texts have the same.
        head = lower[np.maximum(at - 1, 0)]
        return shared[lower[at]] & (shared[head] | (self.place[at] == 0))

    def take(self, parts: list[bytes]) -> None:
        """Takes the answers of the next order."""
        k, asked = len(self.total), self.asked()
        total, shared = self.own[k].copy(), np.zeros(len(asked), dtype=bool)
        if parts:
            values = np.concatenate([X.from_planes(p) for p in parts])
            total[asked], shared[asked] = (values >> np.uint64(1)).astype(np.int64), values & np.uint64(1) == 1
        self.total.append(total)
        self.shared.append(shared)


def ask(own: DataFrame, answers: list[DataFrame], bits: int) -> DataFrame:
    """(bucket, block, keys, counts): each block's distinct n-grams of the next order that others may have, with their counts in its training texts."""
    known = len(answers)

    def run(block: int, payload: bytes, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        g = Grams(payload, known + 1, bits)
        for one in _by_order(parts, known):
            g.take(one)
        asked = g.asked()
        counts = g.own[-1][asked].astype(np.uint64)
        rows = [(name, block, packed, X.planes(counts[at])) for name, at, packed in X.split(g.keys[-1][asked], bits)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "keys", "counts"])

    return X.with_answers(own, _in_order(answers), run, "bucket int, block long, keys binary, counts binary")


def count(asked: DataFrame) -> DataFrame:
    """(bucket, block, answer, tokens, types): the count over all blocks and whether several have it; totals once per bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, sizes = X.merge(table.column("keys").to_pylist())
        values = np.concatenate([X.from_planes(v) for v in table.column("counts").to_pylist()])
        total = np.bincount(number, weights=values).astype(np.uint64)
        shared = (np.bincount(number) > 1).astype(np.uint64)
        answers = [X.planes(x) for x in np.split((total << np.uint64(1) | shared)[number], np.cumsum(sizes)[:-1])]
        rest = [0] * (len(sizes) - 1)
        return pa.table(
            {
                "bucket": table.column("bucket"), "block": table.column("block"), "answer": pa.array(answers, pa.binary()),
                "tokens": pa.array([int(total.sum()), *rest], pa.int64()), "types": pa.array([int((total > 0).sum()), *rest], pa.int64()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, answer binary, tokens long, types long")


def _in_order(answers: list[DataFrame]) -> DataFrame | None:
    """All answers; ``bucket`` then names order and bucket, and the order stands before the answer's bytes."""
    out = None
    for k, one in enumerate(answers):
        one = one.select(F.struct(F.lit(k).alias("order"), "bucket").alias("bucket"), "block", F.concat(F.lit(bytes([k])), "answer").alias("answer"))
        out = one if out is None else out.unionByName(one)
    return out


def _by_order(parts: list[bytes], orders: int) -> list[list[bytes]]:
    return [[p[1:] for p in parts if p[0] == k] for k in range(orders)]


class Automaton:
    """States, arcs and failure arcs that some texts of a block can reach.

    States are numbered from the empty context on, arcs by order.  ``table[k]`` has the arc of each (k+1)-gram of the
    block, or -1 where training has none: the arc of its last word, from the state of its first k words.
    """

    def __init__(self, g: Grams, low: int, high: int, tokens: int, types: int, texts: int, mass: float):
        """For the tokens from ``low`` to ``high`` of a block whose counts are all in."""
        order = len(g.total)
        failure, shorter = [np.array([0.0, math.log10(mass / (texts + mass))])], [np.array([ROOT, ROOT])]
        # Arc 0 is that of words never seen: from the empty context to itself.
        weights, targets = [np.array([math.log10(1.0 / (tokens + types + 1.0))])], [np.array([ROOT])]
        self.table: list[np.ndarray] = []
        probability: list[np.ndarray] = []
        #: Of each order the state of every n-gram that is one; the highest order has none.
        state: list[np.ndarray] = []
        states, arcs = 2, 1
        for k in range(order):
            met = np.zeros(len(g.keys[k]) + 1, dtype=bool)
            met[g.number[k][low:high]] = True
            reached = np.flatnonzero(met[:-1] & (g.total[k] > 0))
            at, seen = g.at[k][reached], g.total[k][reached].astype(np.float64)
            suffix = g.number[k - 1][at] if k else None
            p = np.zeros(len(g.keys[k]))
            if k == 0:
                p[reached] = (seen + 1.0) / (tokens + types + 1.0)
                back = np.zeros(len(at), dtype=np.int64)
            else:
                head = g.number[k - 1][np.maximum(at - 1, 0)]
                context = np.where(g.place[at] == 0, float(texts), g.total[k - 1][head])
                back = state[k - 1][suffix]
                p[reached] = (seen + mass * probability[k - 1][suffix]) / (context + mass)
            probability.append(p)
            own, table = np.zeros(len(p), dtype=np.int64), np.full(len(p) + 1, 0 if k == 0 else -1, dtype=np.int32)
            if k < order - 1:
                own[reached] = np.arange(states, states + len(reached))
                states += len(reached)
                failure.append(np.log10(mass / (seen + mass)))
                shorter.append(back)
            state.append(own)
            table[reached] = np.arange(arcs, arcs + len(reached))
            arcs += len(reached)
            self.table.append(table)
            weights.append(np.log10(p[reached]))
            # The longest suffix of context and word that is a state: the n-gram itself, but for the highest order.
            targets.append(own[reached] if k < order - 1 else back)
        self.weights, self.targets = np.concatenate(weights), np.concatenate(targets)
        self.failure, self.shorter = np.concatenate(failure), np.concatenate(shorter)

    def read(self, grams: np.ndarray, sizes: np.ndarray) -> list[float]:
        """log10 probabilities of consecutive texts: ``grams[k]`` has the arc of the (k+1)-gram that ends at each token.

        A text begins in the state of the beginning.  A state of some ``depth`` of words has an arc for the next one if
        the n-gram of one word more has; if not, the failure arc leads to the state of one word less.  Texts are read
        side by side, a token of each at a time, and each carries its own state.
        """
        weights, targets, failure, shorter, (orders, tokens) = self.weights, self.targets, self.failure, self.shorter, grams.shape
        order, top, arcs = np.argsort(-sizes, kind="stable"), orders - 1, grams.ravel()
        length, at = sizes[order], (np.cumsum(sizes) - sizes)[order]
        total, state = np.zeros(len(sizes)), np.full(len(sizes), START if top else ROOT)
        # The place of a text's next token in the row of its depth.
        place = at + min(1, top) * tokens
        steps = int(length[ABREAST - 1]) if len(sizes) >= ABREAST else 0
        for n in np.searchsorted(-length, -np.arange(steps)).tolist():
            here = place[:n]
            arc = arcs[here]
            fails = np.flatnonzero(arc < 0)
            while len(fails):
                of = state[fails]
                total[fails] += failure[of]
                state[fails] = shorter[of]
                here[fails] -= tokens
                arc[fails] = found = arcs[here[fails]]
                fails = fails[found < 0]
            total[:n] += weights[arc]
            state[:n] = targets[arc]
            here += np.where(here < top * tokens, tokens + 1, 1)
        for i in np.flatnonzero(length > steps).tolist():
            total[i] = self._go_on(grams[:, at[i] + steps : at[i] + length[i]].tolist(), float(total[i]), int(state[i]), int(place[i]) // tokens)
        out = np.empty(len(sizes))
        out[order] = total
        return out.tolist()

    def _go_on(self, grams: list[list[int]], total: float, state: int, depth: int) -> float:
        """``read`` of the rest of one text from a state of ``depth`` words."""
        weights, targets, failure, shorter, top = *map(memoryview, (self.weights, self.targets, self.failure, self.shorter)), len(grams) - 1
        for arcs in zip(*grams):
            while (arc := arcs[depth]) < 0:
                total += failure[state]
                state = shorter[state]
                depth -= 1
            total += weights[arc]
            state = targets[arc]
            if depth < top:
                depth += 1
        return total


def scores(g: Grams, tokens: int, types: int, texts: int, mass: float, part_tokens: int = PART_TOKENS) -> list[float]:
    """The automaton's log10 probability of each text of a block."""
    out: list[float] = []
    for a, b in passes(g.sizes.tolist(), part_tokens):
        low, high = int(g.first[a]), int(g.first[b])
        automaton = Automaton(g, low, high, tokens, types, texts, mass)
        out += automaton.read(np.stack([t[n[low:high]] for t, n in zip(automaton.table, g.number)]), g.sizes[a:b])
    return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, order: int = ORDER, mass: float = MASS, block_bytes: int = X.BLOCK_BYTES, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Base and model scores of every document, learnt from those that are not held out."""
    own = X.blocks(docs, block_bytes)
    size = own.agg(F.sum("n_bytes")).first()[0] or 0
    bits = X.bucket_bits(size / 6)
    answers: list[DataFrame] = []
    for _ in range(order):
        # What was asked is several times the answers, and is not read again.
        answers.append(settle(count(ask(own, answers, bits)), lean=True))
    totals = answers[0].agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = totals[0] or 0, totals[1] or 0
    texts = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLD != HELD_OUT, F.lit(True))).count()

    def run(block: int, payload: bytes, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        g = Grams(payload, order, bits)
        for one in _by_order(parts, order):
            g.take(one)
        counts = g.total[0][g.number[0]]
        # Taken once per word of the block, not per token.
        base = np.log10((g.total[0] + 1.0) / (tokens + types + 1.0))[g.number[0]]
        n = len(g.ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(g.ids, pa.int64()), pa.array(~g.training), pa.array(g.sizes, pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), g.first[:-1]), pa.int64()),
                pa.array(np.full(n, tokens), pa.int64()), pa.array(np.add.reduceat(base, g.first[:-1])), pa.array(scores(g, tokens, types, texts, mass, part_tokens)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return X.with_answers(own, _in_order(answers), run, SCHEMA)


def rounded(scored: DataFrame) -> DataFrame:
    """Scores to six decimals: what sums of differing order agree on."""
    return scored.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})


#: The same model in SQL.  The check sum of doc_id is spelt out bit by bit; a space stands for the end of a text and a
#: line end for what stands before it, which are no words.
ORACLE = f"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, list_concat(list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), [' ']) AS words,
            coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % {FOLD} = {HELD_OUT}, false) AS held_out
        FROM documents),
    t AS (SELECT r, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
    g AS (SELECT r, held_out, i, w, coalesce(lag(w) OVER p, chr(10)) AS a, CASE WHEN i = 2 THEN chr(10) ELSE lag(w, 2) OVER p END AS b
        FROM t WINDOW p AS (PARTITION BY r ORDER BY i)),
    k AS (SELECT * FROM g WHERE NOT held_out),
    c1 AS (SELECT w, count(*) AS n FROM k GROUP BY w), c2 AS (SELECT a, w, count(*) AS n FROM k GROUP BY a, w),
    c3 AS (SELECT b, a, w, count(*) AS n FROM k WHERE b IS NOT NULL GROUP BY b, a, w),
    x1 AS (SELECT a, count(*) AS n FROM k GROUP BY a), x2 AS (SELECT b, a, count(*) AS n FROM k WHERE b IS NOT NULL GROUP BY b, a),
    s AS (SELECT coalesce(sum(n), 0) AS tokens, count(*) AS types FROM c1),
    p AS (SELECT r, coalesce(c1.n, 0) AS n1, coalesce(c2.n, 0) AS n2, coalesce(c3.n, 0) AS n3, coalesce(x1.n, 0) AS h2, coalesce(x2.n, 0) AS h3, g.b IS NOT NULL AS long
        FROM g LEFT JOIN c1 USING (w) LEFT JOIN c2 ON c2.a = g.a AND c2.w = g.w LEFT JOIN c3 ON c3.b = g.b AND c3.a = g.a AND c3.w = g.w
        LEFT JOIN x1 ON x1.a = g.a LEFT JOIN x2 ON x2.b = g.b AND x2.a = g.a),
    q AS (SELECT r, n1, n3, h3, long, (n1 + 1.0::DOUBLE) / (tokens + types + 1.0::DOUBLE) AS p1, (n2 + {MASS}::DOUBLE * p1) / (h2 + {MASS}::DOUBLE) AS p2,
        CASE WHEN long THEN (n3 + {MASS}::DOUBLE * p2) / (h3 + {MASS}::DOUBLE) ELSE p2 END AS p3 FROM p, s),
    a AS (SELECT r, count(*) FILTER (WHERE n1 > 0) AS n_known, round(fsum(log10(p1)), 6) AS base_score, round(fsum(log10(p3)), 6) AS score FROM q GROUP BY r)
    SELECT doc_id, held_out, CAST(len(words) AS BIGINT) AS n_tokens, n_known, CAST(tokens AS BIGINT) AS train_tokens, base_score, score FROM d JOIN a USING (r), s"""
