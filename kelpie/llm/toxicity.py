"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses.  Four small transducers read a clause word class by word class: one for abuse (an insult,
or a threat verb), one for its target (second person, or a group), one for negation and one for reported speech.  They
are composed into one automaton whose end state says which abuse was matched, whether it was aimed, denied or quoted;
only matched clauses count.  A text's score is a logistic function of the clause weights by kind of match.

Words that mark abuse come from a short seed list and from labels: every word beginning, and every whole word of
whatever length, is learnt whose texts are toxic more often than chance allows, also if its texts hold other abuse;
copies of one text count once.  Both the choice and the logistic weights are fitted on a bounded, documented sample of
labelled training rows.

Nulls and empty texts match nothing and get the score of the bias.  Labels that are null are left out; a doc_id that
is labelled twice counts as toxic if one label says so.  Without labels of both kinds the seed weights are used.
Repeated rows are scored one by one; a null doc_id is never held out.  An empty table gives no rows; other columns of
documents are no input of a score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, settle

#: Labelled training rows that the fit may use: those of the smallest hashes of doc_id.
TRAIN_ROWS = 16_000
#: What a learnt term needs: toxic texts, the share of them among its texts, and how many equals by chance.  The share
#: was chosen by rows of the training folds alone, fitting on three of them and scoring the fourth.
LEAST, PRECISE, BY_CHANCE = 3, 0.95, 0.05
#: Letters of a word beginning.  A whole word, marked by WHOLE, may have any number.
SHORTEST, LONGEST = 4, 9
WHOLE = "$"

# Seed words by class.
INSULTS = "idiot moron stupid scum trash loser worthless pathetic disgusting clown imbecile dumb idiota imbécile stupide crétin ordure dégoûtant dumm idiotisch abschaum wertlos ekelhaft estúpido escoria basura imbécil asqueroso".split()
THREATS = "kill hurt destroy strangle murder tuer frapper détruire töten umbringen schlagen matar golpear destruir".split()
TARGETS = "you your yourself u they them tu te toi vous votre vos du dich dir dein ihr euch tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never don't isn't aren't wasn't ne pas jamais aucun nicht kein keine nie nunca jamás tampoco".split()
REPORTS = "said says wrote called quoted claimed dit disait écrit sagte schrieb nannte dijo escribió llamó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Kinds of match: plain, aimed, denied, quoted insult; threat that is aimed; the same denied or quoted.
KINDS = ("plain", "aimed", "denied", "quoted", "threat", "weak_threat")
SEED_WEIGHTS = np.array([2.5, 3.5, 0.5, 0.5, 2.5, 0.2])
SEED_BIAS = -3.0
#: How far, in words, a negation reaches.
REACH = 3
CLAUSE_END = re.compile(r"[.!?;:\n\r]+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def _abuse(state: int, symbol: int) -> int:
    """0 nothing, 1 threat, 2 insult; the stronger stays."""
    return max(state, {INSULT: 2, THREAT: 1}.get(symbol, 0))


def _target(state: int, symbol: int) -> int:
    return 1 if symbol == TARGET else state


def _negation(state: int, symbol: int) -> int:
    """REACH+1 once abuse was met under a negation, else how many more words a negation reaches."""
    if state == REACH + 1:
        return state
    if symbol == NEGATION:
        return REACH
    if symbol in (INSULT, THREAT):
        return REACH + 1 if state else 0
    return max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    """1 after a word of reporting, 2 once abuse followed it."""
    if symbol == REPORT:
        return max(state, 1)
    return 2 if state and symbol in (INSULT, THREAT) else state


SHAPE = (3, 2, REACH + 2, 3)


def compose() -> tuple[list[list[int]], list[int]]:
    """The product automaton: next state by state and symbol, and the kind (or -1) of a clause that ends in a state."""
    step, kind = [], []
    for state in range(int(np.prod(SHAPE))):
        a, t, n, r = (int(x) for x in np.unravel_index(state, SHAPE))
        step.append([int(np.ravel_multi_index((_abuse(a, s), _target(t, s), _negation(n, s), _report(r, s)), SHAPE)) for s in range(6)])
        weak, quoted = n == REACH + 1, r == 2
        if a == 2:
            kind.append(2 if weak else 3 if quoted else 1 if t else 0)
        elif a == 1 and t:
            kind.append(5 if weak or quoted else 4)
        else:
            kind.append(-1)
    return step, kind


class Grammar:
    """The composed automaton with its word classes."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.exact: dict[str, int] = {}
        for words, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)):
            self.exact |= dict.fromkeys(words, symbol)
        self.whole = {k[:-1]: w for k, w in lexicon.items() if k.endswith(WHOLE)}
        self.lexicon = {k: w for k, w in lexicon.items() if not k.endswith(WHOLE) and k not in self.exact}
        self.longest = max(map(len, self.lexicon), default=0)
        self.step, self.kind = compose()
        self.finder = ahocorasick.Automaton()
        for word in (*self.lexicon, *self.whole, *THREATS):
            self.finder.add_word(word, len(word))
        self.finder.make_automaton()

    def _class(self, word: str) -> tuple[int, float]:
        if word in self.exact:
            return self.exact[word], 1.0
        if word in self.whole:
            return INSULT, self.whole[word]
        for n in range(min(len(word), self.longest), 0, -1):
            if word[:n] in self.lexicon:
                return INSULT, self.lexicon[word[:n]]
        return OTHER, 0.0

    def clauses(self, text: str) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, weight) of each matched clause of a whole text."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals lengthen; such characters mark no word here
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits = [end + 1 - n for end, n in self.finder.iter(low) if end - n < 0 or not low[end - n].isalnum()]
        if not hits:
            return []
        hits.sort()
        out, ends = [], [m.span() for m in CLAUSE_END.finditer(low)]
        stops = [a for a, _ in ends]
        done = -1
        for hit in hits:
            if hit < done:
                continue
            k = bisect.bisect_right(stops, hit)
            start, stop = ends[k - 1][1] if k else 0, stops[k] if k < len(stops) else len(low)
            done = stop
            state, weight = 0, 0.0
            for m in WORD.finditer(low, start, stop):
                symbol, w = self._class(m[0])
                state = self.step[state][symbol]
                if symbol in (INSULT, THREAT):
                    weight = max(weight, w)
            if (kind := self.kind[state]) >= 0:
                out.append((start, stop, kind, weight))
        return out

    def features(self, text: str) -> np.ndarray:
        """Per kind of match, one for the first clause and a tenth of log2(1 + rest) for the others, times the best word's weight."""
        best, count = np.zeros(len(KINDS)), np.zeros(len(KINDS))
        for _, _, kind, weight in self.clauses(text):
            best[kind] = max(best[kind], weight)
            count[kind] += 1
        return best * (1 + 0.1 * np.log2(np.maximum(count, 1)))


def terms(text: str) -> set[str]:
    """Word beginnings and whole words of a text, the features that labels choose from."""
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in {w[:LONGEST] for w in words} for n in range(SHORTEST, len(w) + 1)} | {w + WHOLE for w in words}


def chance(toxic: int, clean: int, rate: float) -> float:
    """Probability that of toxic + clean texts at least ``toxic`` are toxic, if each is so at the given rate."""
    n, up, down = toxic + clean, math.log(rate), math.log1p(-rate)
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * up + (n - k) * down) for k in range(toxic, n + 1))


def choose(counts: dict[str, tuple[int, int]], rivals: dict[int, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights (precisions, 0 to 1) of every term whose toxic and clean texts mark it as abuse.

    Each is judged by all its texts, whatever else they hold.  ``rivals`` has the number of terms by number of
    texts: of so many, fewer than ``BY_CHANCE`` may be expected to look as toxic without being so.
    """
    rate = n_toxic / (n_toxic + n_clean)
    kept = {t: (a, c) for t, (a, c) in counts.items() if a >= LEAST and a / (a + c) > PRECISE and chance(a, c, rate) * rivals[a + c] < BY_CHANCE}
    # A shorter beginning goes if what it adds to a longer one is mostly clean; then a longer one that adds no precision.
    for term in sorted(kept, key=lambda t: (-len(t), t)):
        if term in kept:
            a, c = kept[term]
            for short in (term[:n] for n in range(SHORTEST, len(term))):
                if short in kept and kept[short][1] > c and kept[short][0] - a <= 2 * (kept[short][1] - c):
                    del kept[short]
    spare = {t for t, (_, c) in kept.items() if any(kept.get(t[:n], (0, c + 1))[1] <= c for n in range(SHORTEST, len(t)))}
    return {t: a / (a + c + 0.5) for t, (a, c) in kept.items() if t not in spare}


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton steps with a weak prior at the seed weights; weights stay at 0 or above."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(SEED_WEIGHTS, SEED_BIAS)
    strength = np.append(np.full(x.shape[1], 1.0), 0.01)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(strength), z.T @ (p - y) + strength * (w - prior))
        w = w - step
        w[:-1] = np.clip(w[:-1], 0, 12)
        w[1] = max(w[0], w[1])  # an aimed insult weighs no less than a plain one
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Model:
    """Lexicon, kind weights and bias: all that scoring needs."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows outside the held-out fold; documents in several copies count once."""
    bounded(docs.sparkSession)
    seeds = dict.fromkeys(INSULTS, 0.9)
    wanted = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` pairs of numbers: proven small, so it is broadcast.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(wanted), "doc_id")
    sample = settle(sample.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.max("toxic").alias("toxic"), F.any_value("text").alias("text")).select("text", "toxic"))
    n = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(seeds, SEED_WEIGHTS, SEED_BIAS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found[label == 1].update(terms(text))
        met = list(found[0].keys() | found[1].keys())
        for at in range(0, len(met), 50_000):
            part = met[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[1][t] for t in part], pa.int64()), pa.array([found[0][t] for t in part], pa.int64())], ["term", "toxic", "clean"])

    counts = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # One row per pair of counts, of which a sample of that size has few; words only of the pairs that may be learnt.
    may = (F.col("toxic") >= LEAST) & (F.col("toxic") / (F.col("toxic") + F.col("clean")) > PRECISE)
    pairs = counts.groupBy("toxic", "clean").agg(F.count("*").alias("n"), F.collect_list(F.when(may, F.col("term"))).alias("terms")).collect()
    rivals: Counter = Counter()
    for r in pairs:
        rivals[r.toxic + r.clean] += r.n
    lexicon = seeds | choose({t: (r.toxic, r.clean) for r in pairs for t in r.terms}, rivals, n_toxic, n_clean)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            found = [grammar.features(x).tolist() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], ["x", "y"])

    rows_ = sample.select("text", "toxic").mapInArrow(features, "x array<double>, y int").groupBy("x").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
    x = np.repeat(np.array([r.x for r in rows_]), [r.n for r in rows_], axis=0)
    y = np.concatenate([np.repeat([1.0, 0.0], [r.y, r.n - r.y]) for r in rows_])
    return Model(lexicon, *logistic(x, y))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(score, n_clauses) of each row beside the columns named in ``keep``."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            scores, counts = [], []
            for text in batch.column("__text").to_pylist():
                found = grammar.features(text) if text else np.zeros(len(KINDS))
                scores.append(model.score(found))
                counts.append(int((found > 0).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores), pa.array(counts, pa.int32())], [*keep, "score", "n_kinds"])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]), "score double", "n_kinds int"])
    return chosen.mapInArrow(run, schema)


def keep_below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows, with all their columns, whose score stays below a limit."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        nothing = model.score(np.zeros(len(KINDS)))
        for batch in batches:
            keep = [(model.score(grammar.features(t)) if t else nothing) < limit for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_kinds) of every row; learns outside the held-out fold only."""
    scored = score(docs, fit(docs, labels), "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_kinds")
