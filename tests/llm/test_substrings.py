import hashlib
import random
import re

from kelpie.llm import substrings
from kelpie.llm.automaton import SuffixAutomaton

LAST = (1 << 63) - 1


def split(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


def plain(rows, window):
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (LAST if d is None else d):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_automaton_equals_brute_force():
    for seed in range(200):
        rng = random.Random(seed)
        window = rng.choice([2, 3, 4])
        spans = [(rng.randrange(20), [bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(12))]) for _ in range(rng.randrange(1, 6))]
        query = [bytes([97 + rng.randrange(4)]) for _ in range(rng.randrange(25))]
        want = [min([d for d, w in spans for j in range(len(w) - window + 1) if w[j : j + window] == query[i : i + window]], default=LAST) for i in range(len(query) - window + 1)]
        assert SuffixAutomaton(spans, window).statistics(query) == want


def test_documents_equal_brute_force(docs, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(docs).collect()), key=str)
    assert got == plain(rows, substrings.WINDOW)
    assert sum(x[2] for x in got) > 0


def test_many_blocks_shards_and_streams(spark, monkeypatch):
    """A passage in a third of all texts, mosaics of earlier texts, and texts of few words, in blocks of a few rows."""
    monkeypatch.setattr(substrings, "SHARD_BYTES", 400)
    monkeypatch.setattr(substrings, "STREAM_BYTES", 500)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(120):
        own = " ".join(f"v{rng.randrange(8)}" for _ in range(rng.randrange(60)))
        rows.append((rng.randrange(100), f"{own} {passage} {own}" if i % 3 == 0 else own))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(df, block_bytes=2000).collect()), key=str)
    assert got == plain(rows, substrings.WINDOW)


def test_kept_text_and_empty_table(docs, empty):
    kept = [r for r in substrings.deduplicate(docs, keep_text=True).collect() if r.n_removed]
    assert kept and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in kept)
    assert substrings.deduplicate(empty).collect() == []


def test_clashing_keys_hide_no_window(docs, rows):
    """With 8 bits of a window's first hash beside its bucket's, hundreds of windows share one; all are still told apart."""
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(docs, block_bytes=2000, kept=8).collect()), key=str)
    assert got == plain(rows, substrings.WINDOW)
