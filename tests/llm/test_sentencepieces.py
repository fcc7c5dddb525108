import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import sentencepieces as S

PATH = S.model_path()
ids = lambda b: np.frombuffer(b, "<u4").tolist()


def test_without_dropout_equals_the_library(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t or "" for _, t in rows] + ["  two  spaces ", "tabs\tand\nlines", "z" * 300 + " q", " " * 40]
    for text, got in zip(texts, S.Encoder(PATH, 0.0).encode_batch(texts, [0] * len(texts))):
        assert ids(got) == model.encode(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.integers(0, 3))
def test_decodes_to_the_same_text(text, variant):
    e = S.Encoder(PATH, 0.3)
    assert e.decode(e.encode_batch([text], [variant])[0]) == text.encode("utf-8", "surrogatepass")


def test_space_marks_survive():
    e = S.Encoder(PATH, 0.2)
    for text in ("a▁b", "▁", " ▁ ", "▁▁ x"):
        assert e.decode(e.encode_batch([text], [1])[0]).decode() == text


def test_both_agendas_agree_and_dropout_is_seeded():
    words = [" hello", " international", "ization", " straße", " co-operate"] * 3
    e = S.Encoder(PATH, 0.3)
    symbols = [e.model.symbols(w) for w in words]
    keys = [S.word_key(w, 5, i) for i, w in enumerate(words)]
    side = S.side_by_side(symbols, keys, e.model, 0.3)
    assert [ids(x) for x in side] == [S.agenda(s, k, e.model, 0.3) for s, k in zip(symbols, keys)]
    assert side == S.side_by_side(symbols, keys, e.model, 0.3)
    assert len({bytes(x) for x in S.side_by_side([symbols[1]] * 50, [S.word_key(words[1], s, 0) for s in range(50)], e.model, 0.3)}) > 5


def test_documents(spark, docs, rows, empty):
    out = S.round_trip(docs, PATH).collect()
    want = sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out) == want
    encoded = S.encode_documents(docs, PATH)
    back = S.decode_documents(encoded, PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(d), t or "") for d, t in rows)
    sizes = {(r.doc_id, r.n_pieces, r.ids_crc32) for r in out}
    assert sizes == {(r.doc_id, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in encoded.collect()}
    assert S.round_trip(empty, PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        S.Model(str(tmp_path / "none"))


def test_every_occurrence_is_drawn_anew():
    word, n = " international", 400
    e = S.Encoder(PATH, 0.3)
    (one,) = e.encode_batch([(word * n)[1:]], [7])
    assert (one,) == tuple(S.Encoder(PATH, 0.3).encode_batch([(word * n)[1:]], [7])) and e.decode(one).decode() == (word * n)[1:]
    forms, cut = set(), []
    for i in ids(one):
        if e.model.value[i].startswith(b" ") and cut:
            forms.add(tuple(cut))
            cut = []
        cut.append(i)
    assert len(forms) > 10
    assert len(set(e.encode_batch([word[1:]] * n, list(range(n))))) > 10


def test_kept_words_equal_an_agenda_of_their_own():
    """Pieces of each occurrence, kept or not, are those of the agenda with that occurrence's key."""
    e, text = S.Encoder(PATH, 0.1), "a quick international organisation " * 30 + "z" * 60 + "abcdefghij" * 8
    key = np.uint64(S.word_key("3", S.SEED, 0))
    want = []
    for i, w in enumerate(S.WORD.findall(" " + text)):
        own = S.mix(np.array([key ^ S.mix(np.array([i + 1], dtype=np.uint64))[0]]))[0]
        want += S.agenda(e.model.symbols(w), int(own), e.model, 0.1)
    assert ids(e.encode_batch([text], [3])[0]) == want


def naive(word, key, model, rate):
    """The pieces of a word by trying all neighbours anew after every merge; pieces are strings, draws are spelt out."""
    score = {p: -r for p, r in ((x, int(model.rank[i])) for x, i in model.ids.items())}
    mark = lambda c: S.SPACE if c == " " else c
    parts = []
    for c in word:
        if c != S.SPACE and mark(c) in model.ids:
            parts.append(mark(c))
        else:
            parts += [bytes([b]) for b in c.encode()]
    spans = [(i, i + 1) for i in range(len(parts))]

    def dropped(a, m, b):
        def mixed(x):
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
            return x ^ x >> 31

        return (mixed(mixed(a << 42 ^ m << 21 ^ b) ^ key) >> 11) * 2.0**-53 < rate

    while True:
        best = None
        for i in range(len(parts) - 1):
            if isinstance(parts[i], str) and isinstance(parts[i + 1], str) and (one := parts[i] + parts[i + 1]) in score:
                if not dropped(spans[i][0], spans[i][1], spans[i + 1][1]) and (best is None or score[one] > score[parts[best] + parts[best + 1]]):
                    best = i
        if best is None:
            return [model.bytes[p[0]] if isinstance(p, bytes) else model.ids[p] for p in parts]
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
        spans[best : best + 2] = [(spans[best][0], spans[best + 1][1])]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_batches_equal_a_naive_encoder(rows, rate):
    e = S.Encoder(PATH, rate, kept_bytes=3000)
    texts = [t or "" for _, t in rows if len(t or "") < 900] + ["an international organisation of organisations " * 5, "naïve▁ straße  😀 " + "z" * 70]
    for _ in range(2):  # the second time words are known, or have been given up for others
        for doc, (text, got) in enumerate(zip(texts, e.encode_batch(texts, list(range(len(texts)))))):
            key = np.uint64(S.word_key(str(doc), S.SEED, 0))
            want = []
            for i, w in enumerate(S.WORD.findall(" " + text) if text else []):
                want += naive(w, int(S.mix(np.array([key ^ S.mix(np.array([i + 1], dtype=np.uint64))[0]]))[0]), e.model, rate)
            assert ids(got) == want


def test_occurrences_that_draw_alike_share_an_agenda(monkeypatch):
    """Every occurrence has the pieces of its own agenda, but fewer are merged than have a merge skipped (here one in three)."""
    n, merged = 2000, []
    text = "then the naïve ▁of and  the 😀s" * n
    whole, e = S.merge_all, S.Encoder(PATH, 0.1)
    monkeypatch.setattr(S, "merge_all", lambda sym, sizes, *rest: (merged.append(len(sizes)), whole(sym, sizes, *rest))[1])
    (got,) = e.encode_batch([text], [3])
    shared, key = sum(merged), np.uint64(S.word_key("3", S.SEED, 0))
    found = S.WORD.findall(" " + text)
    own = S.mix(key ^ S.mix(np.arange(1, len(found) + 1, dtype=np.uint64)))
    alone = S.side_by_side([e.model.symbols(w) for w in found], own.tolist(), e.model, 0.1)
    assert got == b"".join(alone)
    assert shared < len(found) / 5


@pytest.mark.parametrize("texts", [[], [""], ["", "", " "], [" a", "", "b ", " ", "  c  d  ", "\n \n"], ["\ud800x \udc00"]])
def test_words_of_texts_are_those_of_the_pattern(texts):
    words, at, sizes = S.split_words([t.encode("utf-8", "surrogatepass") for t in texts])
    assert [words[i].decode("utf-8", "surrogatepass") for i in at] == [w for t in texts if t for w in S.WORD.findall(" " + t)]
    assert sizes.tolist() == [len(S.WORD.findall(" " + t)) if t else 0 for t in texts]
    e = S.Encoder(PATH, 0.3)
    assert [e.decode(x).decode("utf-8", "surrogatepass") for x in e.encode_batch(texts, list(range(len(texts))))] == texts
    assert [x.decode("utf-8", "surrogatepass") for x in e.decode_joined(*e.encode_joined([t.encode("utf-8", "surrogatepass") for t in texts], list(range(len(texts)))))] == texts
