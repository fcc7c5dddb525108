import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kelpie.llm import packing, tokens


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets, used = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    free = []
    for size, b, o in zip(sizes, bins.tolist(), offsets.tolist()):
        place = next((i for i, f in enumerate(free) if f >= size), len(free))
        if place == len(free):
            free.append(50)
        assert (b, o) == (place, 50 - free[place])
        free[place] -= size
    assert used == len(free)


def test_ids_equal_the_reference_tokenizer(rows):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t in rows] + ["a <|endoftext|> b", "it's I'LL  x \n\n y\t", "١٢٣ 漢字   ​"]
    for t in texts:
        got = tokens.encode(t, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        assert got.tolist() == exact.encode(t, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(docs, rows):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, 128).collect()
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    want = Counter()
    for d, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for a in range(0, len(ids), 128):
            want[d, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes()), len(ids)] += 1
    assert got == want


def test_empty(empty):
    assert packing.pack_documents(empty).collect() == []


def test_production_length_wastes_little(docs, rows):
    """At 1024 ids a sequence: whole pieces fill sequences of their own, and the rest needs at most 11/9 of what any packing does, and one."""
    out = packing.pack_documents(docs).collect()
    whole = [r for r in out if r.length == 1024]
    assert whole and len({r.sequence_id for r in whole}) == len(whole) and all(r.offset == 0 for r in whole)
    rest = defaultdict(int)
    for r in out:
        if r.length < 1024:
            rest[r.sequence_id] += r.length
    assert not {r.sequence_id for r in whole} & set(rest) and max(rest.values()) <= 1024
    assert len(rest) <= -(-sum(rest.values()) // 1024) * 11 / 9 + 1


def test_only_whole_pieces_and_many_groups(spark):
    """No leftovers at all, and leftovers in groups of a few: numbers never clash."""
    frame = spark.createDataFrame([(i, 0, 8 if i % 3 else 5, 0, 8, i * 7919) for i in range(90)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long")
    full = packing.pack(frame.where("length = 8"), 8).collect()
    assert len(full) == 60 and len({r.sequence_id for r in full}) == 60
    mixed = packing.pack(frame, 8, group=4).collect()
    assert len(mixed) == 90 and len({r.sequence_id for r in mixed}) == 90
