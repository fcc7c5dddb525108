import random
from collections import defaultdict

import numpy as np
import xxhash

from kelpie.llm import simhash
from kelpie.llm.components import connected_components


def plain_fingerprint(text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(items)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in items}


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(2)
    for turn in (0, 1):
        family = simhash.masks(3, turn)
        assert len(family) == 15
        for _ in range(3000):
            differ = sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 4)))
            assert any(not differ & m for m in family)


def test_link_groups_equals_brute_force_and_stays_small():
    rng = np.random.default_rng(3)
    center = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for c in center]))
    ids = np.arange(len(values))
    a, b = simhash.link_groups(np.zeros(len(values), np.int64), values, ids, 3)
    assert len(a) < len(values)
    got = plain_components(ids.tolist(), lambda x, y: (x, y) in pairs or (y, x) in pairs) if (pairs := set(zip(a.tolist(), b.tolist()))) else {}
    want = plain_components(ids.tolist(), lambda x, y: int(values[x] ^ values[y]).bit_count() <= 3)
    assert got == want


def test_large_groups_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_GROUP", 50)
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b = simhash.link_groups(np.zeros(len(values), np.int64), values, np.arange(len(values)), 1)
    pairs = set(zip(a.tolist(), b.tolist()))
    ids = range(len(values))
    assert plain_components(ids, lambda x, y: (x, y) in pairs or (y, x) in pairs) == plain_components(ids, lambda x, y: int(values[x] ^ values[y]).bit_count() <= 1)


def test_near_duplicates_equal_brute_force(docs, rows):
    got = defaultdict(set)
    for r in simhash.near_duplicates(docs).collect():
        got[r.doc_id].add((r.fingerprint, r.component_id))
    prints = {(d, t): plain_fingerprint(t) for d, t in rows}
    distinct = sorted(set(prints.values()))
    roots = plain_components(distinct, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[roots[p]] = min(least.get(roots[p], d), d)
    want = defaultdict(set)
    for (d, _), p in prints.items():
        want[d].add((f"{p:016x}", least.get(roots[p])))
    assert got == want


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (3, 2), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 150), 100)


def test_hub_of_many_edges_is_dealt_out(spark):
    """A star, a chain and a clique, with nodes beyond five edges dealt to several tasks."""
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(a, b) for a in range(200, 212) for b in range(200, 212)] + [(300, 59)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {tuple(r) for r in connected_components(edges, node_edges=5).collect()}
    assert got == {(i, 0) for i in [*range(60), 300]} | {(i, 100) for i in range(100, 141)} | {(i, 200) for i in range(200, 212)}
