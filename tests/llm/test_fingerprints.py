import hashlib
import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kelpie.llm import fingerprints as fp

short = st.text(alphabet="ab", max_size=30)


@settings(max_examples=200, deadline=None)
@given(short, short, st.integers(0, 30), st.integers(0, 30))
def test_span_equality_and_extension(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    x, y = fp.PrefixHashes(fp.code_points(a)), fp.PrefixHashes(fp.code_points(b))
    n = len(os.path.commonprefix([a[i:], b[j:]]))
    assert x.common_extension(i, y, j) == n
    for length in range(min(len(a) - i, len(b) - j) + 1):
        assert x.equal(i, y, j, length) == (a[i : i + length] == b[j : j + length])


def test_spans_do_not_depend_on_place():
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    x, y = (fp.PrefixHashes(fp.code_points(t)) for t in (text, "123" + text))
    assert set(x.spans(24).tolist()) <= set(y.spans(24).tolist())


def test_documents_equal_brute_force(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        mark = lambda s: fp.PrefixHashes(fp.code_points(s)).fingerprint()
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(t), mark(e), fp.likeness(mark(t), mark(e)), fp.likeness(mark(t), mark(n)), len(os.path.commonprefix([t, e]))))
    assert sorted(map(tuple, fp.fingerprint_documents(docs).collect()), key=str) == sorted(want, key=str)


def test_likeness_follows_content(rows):
    mark = lambda s: fp.PrefixHashes(fp.code_points(s)).fingerprint()
    long = max((t for _, t in rows if t), key=len)
    assert fp.likeness(mark(long), mark(long)) == 1
    assert 0.25 < fp.likeness(mark(long), mark(long[: len(long) // 2] + "#" * (len(long) // 2))) < 0.95
    assert fp.likeness(mark(long), mark(long[::-1])) < 0.2
    assert fp.likeness(mark(""), mark("x")) == 0


def plain_fingerprint(text):
    """From the definition, with whole numbers only."""
    codes, n = [ord(c) + 1 for c in text], len(text)

    def polynomial(a, b):
        return [sum(c * pow(base, j, p) for j, c in enumerate(codes[a:b])) % p for p, base in zip(fp.PRIMES, fp.BASES)]

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    def joined(a, b):
        high, low = polynomial(a, b)
        return high << 31 | low

    def sketch(span, bins):
        found = {mixed(joined(i, i + span)) for i in range(n - span + 1)} or ({mixed(joined(0, n))} if n else set())
        out = ""
        for k in range(bins):
            own = [x for x in found if x * bins >> 64 == k]
            out += f"{mixed(min(own)) % 4096:03x}" if own else "---"
        return out

    return f"{joined(0, n):016x}{n:08x}{sketch(24, 64)}{sketch(3, 32) if n < 768 else ''}"


def test_fingerprints_equal_the_definition(rows):
    for text in ["", "a", "ab", "abc", "é ü \U0001f600 ñ", "x" * 23, "y" * 24, "the cat sat on the mat " * 5, *[t for _, t in rows if t and 700 < len(t) < 900][:3]]:
        assert fp.PrefixHashes(fp.code_points(text)).fingerprint() == plain_fingerprint(text)


def test_likeness_is_near_the_true_share():
    """Texts with a known share of their content in common, short and long ones, and none in common."""
    mark = lambda s: fp.PrefixHashes(fp.code_points(s)).fingerprint()
    rng = random.Random(3)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    for n in (16, 40, 90, 300, 5000):
        got = []
        for _ in range(30):
            a = fresh(n)
            got.append(fp.likeness(mark(a), mark(a[: n - n // 2] + fresh(n // 2))))
            assert fp.likeness(mark(a), mark(fresh(n))) < 0.35
        assert 0.25 < sum(got) / len(got) < 0.75


def test_compare_spans(spark, docs, rows):
    texts = {d: t or "" for d, t in rows if d is not None}
    rng = random.Random(1)
    ids = sorted(texts)
    asked = [(rng.choice(ids), rng.randrange(0, 80), rng.choice(ids), rng.randrange(0, 80), rng.randrange(0, 9)) for _ in range(60)]
    asked += [(i, 2, i, 2, 5) for i in ids] + [(None, 0, 1, 0, 1), (1, None, 1, 0, 1), (10**9, 0, 1, 0, 1), (1, -1, 1, 0, 1), (1, 0, 1, 0, None)]
    want = []
    for a, i, b, j, n in asked:
        if None in (a, i, b, j) or i < 0 or a not in texts:
            want.append((a, i, b, j, n, None, None))
            continue
        x, y = texts[a][i:], texts[b][j:]
        want.append((a, i, b, j, n, None if n is None else len(x) >= n <= len(y) and i <= len(texts[a]) and j <= len(texts[b]) and x[:n] == y[:n], len(os.path.commonprefix([x, y]))))
    got = fp.compare_spans(docs, spark.createDataFrame(asked, fp.QUESTIONS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_row_and_empty(spark, empty):
    one = fp.fingerprint_documents(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in one] == [(5, 4, hashlib.sha256(b"abab").hexdigest())]
    assert fp.fingerprint_documents(empty).collect() == []
