import hashlib
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from kelpie.functions import hashes, hist, units, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(column.alias("r")).first().r


def all_of(spark, values, column, name="v"):
    """The column over many values at once, in their order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r.r for r in df.select("i", column.alias("r")).orderBy("i").collect()]


HOSTS = ["shelf", "a.b", "tape7.vault.museum", "x.y.or.jp", "or.jp", "n.go.kr", "deep.er.ne.tz", "www.Shop.COM.br", "com.br", "k.co", "q.ac", "q.ac.il", "q.ac.info", "end.dot.", "8.8.4.4", "99", "1.2", "[fe80::2]", "fe80::2", "::", "", "a1.2b", "x.go.uk", "net.net.nz"]


def plain_domain(host):
    host = host.lower().removesuffix(".")
    if not host.strip("0123456789.") or set(host) & set(":[]"):
        return "unknown"
    parts = host.split(".")
    second = {"ac", "co", "edu", "gov", "org", "com", "net", "or", "ne", "go"}
    return ".".join(parts[-3:] if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in second else parts[-2:])


def test_domains_follow_the_rules(spark):
    assert all_of(spark, HOSTS, urls.registrable_domain(F.col("v"))) == [plain_domain(h) for h in HOSTS]


def test_sites_drop_one_label(spark):
    names = [h for h in HOSTS if h.strip("0123456789.") and not set(h) & set(":[]")]
    plain = [h.lower().removesuffix(".") for h in names]
    assert all_of(spark, names, urls.site_of(F.col("v"))) == [h.split(".", 1)[1] if "." in h else h for h in plain]
    assert all_of(spark, ["8.8.4.4", "[fe80::2]"], urls.site_of(F.col("v"))) == ["8.8.4.4", "[fe80::2]"]


def test_paths_follow_the_rules(spark):
    """Random paths against the standard library's normal form, and against a stack that cannot leave the root."""
    rng = random.Random(12)
    paths = ["/".join(rng.choice(["", ".", "..", "k", "mm", "..."]) for _ in range(rng.randrange(1, 8))) for _ in range(300)] + ["////", "//.."]
    assert all_of(spark, paths, urls.posix_path(F.col("v"))) == [posixpath.normpath(p) for p in paths]
    want = []
    for p in paths:
        stack = []
        for part in p.split("/"):
            if part == "..":
                stack = stack[:-1]
            elif part not in ("", "."):
                stack.append(part)
        want.append("/" + "/".join(stack))
    assert all_of(spark, paths, urls.normalize_path(F.col("v"))) == want


def test_keys(spark):
    cases = {
        "ROOT://Vault.Museum:1094//shelf//2/./b/../leaf": "root://vault.museum:1094/shelf/2/leaf", "root://me@v//leaf": "root://v:1094/leaf", "root://[fe80::2]:77//leaf": "root://[fe80::2]:77/leaf",
        "https://v/leaf one": "https://v:443/leaf one", "http://v/x": "http://v:80/x", "no url at all": None,
    }
    assert all_of(spark, list(cases), urls.url_key(F.col("v"))) == list(cases.values())


def test_parameters(spark):
    assert one(spark, urls.url_key(F.col("u"), ["tone", "hue"]), u="root://v//leaf?tone=3&pass=HIDDEN&hue=2") == "root://v:1094/leaf?hue=2&tone=3"
    assert one(spark, urls.strip_parameters(F.col("u"), ["p"]), u="root://v//leaf?p=1&r=2") == "root://v//leaf?r=2"
    assert one(spark, urls.with_tried(F.col("u"), F.array(F.lit("n1"), F.lit("n2"))), u="root://v//leaf?tried=n1&r=2") == "root://v//leaf?tried=n1,n2&r=2"
    assert one(spark, urls.url_at_server(F.col("u"), F.lit("w:9")), u="root://v:2//leaf?z") == "root://w:9//leaf?z"
    assert one(spark, urls.logical_name(F.col("u"), ["/shelf/", "/desk/"]), u="/far/desk/shelf/leaf") == "lfn:/desk/shelf/leaf"


def plain_merge(url, reason=False, own=False, failed=None):
    """The rules of merged lists, said plainly."""
    base, mark, query = url.partition("?")
    params = [(p.partition("=")[0], p.partition("=")[2], p) for p in query.split("&") if p]
    lists, reasons = ([i for i, p in enumerate(params) if p[0] == k] for k in ("tried", "triedrc"))
    if not mark or not (lists or reasons):
        return url
    again = own and bool(reasons) and params[reasons[-1]][1].split(",")[-1] == "resel"
    dropped = max((i for i in lists if again and i < reasons[-1]), default=None)
    short = lambda h: h.split(":")[0].lower()
    hosts, saved = [], False
    for i in lists:
        for h in filter(None, params[i][1].split(",")):
            if i == dropped:
                if failed is None or short(h) not in map(short, failed):
                    continue
                saved = True
            if h.lower() not in [x.lower() for x in hosts]:
                hosts.append(h)
    keep, out = reason and bool(reasons) and not again, []
    for i, (k, _, p) in enumerate(params):
        if k == "tried":
            if hosts and i == lists[0]:
                out += ["tried=" + ",".join(hosts)] + ([params[reasons[-1]][2]] if keep else ["triedrc=ioerr"] if saved else [])
        elif k != "triedrc" or (keep and i == reasons[-1] and not hosts):
            out.append(p)
    return base + ("?" + "&".join(out) if out else "")


def test_lists_of_tried_hosts_follow_the_rules(spark):
    rng = random.Random(8)
    names = ["a", "A", "b:7", "B", "c.d", ""]
    piece = lambda: rng.choice([f"tried={','.join(rng.choice(names) for _ in range(rng.randrange(4)))}", f"triedrc={rng.choice(['resel', 'ioerr', 'ioerr,resel', 'resel,enoent', ''])}", "k=1", "k", "", "tried", "x==y"])
    texts = ["root://v//f", "", "root://v//f?"] + ["root://v//f?" + "&".join(piece() for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    u, failed = F.col("v"), ["B:1", "zz"]
    cases = {
        "plain": (urls.merge_tried(u), lambda t: plain_merge(t)), "reason": (urls.merge_tried(u, reason=True), lambda t: plain_merge(t, True)), "own": (urls.own_open_url(u), lambda t: plain_merge(t, True, True)),
        "failed": (urls.own_open_url(u, F.array(*map(F.lit, failed))), lambda t: plain_merge(t, True, True, failed)),
        "hosts": (F.array_join(urls.tried_hosts(u), ","), lambda t: "".join(re.findall(r"[?&]tried=([^&]*)", plain_merge(t)))),
    }
    for column, rule in cases.values():
        assert all_of(spark, texts, column) == [rule(t) for t in texts]
    many = F.array(*(F.lit(f"N{i}.x.") for i in range(20)))
    assert one(spark, urls.with_tried(F.col("u"), many), u="root://v//f?tried=n19.x") == "root://v//f?tried=n19.x," + ",".join(f"n{i}.x" for i in range(3, 19))
    assert one(spark, urls.with_tried(F.col("u"), F.array(F.lit("a"), F.lit("b" * 900), F.lit("c" * 200))), u="root://v//f") == "root://v//f?tried=" + "c" * 200
    shut = F.array(*map(F.lit, ["short", "8.8.4.4", "Q.r.", "[::1]"]))
    assert one(spark, urls.with_exclusions(F.col("u"), shut, F.lit("resel")), u="root://v//f?k=1") == "root://v//f?k=1&tried=q.r&triedrc=ioerr"
    assert one(spark, urls.with_exclusions(F.col("u"), F.array(F.lit("short")), F.lit("enoent")), u="root://v//f") == "root://v//f"
    split = one(spark, urls.split_tried_patterns(F.col("u")), u="root://v//f?tried=a*,b,A*,q*:1,,*!&z=*")
    assert (split.url, split.patterns, split.malformed) == ("root://v//f?tried=b&z=*", ["a*"], ["q*:1", "*!"])
    assert one(spark, urls.url_at_server(F.col("u"), F.lit("w:9")), u="root://me@v:2//f?tried=a&z=1") == "root://me@w:9//f?z=1"
    assert one(spark, urls.url_at_server(F.col("u"), F.lit("w:9"), True), u="root://v?tried=a") == "root://w:9?tried=a"


def test_validators(spark):
    uuid, salt = "01234567-89ab-cdef-0123-456789abcdef", "0f" * 16
    good = [f"tag:{uuid}:{salt}", f" \ttag:{uuid}:{salt}\n"]
    bad = [f"{uuid}:{salt}", f"tag:{uuid.upper()}:{salt}", f"tag:{uuid}:{salt}0", f"tag:{uuid}{salt}", f"tag:{uuid}:{salt[1:]}", ""]
    assert [r and tuple(r) for r in all_of(spark, good + bad, urls.parse_identity(F.col("v"), "tag:"))] == [(uuid, salt)] * 2 + [None] * len(bad)
    assert all_of(spark, ["*", "a*.b-c_d", "[*::1]", "*" + "a" * 252, "*::1"], urls.host_pattern_fault(F.col("v"))) == [None] * 5
    assert all_of(spark, ["", "*" + "a" * 253, "a.b", "*/x", "*:80", "*\n"], urls.host_pattern_fault(F.col("v"))) == ["empty", "too long", "no star", "no host character", "a port", "no host character"]
    assert all_of(spark, ["", " \t", "off", "/a/", "/a/ /b/c/\t/d/", " ".join(["/a/"] * 32)], urls.name_prefixes_fault(F.col("v"))) == [None] * 6
    assert all(all_of(spark, ["/", "//", "a/", "/a", "/a//b/", "/a/./", "/a/../b/", "/é/", "/" + "a" * 255 + "/", " ".join(["/a/"] * 33), "off /"], urls.name_prefixes_fault(F.col("v"))))
    answers = {"NORTH\nmore": "NORTH", " \tS-1\r\n": "S-1", "sitename": "", "two words": "", "": "", "\nX": "", "n" * 64: "n" * 64, "n" * 65: "", "é": ""}
    assert all_of(spark, list(answers), urls.site_name_of_answer(F.col("v"))) == list(answers.values())


def test_sizes_round_as_printf_does(spark):
    rng = random.Random(5)
    values = [0, 1, 2, 999, 1000, 1023, 1024, 1150, 1250, 1280, 1350, 999949, 999950, 999999, 10**18, 2**63 - 1] + [rng.randrange(10 ** rng.randrange(1, 19)) for _ in range(400)]

    def plain(n, base, names, limit):
        v, k = n / base, 0
        while v >= limit and k + 1 < len(names):
            v, k = v / base, k + 1
        return f"{v:.1f} {names[k]}"

    df = spark.createDataFrame([(n,) for n in values], "n long").select("n", units.human_size(F.col("n")).alias("b"), units.bytes_text(F.col("n")).alias("d"))
    for r in df.collect():
        assert r.b == (f"{r.n} B" if r.n < 1024 else plain(r.n, 1024, ["KiB", "MiB", "GiB", "TiB"], 1024)), r
        assert r.d == ("1 byte" if r.n == 1 else f"{r.n} bytes" if r.n < 1000 else plain(r.n, 1000, ["kB", "MB", "GB", "TB", "PB"], 999.95)), r


def test_coarse_urls_globs_sites(spark):
    assert one(spark, urls.coarse_url(F.col("u")), u="tape.vault.museum//shelf/leaf") == "root://unknown"
    assert one(spark, urls.coarse_url(F.col("u")), u="tape.vault.museum") == "root://vault.museum"
    assert one(spark, urls.coarse_url(F.col("u")), u="shelf") == "root://shelf"
    assert one(spark, urls.host_allowed(F.col("h"), ["*.Vault.Museum"], ["low*"]), h="tape.vault.museum") is True
    assert one(spark, urls.host_allowed(F.col("h"), [], ["l?w.[t-w]*"]), h="low.vault.museum") is False
    for name in ("p q%r", "", "-", "ø"):
        assert one(spark, urls.decode_site(urls.encode_site(F.col("n"))), n=name) == name
    assert one(spark, urls.encode_site(F.col("n")), n="p q%") == "p%20q%25"


def test_sizes_and_durations(spark):
    rng = random.Random(4)
    texts = ["", "0", "007k", "1.5g", "2tib", "30sb", "+1", "-1", " 1", "1 ", "k", "1kk", "18446744073709551615", "18446744073709551616", "16777216t", "16777215t", "9" * 40, "0" * 40 + "5"]
    texts += [f"{rng.randrange(10**rng.randrange(1, 14))}{rng.choice(['', *'kKmMgGtTsShdwx'])}" for _ in range(300)]

    def plain(text, units, most, bare=True):
        m = re.fullmatch(r"([0-9]+)(.?)", text)
        if not m or (m[2] and m[2] not in units) or (not m[2] and not bare):
            return None
        value = int(m[1]) * units.get(m[2], 1)
        return value if value <= most else None

    size = {c: 1 << 10 * (1 + "kmgt".index(c.lower())) for c in "kKmMgGtT"}
    time = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    whole = lambda xs: [None if x is None else int(x) for x in xs]
    assert whole(all_of(spark, texts, units.parse_size(F.col("v")))) == [plain(t, size, 2**64 - 1) for t in texts]
    assert whole(all_of(spark, texts, units.parse_duration(F.col("v")))) == [plain(t, time, 2**64 - 1) for t in texts]
    assert whole(all_of(spark, texts, units.parse_duration(F.col("v"), False))) == [0 if t == "0" else plain(t, time, 2**31 - 1, False) for t in texts]


def test_times_as_text(spark):
    for n in (0, 59, 60, 3599, 3600, 7500, 86399, 86400, 4 * 86400 + 3 * 3600 + 59, 40 * 86400):
        short = f"{n}s" if n < 60 else f"{n // 60}m{n % 60:02}s" if n < 3600 else f"{n // 3600}h{n % 3600 // 60:02}m" if n < 86400 else f"{n // 86400}d{n % 86400 // 3600}h"
        assert one(spark, units.human_duration(F.col("n")), n=n) == short
        setting = one(spark, units.format_duration(F.col("n")), n=n)
        assert int(one(spark, units.parse_duration(F.col("t"), False), t=setting)) == n and len(setting) <= len(f"{n}s")
    assert one(spark, units.human_size(F.col("n")), n=1536) == "1.5 KiB"
    assert one(spark, units.page_bytes(F.col("n"), F.lit(3)), n=3) == 2


def test_labels(spark):
    fine = [None, "", "  ", "night run 3", "größe", "x" * 80, " x" + "y" * 78 + " "]
    assert all_of(spark, fine, urls.valid_label(F.col("v"))) == [None] * len(fine)
    bad = ["-n", "  -n", "a/b", "a\\b", "me@v", "~me", "x" * 81, "é" * 41]
    assert all(all_of(spark, bad, urls.valid_label(F.col("v"))))


def test_histograms(spark):
    values = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 1024, (1 << 63) - 1)], "v long")
    assert {r.bucket: r.n for r in hist.histogram(values, F.col("v")).collect()} == {0: 2, 1: 2, 2: 1, 10: 1, 39: 1}
    both = spark.createDataFrame([([0, 0, 1],), ([0, 0, 1, 0, 0, 0, 0, 0, 0, 1],), (None,)], "h array<long>")
    assert hist.to_array(hist.merge_arrays(both, "h")).first().hist == [0, 0, 2, 0, 0, 0, 0, 0, 0, 1]
    q = {r.q: r.value for r in hist.quantile_buckets(hist.histogram(values, F.col("v")), [0.5, 0.99]).collect()}
    assert q == {0.5: 2, 0.99: 1024}
    assert one(spark, hist.quantile_of_array(F.col("h"), 0.5), h=[1, 0, 3]) == 4
    assert one(spark, hist.total_seconds(F.col("h")), h=[0, 1]) == pytest.approx(3e-6)


def test_hashes(spark):
    df = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "b binary")
    assert [r.c for r in df.select(hashes.crc32c("b").alias("c")).collect()] == [0xE3069283, 0, None]


def plain_fnv(data, value=1469598103934665603):
    for byte in data:
        value = (value ^ byte) * 1099511628211 % 2**64
    return value


def test_signatures(spark):
    rng = random.Random(6)
    files = [(f"run{i}", f"k/é{rng.randrange(10**6)}", rng.choice(["ab", "cde", "f"]) if i % 3 else rng.choice(["", "x"])) for i in range(12) for _ in range(rng.randrange(1, 9))]
    files = list({(s, k): (s, k, r) for s, k, r in files}.values())
    want = {}
    for stem in {s for s, _, _ in files}:
        own = sorted((k.encode(), r) for s, k, r in files if s == stem)
        reads = "".join(r for _, r in own).encode() if all(r for _, r in own) else None
        want[stem] = (f"{plain_fnv(b''.join(k + bytes([10]) for k, _ in own)) % 2**24:06x}", "" if reads is None else f"{plain_fnv(reads) % 2**24:06x}")
    found = hashes.run_signatures(spark.createDataFrame(files, "stem string, key string, read_sig string")).collect()
    assert {r.stem: (r.sig, r.read_sig) for r in found} == want
    sets = [sorted(k for s, k, _ in files if s == stem) for stem in sorted(want)] + [[], None]
    got = [r.s for r in spark.createDataFrame([(i, rng.sample(x, len(x)) if x else x) for i, x in enumerate(sets)], "i int, k array<string>").select("i", hashes.key_set_signature("k").alias("s")).orderBy("i").collect()]
    assert got == [want[stem][0] for stem in sorted(want)] + ["", None]
    buckets = [[5, 1, 3], [2**40], [], None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(buckets)), "i int, b array<long>").select("i", hashes.bucket_signature("b").alias("s")).orderBy("i").collect()]
    assert got == ["" if b == [] else None if b is None else f"{plain_fnv(b''.join(x.to_bytes(8, 'little') for x in sorted(b))) % 2**48:012x}" for b in buckets]


def test_salted_hashes(spark):
    salt, host, path = (F.lit(x) for x in ("pepper", " Tape.VAULT ", "/shelf//2/../"))
    sha = lambda x: hashlib.sha256(b"pepper" + bytes(1) + x.encode()).hexdigest()[:32]
    assert one(spark, hashes.machine_hash(salt, host)) == sha("machine:tape.vault")
    assert one(spark, hashes.location_hash(salt, host, path)) == sha("location:tape.vault" + chr(0) + "/shelf")
    assert one(spark, hashes.volume_hash(salt, host, path)) == sha("volume:tape.vault" + chr(0) + "/shelf")


@pytest.mark.parametrize(
    ("command", "shared"),
    [("/usr/bin/tool bench --log x --dir=/a/b 'c d' ~/e -n=3", "tool bench --dir=<path> c d <path> -n=3"), ("python /x.py --log=y", "<exe> <path>"), ("", ""), ('tool "a\\"b" c\\ d \'open', 'tool a"b c d open'), (None, None)],
)
def test_commands(spark, command, shared):
    from kelpie.functions.commands import normalized_command

    df = spark.createDataFrame([(command,)], "c string")
    assert df.select(normalized_command(F.col("c"), "tool").alias("r")).first().r == shared
