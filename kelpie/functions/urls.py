"""URL keys: normalisation, sites, domains, redaction.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT_FAMILY = ("root", "roots", "xroot", "xroots")
DEFAULT_PORTS = {"http": 80, "https": 443} | dict.fromkeys(ROOT_FAMILY, 1094)
# Second-level names under a country's domain that hold registrations one level lower.
SECOND_LEVEL = ("ac", "co", "edu", "gov", "org", "com", "net", "or", "ne", "go")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)(?::([0-9]+))?([^?]*)(?:\?(.*))?$"
_IP = r"^(\[.*\]|.*:.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def normalize_path(path: Column) -> Column:
    """Slashes collapsed, '.' dropped, '..' popped without leaving the root; empty gives '/'."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.expr("cast(array() as array<string>)")
    # A fold over the parts: '..' takes the last part away, if there is one.
    kept = F.aggregate(parts, none, lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def default_port(scheme: Column) -> Column:
    port = F.lit(0)
    for name, number in DEFAULT_PORTS.items():
        port = F.when(scheme == name, F.lit(number)).otherwise(port)
    return port


def kept_parameters(query: Column, keep: list[str]) -> Column:
    """Whitelisted parameters sorted by name, the last of equal names; none gives ''."""
    if not keep:
        return F.lit("")
    pairs = F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.split(p, "=", 2)[0].isin(keep)), lambda p, i: F.struct(F.split(p, "=", 2)[0].alias("k"), i.alias("i"), p.alias("p")))
    last = F.filter(pairs, lambda x: ~F.exists(pairs, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return F.array_join(F.transform(F.array_sort(last), lambda x: x["p"]), "&")


def url_parts(url: Column) -> dict[str, Column]:
    get = lambda i: F.regexp_extract(url, _URL, i)
    return {"scheme": F.lower(get(1)), "host": F.lower(get(2)), "port": get(3), "path": get(4), "query": get(5)}


def url_key(url: Column, keep: list[str] | None = None) -> Column:
    """scheme://host:port/path of a URL, lower-cased host, explicit port, normal path; null where it is no URL."""
    p = url_parts(url)
    port = F.when(p["port"] != "", p["port"]).otherwise(default_port(p["scheme"]).cast("string"))
    query = kept_parameters(p["query"], keep or [])
    key = F.concat(p["scheme"], F.lit("://"), p["host"], F.lit(":"), port, normalize_path(p["path"]), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(p["scheme"] != "", key)


def object_id(key: Column) -> Column:
    return F.sha2(key, 256)


def logical_name(path: Column, prefixes: list[str]) -> Column:
    """'lfn:' and the path from the leftmost of the prefixes on; null where none occurs."""
    if not prefixes:
        return F.lit(None).cast("string")
    places = [F.when(F.instr(path, p) > 0, F.instr(path, p)) for p in prefixes]
    at = F.least(*places) if len(places) > 1 else places[0]
    return F.when(at.isNotNull(), F.concat(F.lit("lfn:"), path.substr(at, F.length(path))))


def stored_key(url: Column, prefixes: list[str], keep: list[str] | None = None) -> Column:
    """The key a stored URL has under the given prefixes."""
    return F.coalesce(logical_name(normalize_path(url_parts(url)["path"]), prefixes), url_key(url, keep))


def host_of(key: Column) -> Column:
    return F.regexp_extract(key, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)


def host_port_of(url: Column) -> Column:
    """host:port, lower-cased, 1094 by default, without user."""
    port = F.regexp_extract(url, _URL, 3)
    return F.concat(F.lower(host_of(url)), F.lit(":"), F.when(port != "", port).otherwise(F.lit("1094")))


def site_of(host: Column) -> Column:
    """A host without its first label; addresses and names without a dot stay."""
    low = F.regexp_replace(F.lower(host), r"\.$", "")
    return F.when(low.rlike(_IP) | ~low.contains("."), low).otherwise(F.regexp_replace(low, r"^[^.]*\.", ""))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a country's second level; a single label is itself, addresses and empty names are 'unknown'."""
    low = F.regexp_replace(F.lower(host), r"\.$", "")
    labels = F.split(low, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    name = F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(deep, F.lit(2)).otherwise(F.lit(1))), F.lit(3)), ".")
    return F.when(low.isNull() | (low == "") | low.rlike(r"^[0-9.]*$|[:\[\]]"), F.lit("unknown")).otherwise(name)


def coarse_url(url: Column) -> Column:
    """Scheme and registrable domain of a root URL; what has none is root://unknown."""
    bare = F.when(url.contains("://"), host_of(url)).when(url.contains("/"), F.lit("")).otherwise(url)
    scheme = F.when(url.contains("://"), F.lower(F.substring_index(url, "://", 1))).otherwise(F.lit("root"))
    return F.concat(scheme, F.lit("://"), registrable_domain(bare))


def posix_path(path: Column) -> Column:
    """POSIX normal form: '..' stays where nothing is above it, two leading slashes stay two, three become one; empty is '.'."""
    lead = F.when(path.rlike("^//[^/]") | (path == "//"), F.lit("//")).when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(a: Column, p: Column) -> Column:
        above = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != "..")
        popped = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        return F.when(p != "..", F.concat(a, F.array(p))).when(above, popped).when(lead != "", a).otherwise(F.concat(a, F.array(p)))

    out = F.concat(lead, F.array_join(F.aggregate(parts, none, step), "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def salted_hash(salt: Column, value: Column) -> Column:
    """The first 32 hex digits of SHA-256 over salt, a zero byte and the value."""
    return F.substring(F.sha2(F.concat(salt.cast("binary"), F.unhex(F.lit("00")), value.cast("binary")), 256), 1, 32)


def strip_parameters(url: Column, names: list[str]) -> Column:
    """A URL without the named parameters; order of the rest stays."""
    base = F.substring_index(url, "?", 1)
    left = F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.split(p, "=", 2)[0].isin(names))
    return F.when(~url.contains("?") | (F.size(left) == 0), base).otherwise(F.concat(base, F.lit("?"), F.array_join(left, "&")))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, whatever the number of places that read it."""
    return F.transform(F.array(value), use)[0]


_NO_TEXTS = "cast(array() as array<string>)"


def _parameters(url: Column) -> Column:
    """The non-empty parameters of a URL as (i, k, v, p); the key ends at the first '='."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^?]*\?([\s\S]*)$", 1), "&", -1), lambda p: p != "")
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
    return F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.substring_index(p, "=", 1).alias("k"), value(p).alias("v"), p.alias("p")))


def _first_of_each(names: Column) -> Column:
    """Names without those that came before in either case."""
    return _let(names, lambda n: _let(F.transform(n, F.lower), lambda low: F.filter(n, lambda h, i: F.array_position(low, F.lower(h)) == i + 1)))


def _listed(rows: Column) -> Column:
    hosts = F.flatten(F.transform(F.filter(rows, lambda r: r["k"] == "tried"), lambda r: F.split(r["v"], ",", -1)))
    return _first_of_each(F.filter(F.coalesce(hosts, F.expr(_NO_TEXTS)), lambda h: h != ""))


def tried_hosts(url: Column) -> Column:
    """Distinct hosts, in either case, of all of a URL's ``tried`` parameters in order."""
    return _let(_parameters(url), _listed)


def _last_of(rows: Column, key: str, before: Column | None = None) -> Column:
    of = F.filter(rows, lambda r: (r["k"] == key) & (F.lit(True) if before is None else r["i"] < before))
    return F.coalesce(F.array_max(F.transform(of, lambda r: r["i"])), F.lit(-1))


def _with_base(url: Column, parts: Column) -> Column:
    base = F.substring_index(url, "?", 1)
    return F.when(F.size(parts) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(parts, "&")))


def merge_tried(url: Column, reason: bool = False, own: bool = False, failed: Column | None = None) -> Column:
    """A URL with one ``tried`` list, at the place of the first, of the distinct hosts of all.

    ``reason`` keeps the last ``triedrc``, behind the list, or where it stands if no host is left; the others go.  With
    ``own`` a request to select anew (a last reason of 'resel') is taken back: its reason goes, and with it the list
    before it, of which only hosts among ``failed`` stay, for the reason 'ioerr'.  Other parameters stay in order.
    """

    def rebuilt(rows: Column) -> Column:
        return _let(F.struct(rows.alias("rows"), _last_of(rows, "triedrc").alias("last"), _last_of(rows, "tried").alias("any")), merged)

    def merged(c: Column) -> Column:
        said = F.element_at(F.split(F.try_element_at(c["rows"], c["last"] + 1)["v"], ",", -1), -1)
        again = (c["last"] >= 0) & (said == "resel") if own else F.lit(False)
        dropped = F.when(again, _last_of(c["rows"], "tried", c["last"])).otherwise(-1)
        return _let(F.struct(c.alias("c"), F.coalesce(again, F.lit(False)).alias("again"), F.coalesce(dropped, F.lit(-1)).alias("dropped")), kept)

    def kept(d: Column) -> Column:
        rows = d["c"]["rows"]
        if failed is None:
            left, saved = F.filter(rows, lambda r: r["i"] != d["dropped"]), F.lit(False)
        else:
            bare = lambda h: F.lower(F.substring_index(h, ":", 1))
            known = lambda h: (h != "") & F.array_contains(F.transform(failed, bare), bare(h))
            part = lambda r: F.when(r["i"] == d["dropped"], F.array_join(F.filter(F.split(r["v"], ",", -1), known), ",")).otherwise(r["v"])
            left = F.transform(rows, lambda r: F.struct(r["i"].alias("i"), r["k"].alias("k"), part(r).alias("v"), r["p"].alias("p")))
            saved = F.exists(left, lambda r: (r["i"] == d["dropped"]) & (r["v"] != ""))
        return _let(F.struct(d.alias("d"), _listed(left).alias("hosts"), saved.alias("saved")), joined)

    def joined(e: Column) -> Column:
        rows, last, hosts = e["d"]["c"]["rows"], e["d"]["c"]["last"], e["hosts"]
        none = F.expr(_NO_TEXTS)
        keep = (last >= 0) & ~e["d"]["again"] if reason else F.lit(False)
        why = F.when(keep, F.array(F.try_element_at(rows, last + 1)["p"])).when(e["saved"], F.array(F.lit("triedrc=ioerr"))).otherwise(none)
        first = F.array_min(F.transform(F.filter(rows, lambda r: r["k"] == "tried"), lambda r: r["i"]))
        listed = lambda r: F.when((r["i"] == first) & (F.size(hosts) > 0), F.concat(F.array(F.concat(F.lit("tried="), F.array_join(hosts, ","))), why)).otherwise(none)
        in_place = lambda r: F.when(keep & (r["i"] == last) & (F.size(hosts) == 0), F.array(r["p"])).otherwise(none)
        parts = F.flatten(F.transform(rows, lambda r: F.when(r["k"] == "tried", listed(r)).when(r["k"] == "triedrc", in_place(r)).otherwise(F.array(r["p"]))))
        return F.when((e["d"]["c"]["any"] < 0) & (last < 0), url).otherwise(_with_base(url, parts))

    return F.when(~url.contains("?"), url).otherwise(_let(_parameters(url), rebuilt))


def own_open_url(url: Column, failed: Column | None = None) -> Column:
    """The URL to open when a reader's request to select anew is not to be passed on; see ``merge_tried``."""
    return merge_tried(url, reason=True, own=True, failed=failed)


# Names that may be added to a list, those of a failed open, and the bytes of a whole list.
_AVOIDED_MOST, _OURS_MOST, _LIST_BYTES = 16, 4, 1024


def _added(theirs: Column, names: Column, most: int) -> Column:
    """The newest ``most`` names that are not listed yet, lower-case, as many as the whole list's bytes allow."""
    fresh = _let(theirs, lambda t: F.filter(F.array_distinct(names), lambda h: (h != "") & ~F.array_contains(F.transform(t, F.lower), h)))
    newest = _let(fresh, lambda n: F.slice(n, F.greatest(F.size(n) - most + 1, F.lit(1)), most))
    taken = lambda names: F.aggregate(names, F.lit(0), lambda a, h: a + F.octet_length(h) + 1)
    # The longest end of the list that fits: a name stays if it and all after it do.
    return _let(newest, lambda n: F.filter(n, lambda h, i: taken(theirs) + taken(F.slice(n, i + 1, F.greatest(F.size(n) - i, F.lit(0)))) - 1 <= _LIST_BYTES))


def _plain_names(hosts: Column) -> Column:
    return F.transform(hosts, lambda h: F.regexp_replace(F.lower(h), r"\.+$", ""))


def _appended(url: Column, tail: Column) -> Column:
    return merge_tried(F.concat(url, F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), tail), reason=True)


def with_tried(url: Column, hosts: Column) -> Column:
    """A URL whose list names the given hosts behind its own; the URL itself if they add nothing."""
    add = lambda more: F.when(F.size(more) == 0, url).otherwise(_appended(url, F.concat(F.lit("tried="), F.array_join(more, ","))))
    return _let(_added(tried_hosts(url), _plain_names(hosts), _AVOIDED_MOST), add)


def with_exclusions(url: Column, hosts: Column, reason: Column) -> Column:
    """A URL whose list also names hosts that failed, with the reason 'enoent' or else 'ioerr'; addresses and short names are left out."""
    named = F.filter(_plain_names(hosts), lambda h: h.contains(".") & ~h.contains(":") & ~h.startswith("[") & ~h.rlike(r"^[0-9.]*$"))
    tail = F.concat(F.lit("triedrc="), F.when(reason == "enoent", F.lit("enoent")).otherwise(F.lit("ioerr")))

    def add(c: Column) -> Column:
        both = F.when(F.size(c["more"]) == 0, tail).otherwise(F.concat(F.lit("tried="), F.array_join(c["more"], ","), F.lit("&"), tail))
        return F.when((F.size(c["theirs"]) == 0) & (F.size(c["more"]) == 0), url).otherwise(_appended(url, both))

    return _let(tried_hosts(url), lambda t: _let(F.struct(t.alias("theirs"), _added(t, named, _OURS_MOST).alias("more")), add))


# The most host patterns, and the longest one in bytes.
_PATTERNS_MOST, _PATTERN_BYTES = 32, 253


def host_pattern_fault(pattern: Column) -> Column:
    """Why a text is no host pattern, or null: host characters with at least one '*', and no port."""
    body = F.when(pattern.rlike(r"^\[[\s\S]*\]$"), F.substring(pattern, 2, F.length(pattern) - 2)).otherwise(pattern)
    return (
        F.when(pattern == "", "empty").when(F.octet_length(pattern) > _PATTERN_BYTES, "too long").when(~body.contains("*"), "no star")
        .when(~body.rlike(r"^[A-Za-z0-9._:*-]*\z"), "no host character").when(body.rlike(r"^[^:]*:[0-9]+\z"), "a port")
    )


def split_tried_patterns(url: Column) -> Column:
    """(url, patterns, malformed): the items with a '*' taken out of ``tried`` lists, each once; no more than 32 patterns count."""

    def taken(rows: Column) -> Column:
        starred = lambda r: (r["k"] == "tried") & r["v"].contains("*")
        items = _first_of_each(F.flatten(F.transform(F.filter(rows, starred), lambda r: F.filter(F.split(r["v"], ",", -1), lambda h: h.contains("*")))))
        rest = lambda r: F.array_join(F.filter(F.split(r["v"], ",", -1), lambda h: (h != "") & ~h.contains("*")), ",")
        left = F.filter(F.transform(rows, lambda r: F.when(~starred(r), r["p"]).when(rest(r) != "", F.concat(F.lit("tried="), rest(r)))), lambda p: p.isNotNull())
        return _let(F.struct(items.alias("items"), left.alias("left"), F.exists(rows, starred).alias("changed")), parted)

    def parted(c: Column) -> Column:
        good = F.filter(c["items"], lambda h: host_pattern_fault(h).isNull())
        return _let(F.slice(good, 1, _PATTERNS_MOST), lambda g: F.struct(F.when(c["changed"], _with_base(url, c["left"])).otherwise(url).alias("url"), g.alias("patterns"), F.filter(c["items"], lambda h: ~F.array_contains(g, h)).alias("malformed")))

    return _let(_parameters(url), taken)


def url_at_server(url: Column, server: Column, keep_tried: bool = False) -> Column:
    """A URL with another host:port; the user stays, lists of tried hosts go unless kept."""
    u = url if keep_tried else F.when(url.contains("?"), strip_parameters(url, ["tried", "triedrc"])).otherwise(url)
    return F.when(u.contains("://"), F.regexp_replace(u, r"^([\s\S]*?://(?:[^/?@]*@)?)[^/?]*", F.concat(F.lit("$1"), server))).otherwise(u)


def glob_matches(host: Column, pattern: str, brackets: bool = True) -> Column:
    """Case-folded glob; ``brackets`` tells the full dialect (*, ?, []) from the one that knows * alone."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if brackets and c == "[" else -1
        if c == "*":
            out += ".*"
        elif brackets and c == "?":
            out += "."
        elif close > 0:
            inside = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = close
        else:
            out += c if c.isalnum() else "\\" + c
        i += 1
    name = F.lower(host) if brackets else F.regexp_replace(F.regexp_replace(F.lower(host), r"[\[\]]", ""), r"\.$", "")
    return name.rlike(f"^(?:{out.lower() if not brackets else out.lower()})$")


def host_allowed(host: Column, allow: list[str], deny: list[str]) -> Column:
    """Denied hosts never; with no allow list all others."""
    any_of = lambda xs: F.array_max(F.array(*(glob_matches(host, p) for p in xs)))
    allowed = any_of(allow) if allow else F.lit(True)
    return allowed & ~any_of(deny) if deny else allowed


def encode_site(name: Column) -> Column:
    """Spaces, percent signs and what does not print as %XX; an empty name is '-'."""
    chars = F.filter(F.split(F.hex(name.cast("binary")), "(?<=\\G..)"), lambda h: h != "")
    plain = lambda h: (h >= "21") & (h <= "7E") & (h != "25")
    out = F.array_join(F.transform(chars, lambda h: F.when(plain(h), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("%"), h))), "")
    return F.when(name == "", F.lit("-")).when(name == "-", F.lit("%2D")).otherwise(out)


def decode_site(text: Column) -> Column:
    """Back from ``encode_site``."""
    pieces = F.filter(F.split(F.regexp_replace(text, "(%[0-9A-Fa-f]{2})", "\u0000$1\u0000"), "\u0000"), lambda p: p != "")
    raw = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(p.cast("binary")))), "")
    return F.when(text == "-", F.lit("")).otherwise(F.decode(F.unhex(raw), "UTF-8"))


LABEL_MOST = 80


def valid_label(text: Column) -> Column:
    """Why a label cannot be used, or null; white space around it does not count, and no label is fine."""
    label = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(label.startswith("-"), F.lit("starts like a flag")).when(label.rlike(r"[/\\@~]"), F.lit("a location or an address")).when(F.octet_length(label) > LABEL_MOST, F.lit("too long"))


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\z")


def parse_identity(text: Column, prefix: str) -> Column:
    """(owner, salt) of ``<prefix><uuid>:<32 hex digits>`` with white space around it, or null."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    owner, salt = F.substring_index(F.substring(bare, len(prefix) + 1, 36), ":", 1), F.substring(bare, len(prefix) + 38, 1 << 20)
    good = bare.startswith(prefix) & is_uuid(owner) & (F.substring(bare, len(prefix) + 37, 1) == ":") & salt.rlike(r"^[0-9a-f]{32}\z")
    return F.when(good, F.struct(owner.alias("owner"), salt.alias("salt")))


# The most prefixes of logical names, and the longest one in bytes.
_PREFIXES_MOST, _PREFIX_BYTES = 32, 256


def name_prefixes_fault(value: Column) -> Column:
    """Why a list of prefixes cannot be used, or null; 'off' and no list are fine.  The first fault counts."""
    each = F.filter(F.split(value, r"[ \t]+"), lambda p: p != "")

    def fault(p: Column) -> Column:
        return (
            F.when(F.octet_length(p) > _PREFIX_BYTES, "too long").when((F.length(p) < 3) | ~p.startswith("/") | ~p.endswith("/"), "no name between slashes")
            .when(~p.rlike(r"^[\x21-\x7e]*\z"), "not printable").when(p.contains("//") | p.contains("/./") | p.contains("/../"), "no path component")
        )

    first = F.try_element_at(F.filter(F.transform(each, fault), lambda f: f.isNotNull()), F.lit(1))
    return F.when(value.rlike(r"^[ \t]*\z") | (value == "off"), None).when(F.size(each) > _PREFIXES_MOST, "too many").otherwise(first)


# The longest name of a site, and the name that answers give for none.
_SITE_MOST, _NO_SITE = 64, "sitename"


def site_name_of_answer(answer: Column) -> Column:
    """The first line of an answer without blanks around it, if it can be a site's name: printable, short and set; else ''."""
    name = F.regexp_replace(F.regexp_extract(answer, r"^([^\n\x00]*)", 1), r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(name.rlike(rf"^[\x21-\x7e]{{1,{_SITE_MOST}}}\z") & (name != _NO_SITE), name).otherwise("")
