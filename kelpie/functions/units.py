"""Sizes, durations, ages and rates as text and numbers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of sizes and times, and the largest unsigned number.
_SIZE = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_TIME = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_BINARY = ("B", "KiB", "MiB", "GiB", "TiB")
_DECIMAL = ("kB", "MB", "GB", "TB", "PB")
_MOST, _MOST_INT = (1 << 64) - 1, (1 << 31) - 1


def _scaled(text: Column, units: dict[str, int], bare: bool, most: int) -> Column:
    """Whole numbers with at most one suffix and nothing before or after; null for all else, and beyond ``most``."""
    pattern = rf"^([0-9]+)([{''.join(units)}]{'?' if bare else ''})$"
    number = F.ltrim(F.regexp_extract(text, pattern, 1), F.lit("0"))
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.lit(1)
    for name, size in units.items():
        factor = F.when(unit == name, F.lit(size)).otherwise(factor)
    # Products of up to 20 and 13 digits; longer numbers are too large in any unit.
    value = F.when(number == "", F.lit(0)).when(F.length(number) <= 20, number.try_cast("decimal(20,0)")).cast("decimal(20,0)") * factor.cast("decimal(14,0)")
    return F.when(text.rlike(pattern) & (value <= F.lit(str(most)).cast("decimal(20,0)")), value.cast("decimal(20,0)"))


def parse_size(text: Column) -> Column:
    """Bytes of '10', '10k' or '2T' as a decimal, since they may be any unsigned 64-bit number; what is no size gives null."""
    return _scaled(text, _SIZE | {k.upper(): v for k, v in _SIZE.items()}, True, _MOST)


def parse_duration(text: Column, bare: bool = True) -> Column:
    """Seconds of '30', '10m', '2h', '7d', '1w' as a decimal; what is no duration gives null.

    With ``bare`` false, as settings are read, a unit is required except for '0', and the result must fit an int.
    """
    if bare:
        return _scaled(text, _TIME, True, _MOST)
    return F.when(text == "0", F.lit(0).cast("decimal(20,0)")).otherwise(_scaled(text, _TIME, False, _MOST_INT))


def format_duration(seconds: Column) -> Column:
    """Seconds as a setting: the largest of days, hours and minutes that divides them, else seconds; '0' for none."""
    s = seconds.cast("long")
    out = F.concat(s.cast("string"), F.lit("s"))
    for unit in ("m", "h", "d"):
        out = F.when(s % _TIME[unit] == 0, F.concat(F.floor(s / _TIME[unit]).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return F.when(s == 0, F.lit("0")).otherwise(out)


def _one_decimal(value: Column) -> Column:
    """A number with one decimal: the nearest, and of an exact tie the even one, which ``format_string`` does not keep to."""
    # Bound by a lambda, as the value is used many times and would be computed anew, and its code grow, with each.
    return F.transform(F.array(value), _rounded)[0]


def _rounded(value: Column) -> Column:
    whole, tenths = F.floor(value).cast("long"), F.lit(0).cast("long")
    for odd in range(1, 20, 2):
        mark, exact = odd / 20, Decimal(odd) / 20
        # A mark that a double cannot hold lies beside the double next to it; one that it holds is a tie.
        reached = Decimal(mark) > exact or (Decimal(mark) == exact and odd // 2 % 2 == 1)
        above = (value - F.floor(value)) >= mark if reached else (value - F.floor(value)) > mark
        tenths = tenths + above.cast("long")
    every = whole * 10 + tenths
    return F.concat(F.floor(every / 10).cast("long").cast("string"), F.lit("."), (every % 10).cast("string"))


def human_size(value: Column, last: str = _BINARY[-1]) -> Column:
    """Text of a size with one decimal in binary units, up to ``last``."""
    v = value.cast("double")
    names = _BINARY[1 : _BINARY.index(last) + 1]
    # The unit first, so that a number is put into words only once.
    scaled, unit = v / 1024.0 ** len(names), F.lit(names[-1])
    for i in range(len(names) - 1, 0, -1):
        scaled, unit = F.when(v < 1024.0 ** (i + 1), v / 1024.0**i).otherwise(scaled), F.when(v < 1024.0 ** (i + 1), names[i - 1]).otherwise(unit)
    return F.when(v < 1024.0, F.concat(value.cast("long").cast("string"), F.lit(f" {_BINARY[0]}"))).otherwise(F.concat(_one_decimal(scaled), F.lit(" "), unit))


def bytes_text(value: Column, last: str = _DECIMAL[-1]) -> Column:
    """A count of bytes in words below 1000, else in decimal units up to ``last``; a number that would read 1000.0 takes the next unit."""
    n = value.cast("long")
    scaled = unit = None
    for i in range(_DECIMAL.index(last), -1, -1):
        # Divided step by step, as the rounding of one division differs.
        v = n.cast("double") / 1000.0
        for _ in range(i):
            v = v / 1000.0
        here = F.lit(_DECIMAL[i])
        scaled, unit = (v, here) if scaled is None else (F.when(v < 999.95, v).otherwise(scaled), F.when(v < 999.95, here).otherwise(unit))
    return F.when(n == 1, "1 byte").when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).otherwise(F.concat(_one_decimal(scaled), F.lit(" "), unit))


def _tiered(seconds: Column, below: dict[str, int], last: str) -> Column:
    out = F.concat(F.floor(seconds / _TIME[last]).cast("long").cast("string"), F.lit(last))
    for unit, limit in reversed(below.items()):
        out = F.when(seconds < limit, F.concat(F.floor(seconds / _TIME[unit]).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def human_age(at: Column, now: Column) -> Column:
    """'8s', '12m', '5h', '3d' or '2w' since a time, none if it lies ahead; '-' for a time of 0."""
    return F.when(at == 0, "-").otherwise(_tiered(F.greatest(now - at, F.lit(0)), {"s": 60, "m": 3600, "h": 86400, "d": 7 * 86400}, "w"))


def ago_text(now: Column, at: Column) -> Column:
    """As ``human_age``, but each unit is kept up to two of the next one, days are the last, and a time ahead gives '-'."""
    return F.when((at == 0) | (at > now), "-").otherwise(_tiered(now - at, {"s": 120, "m": 7200, "h": 172800}, "d"))


def human_duration(seconds: Column) -> Column:
    """'42s', '3m07s', '2h05m', '4d3h'."""
    s = seconds.cast("long")
    part = lambda a, b: F.floor(s / a).cast("long") if b is None else F.floor((s % a) / b).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", part(60, None), s % 60))
        .when(s < 86400, F.format_string("%dh%02dm", part(3600, None), part(3600, 60))).otherwise(F.format_string("%dd%dh", part(86400, None), part(86400, 3600)))
    )


def rate_mb(value: Column, seconds: Column) -> Column:
    """Decimal megabytes a second; 0 where no time passed."""
    return F.when(seconds > 0, value / seconds / 1e6).otherwise(F.lit(0.0))


def page_bytes(count: Column, bits: Column) -> Column:
    """Bytes of ``count`` elements of ``bits`` bits, rounded up."""
    return F.floor((count * bits + 7) / 8).cast("long")


def suggested_days(seconds: Column) -> Column:
    """Seconds rounded up to whole days."""
    return (F.ceil(seconds / 86400) * 86400).cast("long")


def date_utc(epoch: Column) -> Column:
    """YYYY-MM-DD of an epoch second, whatever the session's zone: days are counted from the epoch."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int")), "yyyy-MM-dd")
