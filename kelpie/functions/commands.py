"""Command lines made fit to share: places become marks, log options go."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A quoted run (closed or not), an escaped character, or plain characters; white space ends a token.
PIECE = re.compile(r"""'([^']*)(?:'|$)|"((?:\\[\s\S]|[^"\\])*\\?)(?:"|$)|\\([\s\S])|([^\s'"\\]+|\\$)|(\s+)""")


def tokens(command: str) -> list[str]:
    """Words of a command line; quotes group, a backslash takes the next character as it is."""
    out: list[str] = []
    open_ = False
    for single, double, escaped, plain, space in (m.groups() for m in PIECE.finditer(command)):
        if space is not None:
            open_ = False
            continue
        part = next(x for x in (single, re.sub(r"\\([\s\S])", r"\1", double) if double is not None else None, escaped, plain) if x is not None)
        if open_:
            out[-1] += part
        else:
            out.append(part)
        open_ = True
    return out


def _shared(token: str) -> str:
    place = lambda s: "/" in s or s.startswith("~")
    name, sign, value = token.partition("=")
    if sign and token.startswith("-"):
        return f"{name}=<path>" if place(value) else token
    return "<path>" if place(token) else token


def normalize(command: str, own: str) -> str:
    """The program by name if it is one of ours, else <exe>; options as they are, places as <path>, without --log."""
    words = tokens(command)
    if not words:
        return ""
    kept = [own if words[0].rpartition("/")[2].startswith(own) else "<exe>"]
    rest = iter(words[1:])
    for word in rest:
        if word == "--log":
            next(rest, None)
        elif not word.startswith("--log="):
            kept.append(_shared(word))
    return " ".join(kept)


def normalized_command(column: Column, own: str) -> Column:
    """``normalize`` over a column, in Arrow batches; nulls stay."""

    @F.pandas_udf(StringType())
    def run(commands: pd.Series) -> pd.Series:
        return commands.map(lambda c: normalize(c, own), na_action="ignore")

    return run(column)
