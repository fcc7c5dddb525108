"""Byte-level BPE ids of a public vocabulary.

The ids are those of the ``tokenizers`` library for the same vocabulary.  A second library that reads the vocabulary
as merge ranks gives equal ids several times faster (the tests compare them); a text that holds the vocabulary's
special token is left to ``tokenizers`` itself, which treats it as one id.
"""

from __future__ import annotations

import base64
import os

import numpy as np

SPECIAL = "<|endoftext|>"
#: The vocabulary's split pattern, written so that the engine need not step back into runs it has read.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_kept: dict[str, object] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; an environment without them gives the path itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def exact(path: str):
    """The ``tokenizers`` tokenizer of a JSON file."""
    if path not in _kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _kept[path] = Tokenizer.from_file(path)
    return _kept[path]


def ranked(path: str):
    """An encoder over the merge ranks of a ``.tiktoken`` file."""
    if path not in _kept:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _kept[path] = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _kept[path]


def encode(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit values, without special tokens added."""
    if SPECIAL in text:
        return np.array(exact(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.asarray(ranked(ranks_path).encode_to_numpy(text, allowed_special=set(), disallowed_special=()), dtype="<u4")
