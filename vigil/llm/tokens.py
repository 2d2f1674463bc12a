"""Token ids of a byte-level BPE file (the JSON form of ``tokenizers``).

The file's vocabulary is loaded into a ``tiktoken`` encoder, which gives the same ids for byte-level
BPE and needs about a quarter of the time; the tests hold the two against each other.  ``text_ids`` reads
added tokens in a text as their ids, as the file's tokenizer does; ``token_ids`` takes them for ordinary text.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
import tiktoken

#: Fixed value: the splitting rule of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space as the rule has it.  The rule backtracks over a run of it with a stack of fixed size, so longer
#: runs than LONG_RUN are cut out first.
_SPACE = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 100_000


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself, or one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """The file's encoder, loaded once per process."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
    symbols, special = _byte_of_symbol(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(symbols[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _piece_encoder(vocabulary: str) -> tiktoken.Encoding:
    """The same ranks, a text being one piece."""
    return tiktoken.Encoding(f"{vocabulary} piece", pat_str=r"(?s:.+)", mergeable_ranks=encoder(vocabulary)._mergeable_ranks, special_tokens={})


def _ordinary(vocabulary: str, text: str) -> list[int]:
    encode, ids, at = encoder(vocabulary).encode_ordinary, [], 0
    if len(text) > LONG_RUN:
        for m in _SPACE.finditer(text):
            if m.end() - m.start() > LONG_RUN:
                end = m.end() - (m.end() < len(text))  # the last one goes with what follows
                ids += encode(text[at:m.start()])
                ids += _piece_encoder(vocabulary).encode_ordinary(text[m.start():end])
                at = end
    return ids + encode(text[at:]) if at else encode(text)


def token_ids(vocabulary: str, text: str) -> np.ndarray:
    """The ids of one text as unsigned 32-bit values."""
    return np.frombuffer(array("I", _ordinary(vocabulary, text)), dtype=np.uint32)


@cache
def _added(vocabulary: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The file's added tokens, as a pattern that captures them and by id."""
    with open(vocabulary, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that match as they are written are needed")
    ids = {t["content"]: t["id"] for t in added}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None, ids


def text_ids(vocabulary: str, text: str) -> np.ndarray:
    """``token_ids`` of what stands between the added tokens of one text, and the ids of those."""
    pattern, ids = _added(vocabulary)
    parts = pattern.split(text) if pattern else [text]
    if len(parts) == 1:
        return token_ids(vocabulary, text)
    return np.concatenate([np.array([ids[x]], dtype=np.uint32) if i % 2 else token_ids(vocabulary, x) for i, x in enumerate(parts)])
