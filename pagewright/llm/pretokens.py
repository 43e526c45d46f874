"""Cutting text into the stretches inside which byte pairs merge, and the files that hold the merges."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import regex

#: White space as the tokenizer libraries know it (the Unicode property); the regex module's ``\s`` has four more.
WHITE = r"\t-\r\x20\x85\xa0  -     　"

#: Texts above this many characters are cut lazily, so that their pieces never stand in memory at once.
LAZY_CHARS = 1 << 20
LAZY_PIECES = 1 << 16


def spelled(pattern: str) -> str:
    """``pattern`` with ``\\s`` and ``\\S`` written out, inside and outside of classes."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE}")
    return pattern.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


@lru_cache(8)
def cutter(pattern: str):
    return regex.compile(spelled(pattern))


def pieces(text: str, pattern: str) -> Iterator[list[str]]:
    """The matches of ``pattern`` in order, in lists: one for a text of usual length, several for a very long one."""
    cut = cutter(pattern)
    if len(text) <= LAZY_CHARS:
        yield cut.findall(text)
        return
    block: list[str] = []
    for match in cut.finditer(text):
        block.append(match[0])
        if len(block) == LAZY_PIECES:
            yield block
            block = []
    yield block


@lru_cache(4)
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable in
    Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Bits of a symbol's handle in a packed pair.
BITS = 20


@lru_cache(2)
def merge_ranks(path: str) -> tuple[dict[int, int], list[str]]:
    """Of a tokenizer's JSON file: the merges, and the added special strings.

    Symbols go by handles: a byte by its value, a joined symbol by 256 plus the rank of the first merge that makes it.
    A merge is ``{left << BITS | right: rank << BITS | joined}``.
    """
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    handle = {letter: byte for byte, letter in byte_letters().items()}
    pairs = {}
    for rank, merge in enumerate(held["model"]["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        joined = handle.setdefault(a + b, 256 + rank)
        pairs[handle[a] << BITS | handle[b]] = rank << BITS | joined
    return pairs, [t["content"] for t in held["added_tokens"]]


@lru_cache(2)
def byte_ranks(path: str) -> dict[bytes, int]:
    """Of a rank file: ``{token bytes: rank}``; the rank is the id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
