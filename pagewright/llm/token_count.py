"""Token counts: heap-and-linked-list byte-pair merging, without identifiers.

A stretch of text starts as one symbol per byte. A heap holds every adjacent pair that may merge, by rank and place;
the lowest is popped, its two symbols become one in a linked list, and the pairs that the new symbol forms with its
neighbours are pushed. Entries that no longer match the list are skipped. The number of tokens is the number of
symbols at the start less the number of merges, so no token is ever looked up.

Null and empty texts have 0 tokens. Repeated rows are counted each. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import pretokens

#: Counts of stretches that a Python worker keeps; the store is emptied when full, which costs time only.
KEPT = 1_000_000
#: Longer stretches are counted anew each time, so that the store stays small.
KEPT_CHARS = 40

_kept: dict[str, dict[str, int]] = {}


def merges(word: bytes, pairs: dict[int, int]) -> int:
    """How many pairs of ``word`` merge. ``pairs`` as ``pretokens.merge_ranks`` gives them."""
    size, look, bits = len(word), pairs.get, pretokens.BITS
    symbol, mask = list(word), (1 << bits) - 1
    # the merge that the pair from each place on allows, -1 for none; what the heap holds counts only while it agrees
    allowed = [look(a << bits | b, -1) for a, b in zip(word, word[1:], strict=False)]
    heap = [(merge >> bits) * size + i for i, merge in enumerate(allowed) if merge >= 0]
    allowed.append(-1)
    heapify(heap)
    following, preceding, done = list(range(1, size + 1)), list(range(-1, size - 1)), 0
    while heap:
        rank, i = divmod(heappop(heap), size)
        merge = allowed[i]
        if merge < 0 or merge >> bits != rank:
            continue
        done += 1
        new = symbol[i] = merge & mask
        j = following[i]
        allowed[j] = allowed[i] = -1
        k = following[i] = following[j]
        if k < size:
            preceding[k] = i
            merge = allowed[i] = look(new << bits | symbol[k], -1)
            if merge >= 0:
                heappush(heap, (merge >> bits) * size + i)
        h = preceding[i]
        if h >= 0:
            merge = allowed[h] = look(symbol[h] << bits | new, -1)
            if merge >= 0:
                heappush(heap, (merge >> bits) * size + h)
    return done


def count(text: str | None, path: str, pattern: str) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    pairs, special = pretokens.merge_ranks(path)
    kept, total = _kept.setdefault(path, {}), 0
    parts = re.split("|".join(map(re.escape, special)), text) if special else [text]
    for part in parts:
        for block in pretokens.pieces(part, pattern):
            for word, n in Counter(block).items():
                size = kept.get(word)
                if size is None:
                    raw = word.encode()
                    size = len(raw) - merges(raw, pairs)
                    if len(word) <= KEPT_CHARS:
                        if len(kept) >= KEPT:
                            kept.clear()
                        kept[word] = size
                total += n * size
    return total + len(parts) - 1


def n_tokens(text: Column, path: str, pattern: str) -> Column:
    """Tokens of a text column, by the merges of the JSON file at ``path``; special strings count one each."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((count(t.as_py(), path, pattern) for t in texts), pa.int64(), size=len(texts))

    return counted(text)


def token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``), in place of columns so named."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumn("n_tokens", n_tokens(whole, path, pattern))
    return counted.withColumns({"n_bytes": F.octet_length(whole).cast("bigint"), "over_limit": F.col("n_tokens") > limit})
