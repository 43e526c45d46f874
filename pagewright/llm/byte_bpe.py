"""Byte-level BPE encoding and decoding: corpus-level merge replay.

The distinct stretches of a batch of texts stand in one flat array of tokens. An inverted index leads from each
mergeable pair (named by the rank of the token it makes) to the places where it stands. The merges are replayed in rank
order over all stretches at once; a merge touches only the pairs its two neighbours form, whose places join the index.
Where a merge makes a pair of lower rank than the one in hand, that pair goes first, so every stretch merges as it
would alone. Texts are then joined from the stretches' ids. A batch is what Spark hands to a task at a time; ids of
short stretches are kept from batch to batch up to a bound, so most stretches are replayed once per task.

Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded each. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import pretokens
from pagewright.llm.common import release

#: Stretches a task keeps the ids of, and the longest kept; the store is emptied when full, which costs time only.
KEPT = 200_000
KEPT_CHARS = 40
#: Characters of new stretches replayed at once; a place takes about 200 bytes while it is in hand.
REPLAY_CHARS = 1 << 18

@lru_cache(1)
def _vocabulary(path: str):
    """Ranks, token bytes by id, ids of single bytes, and the rank of each pair of bytes (-1: none)."""
    ranks = pretokens.byte_ranks(path)
    spelled = [b""] * (max(ranks.values(), default=-1) + 1)
    pairs = np.full(1 << 16, -1, np.int64)
    for token, rank in ranks.items():
        spelled[rank] = token
        if len(token) == 2:
            pairs[token[0] << 8 | token[1]] = rank
    return ranks, spelled, np.array([ranks[bytes([b])] for b in range(256)]), pairs


def replay(words: list[bytes], path: str) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers. No word is empty."""
    ranks, spelled, single, byte_pairs = _vocabulary(path)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.cumsum([len(word) for word in words])
    starts, size = np.concatenate([[0], ends[:-1]]), len(flat)
    pair = np.full(size, -1)
    pair[:-1] = byte_pairs[flat[:-1] << 8 | flat[1:]]
    pair[ends - 1] = -1                            # words end here: no pair reaches into the next
    order = np.argsort(pair, kind="stable")
    order = order[np.searchsorted(pair[order], 0):]
    values, cuts = np.unique(pair[order], return_index=True)
    index = {v: part.tolist() for v, part in zip(values.tolist(), np.split(order, cuts[1:]), strict=False)} if len(order) else {}
    following, preceding = np.arange(1, size + 1), np.arange(-1, size - 1)
    following[ends - 1], preceding[starts] = size, -1
    # what a place holds, the pair from it on, and its neighbours; the index counts only while ``pair`` agrees with it
    token, pair, following, preceding = single[flat].tolist(), pair.tolist(), following.tolist(), preceding.tolist()

    waiting, known = list(index), {}
    heapify(waiting)
    while waiting:
        rank = heappop(waiting)
        places = index.pop(rank)
        places.sort()
        for n, i in enumerate(places):
            if pair[i] != rank:
                continue
            j = following[i]
            k = following[i] = following[j]
            token[i], lower = rank, False
            pair[i] = pair[j] = -1
            h = preceding[i]
            touched = []
            if k < size:
                preceding[k] = i
                touched.append((i, rank, token[k]))
            if h >= 0:
                touched.append((h, token[h], rank))
            for place, left, right in touched:
                key = left << 32 | right
                new = known.get(key)
                if new is None:
                    new = known[key] = ranks.get(spelled[left] + spelled[right], -1)
                pair[place] = new
                if new >= 0:
                    if new in index:
                        index[new].append(place)
                    else:
                        index[new] = [place]
                        heappush(waiting, new)
                    lower |= new < rank
            if lower:
                if rest := places[n + 1:]:
                    if rank in index:
                        index[rank] += rest
                    else:
                        index[rank] = rest
                        heappush(waiting, rank)
                break
    out = []
    for i in starts.tolist():
        ids = []
        while i < size:
            ids.append(token[i])
            i = following[i]
        out.append(ids)
    lengths = list(map(len, out))
    packed, at = np.fromiter(chain.from_iterable(out), "<u4", sum(lengths)).tobytes(), 0
    for n, length in enumerate(lengths):
        out[n] = packed[at:at + 4 * length]
        at += 4 * length
    return out


def _learn(new: list[str], kept: dict[str, bytes], path: str) -> None:
    batch: list[str] = []
    size = 0
    for word in new:
        batch.append(word)
        size += len(word)
        if size >= REPLAY_CHARS:
            kept.update(zip(batch, replay([w.encode() for w in batch], path), strict=True))
            batch, size = [], 0
    if batch:
        kept.update(zip(batch, replay([w.encode() for w in batch], path), strict=True))


def encode_texts(texts: list[str], path: str, pattern: str, kept: dict[str, bytes] | None = None) -> list[bytes]:
    """The ids of each text, packed; one replay for what is new in all of them. ``kept`` holds ids from call to call."""
    kept = {} if kept is None else kept
    cut = [list(chain.from_iterable(pretokens.pieces(text, pattern))) for text in texts]
    new = list(set().union(*cut) - kept.keys())
    _learn(new, kept, path)
    out = [b"".join(map(kept.__getitem__, words)) for words in cut]
    for word in new:
        if len(word) > KEPT_CHARS:
            del kept[word]
    if len(kept) > KEPT:
        kept.clear()
    return out


def decode_ids(packed: bytes, path: str) -> bytes:
    """The bytes that packed ids stand for."""
    spelled = _vocabulary(path)[1]
    return b"".join(map(spelled.__getitem__, np.frombuffer(packed, "<u4").tolist()))


#: Characters of text taken at a time from a batch.
STEP_CHARS = 1 << 21


def _steps(texts: list[str]) -> Iterator[list[str]]:
    step: list[str] = []
    size = 0
    for text in texts:
        step.append(text)
        size += len(text)
        if size >= STEP_CHARS:
            yield step
            step, size = [], 0
    yield step


def encode(text: Column, path: str, pattern: str) -> Column:
    """Binary column: the ids as little-endian unsigned 32-bit integers, by the ranks at ``path``, each match of
    ``pattern`` by itself, without special tokens."""

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[str, bytes] = {}
        for texts in batches:
            held = [t or "" for t in texts.to_pylist()]
            yield pa.array((x for step in _steps(held) for x in encode_texts(step, path, pattern, kept)), pa.binary(), size=len(held))
        kept.clear()
        release()

    return encoded(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Binary column: the bytes of packed ids; null ids decode to none."""

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for packed in batches:
            yield pa.array((decode_ids(p.as_py() or b"", path) for p in packed), pa.binary(), size=len(packed))

    return decoded(ids)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ids (packed), n_tokens and decoded (bytes), in place of columns so named. Both ways are taken in one
    Python worker a task, so the vocabulary and the ids stand in memory once."""
    both = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[str, bytes] = {}
        for texts in batches:
            parts = []
            for step in _steps([t or "" for t in texts.to_pylist()]):
                ids = encode_texts(step, path, pattern, kept)
                back = [decode_ids(x, path) for x in ids]
                parts.append(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(back, pa.binary())], fields=list(both)))
            yield pa.concat_arrays(parts)
        kept.clear()
        release()

    found = df.withColumn("_both", there_and_back(F.coalesce(F.col(text), F.lit(""))))
    return found.withColumns({"ids": F.col("_both.ids"), "decoded": F.col("_both.decoded")}).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("bigint")).drop("_both")
