"""Phrase collocations: sorted count streams in prefix and suffix order, merged in lockstep.

Every word of a text starts a window of up to ``LONGEST`` words, as far as its piece reaches. Windows are the only thing
counted: each task sorts and counts those of a bounded run of text, the runs are dealt to ranges of the prefix order, and
one pass over a sorted range sums equal prefixes of every length, so the counts of all shorter phrases (and of all words of a
language, the empty prefix) fall out of the one stream. Only prefixes that may reach the least count leave it.

Frequent phrases are then streamed twice, in prefix order and in suffix order (words reversed). In either order all parts that a
phrase starts with stand before it, and the part without its last word is the one it extends. A stack of open parts is
all the merge needs: it gives each phrase the counts of its first parts (in suffix order: of its last parts), and tells
the part that it extends whether it is as frequent. Frequencies fall along extensions, so a phrase that lies in a longer
one that is frequent enough is also extended by one word to one that is; asking one-word extensions asks all. A part whose
extensions reach into further ranges is handed to each of them.

Ranges are bounded by keys drawn from a sample; this decides how even they are and nothing else. A frequent window is one row
for each run of text that holds it; a phrase with a third of all windows is a few rows of every run, cut into several ranges by the words that follow.

Null and empty texts have no words. Languages are labels as they are, null counts as ``und``. Rows count as often as they
stand, equal ones too; ids are not looked at, nor is any other column. Words and pieces of any length count whole. A language without
a frequent phrase gives no rows; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import releasing, written

LONGEST = 5
LEAST = 100
#: A phrase goes if a longer one that holds it has this share of its count, in hundredths.
SHARE = 100
BEST = 2000
UNKNOWN = "und"
#: Bytes of text whose windows a task sorts at a time.
RUN_BYTES = 2 << 20
#: Characters of text for a range, frequent phrases for a range, and ranges at most; keys drawn for a range.
RANGE_CHARS, RANGE_PHRASES, RANGES, DRAWN = 2_000_000, 20_000, 1 << 16, 16

#: All ends of pieces become one, both kinds of gap another.
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n" * 10 + b" ")
_MORE = re.compile(rb" *(?:[^ \n]+ *){0,%d}" % (LONGEST - 1))
_GAP = re.compile(rb"[ \n]")


def _key(word: bytes) -> bytes:
    """A word in a form whose bytes sort like it and hold no zero, which ends each word of a window."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x01" in word or b"\x00" in word else word


def _word(key: bytes) -> bytes:
    return key.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01")


def _slices(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(text, what follows it as far as its windows reach), cut between words."""
    text, start = text.lower().translate(_ENDS), 0   # of bytes: A-Z only
    while len(text) - start > RUN_BYTES:
        gap = _GAP.search(text, start + RUN_BYTES)
        if not gap:
            break
        yield text[start:gap.start()], _MORE.match(text, gap.start()).group()
        start = gap.start()
    yield text[start:], b""


class _Places(dict):
    """Word numbers, dealt as words appear; 0 ends a piece, -1 is no word."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) - 1
        return place


def _windows(slices: list[tuple[bytes, bytes]], lang: str) -> tuple[pa.Array, np.ndarray]:
    """(keys of the distinct windows in order, their counts) of one language's texts."""
    places, parts, starts = _Places(), [], []
    for text, more in slices:
        for part, counts in ((text, True), (more + b"\n", False)):
            tokens = part.replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
            numbers = numbers[numbers >= 0]
            parts.append(numbers)
            starts.append(np.full(len(numbers), counts))
    words = [w for w in places if places[w] > 0]
    keys = [_key(w) for w in words]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    rank = np.zeros(len(keys) + 1, np.int64)      # numbers that sort like the words
    rank[np.array(order, np.int64) + 1] = np.arange(1, len(keys) + 1)
    ids = rank[np.concatenate(parts)]
    at = np.flatnonzero((ids > 0) & np.concatenate(starts))
    ids = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
    columns = [ids[at]]
    for i in range(1, LONGEST):
        columns.append(np.where(columns[-1] > 0, ids[at + i], 0))
    sorted_ = np.lexsort(columns[::-1])
    columns = [c[sorted_] for c in columns]
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(at)))
    held = pa.array([None, *(keys[i] for i in order)], pa.large_binary())
    taken = [held.take(pa.array(c[first])) for c in columns]
    size, zero = len(first), pa.scalar(b"\0", pa.large_binary())
    head = pa.repeat(pa.scalar(_key(lang.encode()), pa.large_binary()), size)
    end = pa.repeat(pa.scalar(b"", pa.large_binary()), size)
    return pc.binary_join_element_wise(head, *taken, end, zero, null_handling="skip"), counts


def _runs_of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Sorted runs of windows, each of about ``RUN_BYTES`` of text, a language at a time."""
    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            for piece in _slices(text.as_py() or b""):
                held.setdefault(lang, []).append(piece)
                size += len(piece[0])
                if size >= RUN_BYTES:
                    for one, slices in held.items():
                        yield _windows(slices, one)
                    held, size = {}, 0
    for one, slices in held.items():
        yield _windows(slices, one)


def _ranged(keys: pa.Array, bounds: list[bytes]) -> np.ndarray:
    """The range of each of sorted keys: how many bounds are not above it."""
    ends = [bisect_left(keys, bound, key=lambda key: key.as_py()) for bound in bounds]
    return np.searchsorted(np.array(ends, np.int64), np.arange(len(keys)), "right").astype(np.int32)


def _bounds(drawn: list[bytes], ranges: int) -> list[bytes]:
    """Keys that cut the drawn ones into about equal ranges."""
    drawn = sorted(drawn)
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def _text_bounds(texts: DataFrame) -> list[bytes]:
    """Bounds for the ranges of all windows, from windows of a sample of texts."""
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(RANGES, -(-total // RANGE_CHARS))
    if ranges <= 1:
        return []
    wanted = DRAWN * ranges
    share = min(1.0, max(2_000_000, 100 * wanted) / total)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in _runs_of_text(batches):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.arange(0, len(keys), 8))).cast(pa.binary())], ["key"])

    found = texts.sample(share, 7).mapInArrow(some, "key binary")
    return _bounds([row.key for row in found.orderBy(F.xxhash64("key"), "key").limit(wanted).collect()], ranges)


def _shared(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes: where each zero is, how many zeros each row has, and how many of them lie in what it shares with
    the row before it (none, of the first)."""
    starts, sizes = offsets[:-1], np.diff(offsets)
    owner = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(len(flat)) - starts[owner]
    before = owner - 1
    inside = (owner > 0) & (at < sizes[before])
    same = inside & (flat == flat[np.where(inside, starts[before] + at, 0)])
    alike = np.minimum.reduceat(np.where(same, len(flat), at), starts)
    zeros = np.flatnonzero(flat == 0)
    of = owner[zeros]
    return zeros, np.bincount(of, minlength=len(starts)), np.bincount(of[at[zeros] < alike[of]], minlength=len(starts))


_COUNTS = pa.schema([("key", pa.binary()), ("f", pa.int64())])
#: Stands before the first row of a range and shares nothing with it: no text holds this byte.
_NONE = b"\xff"


class _Prefixes:
    """Sums of equal prefixes along sorted windows, for every length. What comes out is ``least`` or more, or lies at an end
    of a range, where its sum may go on in the next."""

    def __init__(self, least: int):
        self.least, self.out, self.last = least, [], _NONE
        self.open = [None] * (LONGEST + 1)        # [prefix, its sum, whether the range began with it]

    def end(self) -> None:
        """The range ends here."""
        for depth in range(LONGEST + 1):
            self.close(depth, True)
        self.last = _NONE

    def close(self, depth: int, at_end: bool) -> None:
        if self.open[depth]:
            prefix, f, began = self.open[depth]
            if f >= self.least or began or at_end:
                self.out.append((prefix, f))
            self.open[depth] = None

    def add(self, rows: pa.Array, f: np.ndarray) -> None:
        """The next rows of the range."""
        began = self.last == _NONE
        rows = pa.concat_arrays([pa.array([self.last], pa.binary()), rows])
        self.last = rows[-1].as_py()
        offsets = np.frombuffer(rows.buffers()[1], np.int32)[:len(rows) + 1].astype(np.int64)
        flat = np.frombuffer(rows.buffers()[2], np.uint8)[:offsets[-1]]
        zeros, words, shared = _shared(flat, offsets)
        first_zero = np.cumsum(words) - words
        starts, words, shared, first_zero = offsets[1:-1], words[1:], shared[1:], first_zero[1:]
        for depth in range(LONGEST + 1):
            heads = np.flatnonzero(shared <= depth)           # rows at which another prefix begins
            if self.open[depth]:
                self.open[depth][1] += int(f[:heads[0] if len(heads) else len(f)].sum())
            if not len(heads):
                continue
            self.close(depth, False)
            sums = np.add.reduceat(f, heads)
            leaves = sums >= self.least
            leaves[-1] = True
            leaves[0] |= began
            for i in np.flatnonzero(leaves & (words[heads] > depth)).tolist():
                row = heads[i]
                entry = [flat[starts[row]:zeros[first_zero[row] + depth] + 1].tobytes(), int(sums[i]), began and i == 0]
                if i == len(heads) - 1:
                    self.open[depth] = entry
                else:
                    self.out.append(entry[:2])

    def taken(self) -> pa.RecordBatch:
        keys, sums = [k for k, _ in self.out], [f for _, f in self.out]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.int64())], schema=_COUNTS)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a range begins, rows of one range) of batches sorted by range."""
    last = None
    for batch in batches:
        segments = batch.column("segment").to_numpy()
        cuts = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1).tolist(), len(segments)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start < end:
                yield segments[start] != last, batch.slice(start, end - start)
                last = segments[start]


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(key, f): every phrase of ``least`` occurrences or more, in sortable form, and each label with its number of words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    bounds = _text_bounds(texts)

    @releasing
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, f in _runs_of_text(batches):
            segments = _ranged(keys, bounds)
            for at in range(0, len(keys), 50_000):
                rows = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(segments[rows]), keys[rows].cast(pa.binary()), pa.array(f[rows], pa.int64())],
                                                 ["segment", "key", "f"])

    @releasing
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _Prefixes(least)
        for begins, rows in _segments(batches):
            if begins:
                prefixes.end()
            prefixes.add(pa.concat_arrays([rows.column("key")]), rows.column("f").to_numpy())
            if len(prefixes.out) > 10_000:
                yield prefixes.taken()
        prefixes.end()
        yield prefixes.taken()

    runs = texts.mapInArrow(dealt, "segment int, key binary, f bigint")
    parts = runs.repartition("segment").sortWithinPartitions("segment", "key").mapInArrow(summed, "key binary, f bigint")
    return parts.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _turned(key: bytes) -> bytes:
    """The key with its words in reverse order."""
    label, *words = key[:-1].split(b"\0")
    return b"\0".join([label, *reversed(words), b""])


_STREAM = "lang string, phrase string, a bigint, n bigint, parts array<bigint>, goes boolean"
_STREAM_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("n", pa.int64()),
                            ("parts", pa.list_(pa.int64())), ("goes", pa.bool_())])


def _stream(frequent: DataFrame, backwards: bool, share: int) -> DataFrame:
    """(lang, phrase, a, n, parts, goes): in prefix order each phrase of two words or more with the counts of the parts it
    starts with, shortest first (``backwards``: in suffix order, of those it ends with); and (lang, phrase, goes) for
    each part that an extension is as frequent as."""
    keyed = frequent
    if backwards:
        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([_turned(k) for k in batch.column("key").to_pylist()], pa.binary()), batch.column("f")], schema=_COUNTS)

        keyed = frequent.mapInArrow(turned, "key binary, f bigint")
    n = frequent.count()
    ranges = min(RANGES, -(-n // RANGE_PHRASES))
    bounds = []
    if ranges > 1:
        drawn = keyed.sample(min(1.0, 2 * DRAWN * ranges / n), 7).select("key").limit(4 * DRAWN * ranges)
        bounds = _bounds([row.key for row in drawn.collect()], ranges)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            firsts = [bisect_right(bounds, k) for k in keys]
            reach = [bisect_right(bounds, k + _NONE) - first + 1 for k, first in zip(keys, firsts, strict=True)]
            rows = pa.array(np.repeat(np.arange(len(keys)), reach))
            places = np.concatenate([np.arange(n) for n in reach]) if keys else np.zeros(0, np.int64)
            segments = np.repeat(np.array(firsts, np.int64), reach) + places
            yield pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int32)), batch.column("key").take(rows), batch.column("f").take(rows),
                                              pa.array(places == 0)], ["segment", "key", "f", "own"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[bytes, int]] = []       # the label and the parts that the next row may start with
        for begins, rows in _segments(batches):
            if begins:
                open_ = []
            out = []
            for key, f, own in zip(*(rows.column(c).to_pylist() for c in ("key", "f", "own")), strict=True):
                while open_ and not key.startswith(open_[-1][0]):
                    open_.pop()
                if own and len(open_) > 1:
                    label, *words = map(_word, key[:-1].split(b"\0"))
                    lang, spoken = label.decode(), b" ".join(words[::-1] if backwards else words).decode()
                    out.append((lang, spoken, f, open_[0][1], [count for _, count in open_[1:]], None))
                    if len(open_) > 2 and 100 * f >= share * open_[-1][1]:
                        shorter = words[:-1][::-1] if backwards else words[:-1]
                        out.append((lang, b" ".join(shorter).decode(), None, None, None, True))
                open_.append((key, f))
            yield pa.RecordBatch.from_pylist([dict(zip(_STREAM_SCHEMA.names, row, strict=True)) for row in out], schema=_STREAM_SCHEMA)

    dealt_ = keyed.mapInArrow(dealt, "segment int, key binary, f bigint, own boolean")
    return dealt_.repartition("segment").sortWithinPartitions("segment", "key").mapInArrow(walked, _STREAM)


def scored(frequent: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer phrase drops; ``frequent`` as of :func:`counts`."""
    fore, back = _stream(frequent, False, share), _stream(frequent, True, share)
    both = fore.withColumnRenamed("parts", "firsts").unionByName(back.withColumnRenamed("parts", "rests"), allowMissingColumns=True)
    phrases = both.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("a", "n", "firsts", "rests", "goes")])
    cuts = F.expr("""array_min(transform(sequence(1, size(firsts)), k -> struct(
        (cast(1000 as decimal(38,0)) * a * n) div (cast(firsts[k - 1] as decimal(38,0)) * rests[size(rests) - k]) AS score, k AS k,
        firsts[k - 1] AS l, rests[size(rests) - k] AS r)))""")
    kept = phrases.where("goes IS NULL").withColumn("cut", cuts)
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` collocations of each language."""
    found = scored(written(counts(docs, text, lang, least), "phrases"), share)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
