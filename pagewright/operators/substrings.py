"""Which of many phrases a text holds, in one pass over it: an Aho-Corasick automaton of all phrases.

A text's cost does not grow with the number of phrases. Phrases are compared as they are; callers that ignore case lower
both sides. An empty phrase is in every text; a null text holds none.

Tasks hold the automaton of one pass, of phrases that take ``PASS_BYTES`` at most; more phrases take further passes over
the same rows. Phrases reach the driver a pass at a time.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASS_BYTES = 16 << 20


def _passes(phrases: DataFrame) -> Iterator[list[str]]:
    batch, size = [], 0
    for row in phrases.toLocalIterator():
        batch.append(row[0])
        size += 64 + 8 * len(row[0])              # of an automaton, about
        if size >= PASS_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _held(phrases: list[str]):
    words = [p for p in phrases if p]
    always = [p for p in phrases if not p]

    @F.arrow_udf("array<string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        if words:
            automaton.make_automaton()
        for texts in batches:
            found = []
            for text in texts.to_pylist():
                if text is None:
                    found.append([])
                else:
                    found.append(always + sorted({word for _, word in automaton.iter(text)} if words else ()))
            yield pa.array(found, pa.list_(pa.string()))

    return find


def with_held(rows: DataFrame, text: str, phrases: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: those of ``phrases`` (its only column, distinct) that the column ``text`` holds."""
    held = F.array().cast("array<string>")
    for batch in _passes(phrases):
        held = F.concat(held, _held(batch)(F.col(text)))
    return rows.withColumn(name, held)
