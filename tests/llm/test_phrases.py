"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pagewright.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, key string, f bigint"


def plain(rows, least, best=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least}
    gone = {(lang, w[i:i + k]) for (lang, w), a in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= f[lang, w[i:i + k]]}
    found = defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) > 1 and (lang, w) not in gone:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
            for lang, some in found.items() for i, (s, a, p, left, right) in enumerate(sorted(some)[:best])}


def mined(spark, rows, least, **how):
    df = spark.createDataFrame([(1, text, lang, "x", 1) for text, lang in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in phrases.collocations(df, least=least, **how).collect()]
    assert len(set(found)) == len(found)
    return set(found)


@pytest.fixture
def small(monkeypatch):
    """Many runs and ranges out of little text."""
    for name, value in {"RUN_BYTES": 300, "RANGE_CHARS": 500, "RANGE_PHRASES": 7}.items():
        monkeypatch.setattr(phrases, name, value)


def texts(seed, n=120):
    draw = random.Random(seed)
    words = ["a", "b", "c", "the", "THE", "été", "日本", "x\x00y", "x", "\x01", "x\x01", "y\x02", "ab", "\x1f"]
    gaps = [" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n"]
    fixed = "the quick brown fox jumps over it"
    return [("".join(draw.choice([fixed, *words]) + draw.choice(gaps) for _ in range(draw.randrange(0, 40))), draw.choice(["en", "de", None, "und", "e\x00"]))
            for _ in range(n)]


def test_random_texts(spark, small):
    rows = texts(1)
    for least in (1, 3, 12):
        assert mined(spark, rows, least) == plain(rows, least)


def test_whole_runs(spark):
    rows = texts(2)
    assert mined(spark, rows, 4) == plain(rows, 4)
    assert mined(spark, rows, 4, best=5) == plain(rows, 4, 5)


def test_hot_phrase_and_repeated_rows(spark, small):
    rows = [("a a a a a a", "en")] * 70 + [("one two three four five six seven", "en")] * 40
    assert mined(spark, rows, 30) == plain(rows, 30)


def test_long_texts_are_cut_between_words(spark, small):
    rows = [("alpha beta gamma " * 400, "en"), ("w" * 2000 + " next " + "v" * 900 + " last", "en"), (("alpha beta. " * 300), None)] * 2
    assert mined(spark, rows, 2) == plain(rows, 2)


def test_nothing_to_find(spark):
    assert mined(spark, [], 1) == set()
    assert mined(spark, [(None, "en"), ("", None), (" .,\n\t", "de"), ("one", "en")], 1) == set()


def test_arithmetic_passes_64_bits(spark):
    """Counts as large as a cluster could find them."""
    big = 4_000_000_000_000
    keys = [(b"en\0", 10**15), (b"en\0a\0", 3 * big), (b"en\0b\0", 2 * big + 1), (b"en\0a\0b\0", big + 3)]
    frequent = spark.createDataFrame([(bytearray(k), f) for k, f in keys], "key binary, f bigint")
    row = phrases.scored(frequent).first()
    assert (row.a, row.l, row.r, row.n) == (big + 3, 3 * big, 2 * big + 1, 10**15)
    assert row.score == 1000 * (big + 3) * 10**15 // (3 * big * (2 * big + 1))
