"""Token counts and byte-level encoding against the tokenizer libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from tokenizers import Tokenizer

from pagewright.llm import byte_bpe, pretokens, token_count
from tests.llm.tables import documents, empty, odd_texts

COUNTS, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "the", "'s", " ", "  ", "\n", "1", "é", "ß", " ", "\x1f", "\x85", "!", "<|endoftext|>", "‍", "𐐀", "ing", "\t"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [t or "" for t in odd_texts()] + ["".join(rng.choices(PARTS, k=rng.randrange(60))) for _ in range(2000)]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_agree_with_the_library(texts):
    tokenizer = Tokenizer.from_file(COUNTS)
    wanted = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [token_count.count(t, COUNTS, public.PATTERN) for t in texts] == wanted


def test_replay_agrees_with_the_library(texts, library):
    packed = byte_bpe.encode_texts(texts, RANKS, public.PATTERN)
    for text, ids in zip(texts, packed, strict=True):
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert byte_bpe.decode_ids(ids, RANKS) == text.encode()


def test_long_texts_are_cut_the_same(monkeypatch):
    text = "one  two\n\n three" * 200
    whole = next(pretokens.pieces(text, public.PATTERN))
    monkeypatch.setattr(pretokens, "LAZY_CHARS", 10)
    monkeypatch.setattr(pretokens, "LAZY_PIECES", 7)
    assert [w for block in pretokens.pieces(text, public.PATTERN) for w in block] == whole


def test_a_full_store_is_emptied(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    monkeypatch.setattr(token_count, "KEPT", 3)
    text = " ".join(f"word{i}" for i in range(50))
    assert byte_bpe.encode_texts([text, text], RANKS, public.PATTERN)[1] == np.array(library.encode_ordinary(text), "<u4").tobytes()
    assert token_count.count(text, COUNTS, public.PATTERN) == len(library.encode_ordinary(text))


def test_columns(spark, library):
    docs = documents(spark)
    rows = token_count.token_counts(docs, COUNTS, public.PATTERN).collect()
    assert len(rows) == docs.count()
    for row in rows:
        text = row["text"] or ""
        assert row["n_tokens"] == token_count.count(text, COUNTS, public.PATTERN)
        assert (row["n_bytes"], row["over_limit"]) == (len(text.encode()), row["n_tokens"] > 512)
    for row in byte_bpe.round_trip(docs, RANKS, public.PATTERN).collect():
        text = row["text"] or ""
        assert bytes(row["decoded"]) == text.encode() and row["n_tokens"] == len(library.encode_ordinary(text))
        assert hashlib.sha256(row["ids"]).digest() == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).digest()
    assert token_count.token_counts(empty(spark), COUNTS, public.PATTERN).count() == 0
    assert byte_bpe.round_trip(empty(spark), RANKS, public.PATTERN).count() == 0
