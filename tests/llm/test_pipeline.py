"""The pipeline against a brute-force version of each stage, and the registered queries' shape."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers as public
import pytest

import corpus_pipeline
from pagewright.llm import byte_bpe, language, secret_scan
from pagewright.llm.queries import QUERIES
from tests.llm.tables import documents, edited, prose
from tests.llm.test_jaccard import brute as components
from tests.llm.test_jaccard import grams
from tests.llm.test_mixing import levels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    extra = [prose(40, 300), edited(prose(40, 300), 1, 3), "my token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" here", "???", prose(41, 90)]
    documents(spark, extra).write.parquet(str(path / "documents.parquet"))
    return str(path)


def redact(text):
    out, at = [], 0
    for start, _, end, _ in sorted((m.start(), p, m.end(), r.kind) for p, r in enumerate(secret_scan.RULES)
                                   for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least):
        if start >= at:
            out.append(text[at:start])
        at = max(at, end)
    return "[SECRET]".join([*out, text[at:]])


def mixed(rows):
    sizes, upto, queue = {}, {}, []
    docs = sorted(rows, key=lambda r: (hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest(), r[0] is not None, r[0] or 0))
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in docs]
    for (_, _, source), n in zip(docs, words, strict=True):
        sizes[source] = sizes.get(source, 0) + n
    rank, targets = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}, levels(sizes)
    for place, ((_, _, source), n) in enumerate(zip(docs, words, strict=True)):
        upto[source] = upto.get(source, 0) + n
        if n and targets[source]:
            queue += [((turn * sizes[source] + upto[source]) / float(targets[source]), rank[source], turn, place, n)
                      for turn in range(min(3, math.ceil(targets[source] / sizes[source])))]
    budget, out = sum(words), []
    for *_, place, n in sorted(queue):
        if n > budget:
            break
        budget -= n
        out.append(docs[place])
    return out


def test_pipeline_agrees_with_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.learn(table)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.collect()]
    rows = [r for r in rows if language.infer(r[1], model)]
    classes = {n: c for n, _, c in components([r[:2] for r in rows])}
    seen, kept = set(), []
    for number, text, source in rows:
        if (number is None or classes[number] == number or not grams(text)) and (number, text) not in seen:
            seen.add((number, text))
            kept.append((number, redact(text), source))
    path = public.path("byte_bpe_50k.tiktoken")
    wanted = [(-1 if n is None else n, str(s), bytes(byte_bpe.encode_texts([t], path, public.PATTERN)[0])) for n, t, s in mixed(kept)]
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], str(r["source"]), bytes(r["ids"])) for r in found) == sorted(wanted)
    assert all(r["decodes"] and r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) for r in found)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_secrets_are_gone_after_their_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.without_secrets(spark, docs, folder)
    assert clean.count() == docs.count()
    changed = [r for r in clean.collect() if r["text"] and "[SECRET]" in r["text"]]
    assert changed and all(r["n_chars"] == len(r["text"]) for r in changed)


def test_every_operator_is_registered():
    names = sorted(QUERIES)
    assert [n for n in names if n == "pipeline"] and sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op")}) == list(range(1, 14))
    assert all(len(corpus_pipeline.STAGES[i]) == 2 for i in range(5))
