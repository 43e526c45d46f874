"""Many phrases at once against one search each."""

import random

from pyspark.sql import functions as F

from pagewright.operators import substrings
from pagewright.plans import evaluate


def test_agrees_with_contains(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, ""]
    phrases = sorted({"".join(rng.choice("ab é") for _ in range(rng.randrange(0, 6))) for _ in range(60)} | {"", "a", "ab", "b"})
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    asked = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for size in (substrings.PASS_BYTES, 500):     # one pass, then several
        monkeypatch.setattr(substrings, "PASS_BYTES", size)
        for r in substrings.with_held(rows, "t", asked, "held").collect():
            assert sorted(r["held"]) == ([] if texts[r["i"]] is None else [p for p in phrases if p in texts[r["i"]]])
    none = substrings.with_held(rows, "t", asked.limit(0), "held")
    assert none.where(F.size("held") > 0).count() == 0


def test_conditions_of_a_case(spark):
    listed = [{"id": 1, "q": "?", "accept": [{"text_contains": "Whole PASSAGE"}, {"lang": " DE ", "text_contains_any": ["x y", "zz"]}]},
              {"id": 2, "q": "?", "accept": [{"lang": "fr"}]}, {"id": 3, "q": "?", "accept": [{"text_contains": "whole"}]}]
    results = [("1", 1, "a whole", "de"), ("1", 2, "X Y", "en"), ("1", 3, "..X Y..", "De"), ("1", 4, "the whole passage", "en"),
               ("2", 1, "whole", "en"), ("2", 2, None, "FR"), ("3", 1, None, "de")]
    df = spark.createDataFrame(results, "qid string, rank int, text string, lang string")
    found = {r["id"]: r["rank"] for r in evaluate.first_relevant(df, evaluate.cases(spark, listed), "text", ["lang"]).collect()}
    assert found == {"1": 3, "2": 2, "3": 0}
