"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

WORDS = "the of and tion ing press lamp river stone blue walks over under north quiet engine paper glass wind ember".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(n))


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def odd_texts() -> list[str | None]:
    return [None, "", "   \t\n ", "one two", "One  TWO", "one two three four", prose(1, 60), prose(1, 60).upper(), prose(1, 60) + " tail",
            edited(prose(1, 60), 2, 2), prose(2, 5), "\x1f\x85 é ß 汉字 \U0001F600 x<|endoftext|>y", "a" * 3000,
            prose(3, 20_000), "1234 5678 !!! ...", "don't we'll\r\n\r\n  end  "]


def documents(spark, extra=()):
    """doc_id, text, lang, source, n_chars, and columns whose names clash with what operators add."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate([*odd_texts(), *extra])]
    rows += [rows[6], rows[6], (None, prose(9, 40), None, None, 0), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    names = ["key", "c", "size", "spans", "score", "ids", "n_tokens", "rank", "text_key", "row"]
    clash = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], f"{schema}, {clash}")


def empty(spark):
    return documents(spark).where("false")
