"""SQL fragments the checks share."""

import re

from pagewright import rules

# every white-space character, as an SQL expression
WHITE = "||".join(f"chr({c})" for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
                                        8232, 8233, 8239, 8287, 12288])


def strip(x: str) -> str:
    return f"trim({x}, {WHITE})"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def spelled(pattern: str) -> str:
    """Word boundaries spelled out: the check's regex engine knows them for ASCII letters only."""
    pattern = re.sub(r"\\b(?=$|[|)])", r"(?:$|[^\\pL\\pN_])", pattern)
    return pattern.replace(r"\b", r"(?:^|[^\pL\pN_])")


def has(x: str, pattern: str, any_case: bool = False) -> str:
    return f"regexp_matches({x}, {quoted(('(?i)' if any_case else '') + spelled(pattern))})"


def keyword_case(x: str, table, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {has(x, p, True)} THEN '{n}'" for n, p in table) + f" ELSE {default} END"


def range_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN try_cast({x} AS INT) BETWEEN {lo} AND {hi} THEN '{n}'"
                              for lo, hi, n in rules.SUBSYSTEM_RANGES) + " ELSE 'UNKNOWN' END"


def subsystem(text: str, number: str) -> str:
    return f"coalesce({keyword_case(text, rules.SUBSYSTEM_KEYWORDS)}, {range_case(number)})"


def content_type(x: str) -> str:
    signals = [has(x, p, True) for p in rules.PROCEDURE_SIGNALS_ANY_CASE] + [has(x, p) for p in rules.PROCEDURE_SIGNALS]
    return (f"CASE WHEN {' OR '.join(signals)} THEN 'procedure' WHEN {has(x, rules.NOTE_SIGNAL, True)} THEN 'note' "
            "ELSE 'section' END")


def tokens(x: str) -> str:
    """Distinct tokens in order of first appearance."""
    both = (f"list_concat(regexp_extract_all(lower({x}), '[a-z0-9]+(?:[/.][a-z0-9]+)+'), "
            f"regexp_extract_all(lower({x}), '[a-z0-9_\\-]+'))")
    return both


# token lists, postings, statistics and scores over (id, text) rows named corpus
BM25 = f"""
tok AS (SELECT id, list_distinct({tokens('text')}) AS tokens FROM corpus),
sized AS (SELECT id, tokens, len(tokens) AS dl FROM tok),
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
post AS (SELECT id, dl, unnest(tokens) AS term FROM sized),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw
        FROM post, stat GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def bm25_scores(question_rows: str) -> str:
    """``scored(qid, id, score)`` of questions (qid, question)."""
    return f"""{BM25},
asked AS (SELECT qid, unnest(list_distinct({tokens('question')})) AS term FROM ({question_rows})),
scored AS (SELECT qid, id, sum(idf) * 2.5 / (1.0 + 1.5 * (0.25 + 0.75 * any_value(dl) / any_value(avgdl))) AS score
           FROM asked JOIN idf USING (term) JOIN post USING (term), stat GROUP BY qid, id)"""
