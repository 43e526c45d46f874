"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: an OR of clauses, each an AND of the trigrams
that any match spells, in lower case. Postings (trigram, document) hold the trigrams the queries name; they are met with
the clauses, and a document is a candidate for a rule when one clause has all its trigrams. Candidates are verified by
the expression itself on the whole text. Rules that name no trigram scan every text.

A rule's matches are leftmost and do not overlap; those below its length are dropped. Spans are in code points, end
exclusive. Null and empty texts have no spans. Repeated rows are scanned each, rows without an id too. Spans that tie in
start go by the order of the rules. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import text_key


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; ``base`` rules are the list's own. Where the expression ends
    in a class repeated to the end of its run and stands for the whole match, the least length may be part of it: a
    shorter match holds no longer one."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base list, then prefixes that public services give their keys.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

#: Alternatives a query may grow to before a part of the expression is taken to spell nothing.
ALTERNATIVES = 64
GAP = "\0"


def _spellings(parsed) -> list[str]:
    """Alternatives of what a parsed expression spells; GAP stands for anything."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts = [chr(value).lower()]
        elif name == "SUBPATTERN":
            parts = _spellings(value[3])
        elif name == "BRANCH":
            parts = [s for branch in value[1] for s in _spellings(branch)]
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            parts = sorted({chr(c).lower() for _, c in value})
        elif name == "MAX_REPEAT" and value[1] == 1:
            parts = [*([""] if value[0] == 0 else []), *_spellings(value[2])]
        elif name == "MAX_REPEAT" and value[0] == value[1] and value[0] <= 8:
            parts = [reduce(str.__add__, p) for p in product(_spellings(value[2]), repeat=value[0])] \
                if len(_spellings(value[2])) == 1 else [GAP]
        elif name == "AT":
            parts = [""]
        else:
            parts = [GAP]
        if len(out) * len(parts) > ALTERNATIVES:
            parts = [GAP]
        out = [a + b for a in out for b in parts]
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of trigrams that every match holds in lower case; empty when some match need hold none."""
    clauses = set()
    for spelling in _spellings(_parser.parse(pattern)):
        grams = {run[i:i + 3] for run in spelling.split(GAP) for i in range(len(run) - 2)}
        if not grams:
            return []
        clauses.add(frozenset(grams))
    least = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(sorted(c) for c in least)


def clauses(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(gram, kind, clause, bit, full): the rules' queries, as many rows as they have trigrams, whatever the input."""
    rows = [(gram, rule.kind, number, 1 << place, (1 << len(clause)) - 1) for rule in rules
            for number, clause in enumerate(trigram_query(rule.pattern)) for place, gram in enumerate(clause)]
    return spark.createDataFrame(rows, "gram string, kind string, clause int, bit bigint, full bigint")


def candidates(df: DataFrame, text: str, doc_id: str, rules: list[Rule]) -> DataFrame:
    """(_doc_id, _key, _kinds): documents that some rule with a trigram query has to look at."""
    wanted = clauses(df.sparkSession, rules)
    grams = sorted({g for rule in rules for clause in trigram_query(rule.pattern) for g in clause})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(doc_id).alias("_doc_id"), text_key(F.col(text)).alias("_key"), low.alias("_low"))
    postings = rows.select("_doc_id", "_key", F.explode(F.array_compact(F.array(
        *[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams]))).alias("gram"))
    met = postings.join(F.broadcast(wanted), "gram")
    held = met.groupBy("_doc_id", "_key", "kind", "clause").agg(F.bit_or("bit").alias("held"), F.first("full").alias("full"))
    return held.where("held = full").groupBy("_doc_id", "_key").agg(F.collect_set("kind").alias("_kinds"))


def _matches(text: Column, rule: Rule, place: int) -> Column:
    """Array of (start, place of the rule, end, kind). Gaps and matches alternate, so their lengths give the offsets."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    pieces = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"),
                          judged.alias("judged"))
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")

    def step(held: Column, piece: Column) -> Column:
        start = held["at"] + F.length(piece["gap"])
        end = start + F.length(piece["hit"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(F.length(piece["judged"]) >= rule.least, F.array_append(held["found"], span)).otherwise(held["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), empty.alias("found")), step)["found"]


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """``df`` with ``spans``: array of (start, place, end, kind), by start, then rule."""
    found = candidates(df, text, doc_id, rules)
    keyed = df.withColumn("_own", text_key(F.col(text)))
    met = keyed.join(found, F.col(doc_id).eqNullSafe(F.col("_doc_id")) & (F.col("_own") == F.col("_key")), "left")
    whole, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    parts = []
    for place, rule in enumerate(rules):
        look = F.array_contains("_kinds", rule.kind) if trigram_query(rule.pattern) else whole.rlike(rule.pattern)
        parts.append(F.when(look, _matches(whole, rule, place)).otherwise(none))
    return met.withColumn("spans", F.array_sort(F.concat(*parts))).drop("_own", "_doc_id", "_key", "_kinds")


def _spelled(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of ``scan``."""
    names = [r.kind for r in rules if r.base]

    def many(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [many(n).alias(f"n_{n}") for n in names]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select("doc_id", *counts, F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(F.col("spans")).alias("spans"))


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` without ``spans``, its texts with each stretch that spans cover replaced by ``[SECRET]``."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(held: Column, span: Column) -> Column:
        before = F.substring(F.col(text), held["at"] + 1, span["start"] - held["at"])
        return F.when(span["start"] < held["at"], F.struct(F.greatest(held["at"], span["end"]).alias("at"), held["parts"].alias("parts"))
                      ).otherwise(F.struct(span["end"].alias("at"), F.array_append(held["parts"], before).alias("parts")))

    def join(held: Column) -> Column:
        rest = F.substring(F.col(text), held["at"] + 1, F.length(F.col(text)))
        return F.array_join(F.array_append(held["parts"], rest), "[SECRET]")

    clean = F.when(F.size("spans") == 0, F.col(text)).otherwise(F.aggregate("spans", step, cut, join))
    return found.withColumn(text, clean).drop("spans")
