"""Rule tables turned into column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.text import any_match, extract, matches


def _any_rule(col: Column, table: list[tuple[str, str]]) -> Column:
    """Whether any rule matches, in one pass: most texts match none and need no other."""
    return any_match(col, [word for _, pattern in table for word in pattern.split("|")], True)


def first_rule(col: Column, table: list[tuple[str, str]]) -> Column:
    """Name of the first keyword rule that matches, else NULL."""
    return rule_name(first_rule_index(col, table), table)


def first_rule_index(col: Column, table: list[tuple[str, str]]) -> Column:
    """Position of the first matching rule, else NULL: the minimum over the parts of a text is that of the whole."""
    return F.when(_any_rule(col, table), F.coalesce(
        *[F.when(matches(col, pattern, True), F.lit(i)) for i, (_, pattern) in enumerate(table)]))


def rule_name(index: Column, table: list[tuple[str, str]]) -> Column:
    return F.get(F.array(*[F.lit(name) for name, _ in table]), index)


def range_name(number: Column, table: list[tuple[int, int, str]] = rules.SUBSYSTEM_RANGES) -> Column:
    """First inclusive range that holds the number, else NULL."""
    n = number.try_cast("int")
    return F.coalesce(*[F.when(n.between(lo, hi), F.lit(name)) for lo, hi, name in table])


def subsystem_of(text: Column, number: Column | None = None) -> Column:
    found = [first_rule(text, rules.SUBSYSTEM_KEYWORDS)]
    if number is not None:
        found.append(range_name(number))
    return F.coalesce(*found, F.lit("UNKNOWN"))


def question_subsystem(question: Column) -> Column:
    return first_rule(question, rules.QUESTION_KEYWORDS)


def procedure_signal(text: Column) -> Column:
    return (any_match(text, rules.PROCEDURE_SIGNALS_ANY_CASE, True) | any_match(text, rules.PROCEDURE_SIGNALS))


def content_rank(text: Column) -> Column:
    """0 procedure, 1 note, 2 section; the minimum over the parts of a text is that of the whole."""
    return (F.when(procedure_signal(text), 0).when(matches(text, rules.NOTE_SIGNAL, True), 1).otherwise(2))


def content_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("procedure"), F.lit("note"), F.lit("section")), rank + 1)


def content_type_of(text: Column) -> Column:
    return content_name(content_rank(text))


def procedure_number(text: Column) -> Column:
    return extract(text, rules.PROCEDURE_NUMBER, 1)


def lookup(key: Column, table: dict[str, str], default: str = "UNKNOWN") -> Column:
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], table.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def cid_subsystem(cid: Column) -> Column:
    return lookup(F.substring(F.upper(cid), 1, 4), rules.CID_PREFIXES)


def label_subsystem(label: Column) -> Column:
    return lookup(F.upper(label), rules.INDEX_LABELS)
