"""What a question asks for."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.text import any_match, java, known, matches


def question_date(question: Column) -> Column:
    """ISO day named in the question, else NULL. The day is not checked against the calendar."""
    parts = F.regexp_extract(question, java(f"(?:{rules.QUESTION_DATE})"), 0)
    return known(F.regexp_replace(parts, java(r"[/\s]"), "-"))


def route(question: Column) -> Column:
    """``commands`` for questions with a strong command-log signal, else ``knowledge``."""
    log = (
        matches(question, rules.QUESTION_DATE)
        | any_match(question, rules.LOG_QUESTION_EXACT)
        | any_match(question, rules.LOG_QUESTION_ANY_CASE, True)
    )
    return F.when(log, F.lit("commands")).otherwise(F.lit("knowledge"))


def wants_image(question: Column) -> Column:
    return matches(question, rules.IMAGE_INTENT, True)


def wants_procedure(question: Column) -> Column:
    return matches(question, rules.PROCEDURE_INTENT, True)
