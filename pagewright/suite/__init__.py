"""Registered queries: each operator run over whole given tables, with the SQL that checks it."""

from pagewright.suite import command_queries, retrieval_queries, segment_queries, text_queries


def registered() -> dict:
    """``{name: (query(spark, folder), check SQL)}``."""
    return {**command_queries.QUERIES, **text_queries.QUERIES, **segment_queries.QUERIES, **retrieval_queries.QUERIES}
