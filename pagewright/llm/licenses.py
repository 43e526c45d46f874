"""License scans by diagonal voting.

Every run of ``GRAM`` words of a text is hashed and joined with the places of such runs in license templates. A match
votes for a diagonal: the place in the text less the place in the template. Votes are summed by diagonal; diagonals of a
template that lie close together (words put in or left out) merge into one span. A vote counts only if the words
themselves agree, which rules out equal hashes of other words. A phrase of the base list stands wherever all runs of
its template vote for one diagonal.

Last, spans of notices are verified: whatever their share, the words that decide the label (name, and version where the
label has one) must stand in order where the template lies over the text; see ``DECISIVE``. A span that lacks them gives
no label. It still counts for the score, which is the share of words alone.

Null and empty texts have no words and no spans. Repeated rows are scanned each. Overlapping and tied spans all count.
Texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import ascii_lower

GRAM = 3

#: What lies between words: ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases that alone decide a base label.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Opening words of public license texts and notices.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

#: Words on each side of a template's place that may hold a version, and the name where the notice has none.
AROUND = 20

_MARK = "(?:version|ver|[a-z]*v) ?"


def _version(number: int) -> str:
    """The first version named is ``number`` or ``number``.0."""
    return rf"(?:(?:(?!{_MARK}\d)\S+ ){{0,{AROUND}}}?{_MARK})?{number} (?![1-9] )"


_HERE = r"^[^|]*\|[^|]* "
_APACHE = "apache (?:software )?license (?:[|] )?"

# What must stand in order for each of NOTICES, in words with a blank on each side; "|" stands before and
# after the template's place. Names must stand in that place and in one piece (GNU Lesser is not GNU General). The
# second Apache sentence names no license, and others have it too (MPL 1.1, CDDL), so the name or address is near.
DECISIVE = [
    _HERE + r"mit [^|]*license ",
    _HERE + r"free of charge [^|]*person obtaining [^|]*of this software ",
    _HERE + _APACHE + _version(2),
    rf" (?:{_APACHE}{_version(2)}|apache org licenses license 2 0 )",
    _HERE + r"cc by nc ",
    _HERE + r"gnu general public license " + _version(3),
    _HERE + r"gnu general public license ",
    _HERE + r"redistribution and use [^|]*source and binary forms [^|]*are (?:hereby )?permitted ",
    _HERE + r"mozilla public license " + _version(2),
]

#: Share of a notice's words that a span must hold, furthest distance of diagonals that merge, and of their places.
SHARE = 0.75
SHIFT = 2
REACH = 6


def templates(spark: SparkSession) -> DataFrame:
    """One row for each run of words of a template: as many as the lists above have words, whatever the input."""
    rows = []
    for number, ((label, phrase), decisive) in enumerate(zip([*BASE, *NOTICES], [None] * len(BASE) + DECISIVE, strict=True)):
        words = phrase.split()
        rows += [(number, label, number < len(BASE), decisive, len(words), place, *words[place:place + GRAM])
                 for place in range(len(words) - GRAM + 1)]
    names = [f"t{i}" for i in range(GRAM)]
    schema = "template int, label string, base boolean, decisive string, length int, place int, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64(*names))


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def decided(words: Column, diagonal: Column, length: Column, decisive: Column) -> Column:
    """Whether the decisive words stand where a template of ``length`` words lies; null for one that has none."""
    def cut(start: Column, stop: Column) -> Column:
        start, stop = F.greatest(start, F.lit(0)), F.greatest(stop, F.lit(0))
        return F.concat(F.lit(" "), F.array_join(F.slice(words, start + 1, stop - start), " "), F.lit(" "))

    first, after = diagonal - SHIFT, diagonal + length + SHIFT
    laid = F.concat(cut(first - AROUND, first), F.lit("|"), cut(first, after), F.lit("|"), cut(after, after + AROUND))
    return F.when(decisive.isNotNull(), F.rlike(F.regexp_replace(laid, " +", " "), decisive))


def spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: row, doc_id, n_words, and ``spans``: (label, base, exact, first word, last word, share, decided)."""
    words = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("w"))
    runs = F.arrays_zip(*[(F.col("w") if i == 0 else F.slice("w", i + 1, F.size("w"))).alias(f"w{i}") for i in range(GRAM)])
    grams = words.select("row", "doc_id", "w", F.size("w").alias("n_words"), F.posexplode_outer(runs).alias("at", "g"))
    grams = grams.select("row", "doc_id", "w", "n_words", F.coalesce("at", F.lit(0)).alias("at"),
                         *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(GRAM)])
    held = F.broadcast(templates(df.sparkSession))
    same = F.xxhash64(*[f"w{i}" for i in range(GRAM)]) == F.col("hash")
    for i in range(GRAM):
        same &= F.col(f"w{i}") == F.col(f"t{i}")
    # the first place stays without a match, so that every document has a row
    met = grams.join(held, same, "left").where("template IS NOT NULL OR at = 0")
    # here, while the words are at hand: a document's words are neither shuffled nor copied for each of its runs
    held_here = decided(F.col("w"), F.col("at") - F.col("place"), F.col("length"), F.col("decisive"))
    votes = met.withColumn("decided", held_here).drop("w").groupBy("row", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("base").alias("base"), F.first("length").alias("length"), F.min("at").alias("first"),
        F.max("at").alias("last"), F.count("*").alias("votes"), F.bool_or("decided").alias("decided"))
    along = W.partitionBy("row", "template").orderBy("first", "diagonal")
    before = W.partitionBy("row", "template").orderBy("first", "diagonal").rowsBetween(W.unboundedPreceding, -1)
    apart = F.col("base") | F.lag("last").over(along).isNull() | (
        F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > SHIFT) | (
        F.col("first") - F.max("last").over(before) > GRAM + REACH)
    merged = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = merged.withColumn("span", F.sum("apart").over(along)).groupBy("row", "template", "span").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("base").alias("base"), F.min("first").alias("first"), (F.max("last") + GRAM - 1).alias("last"),
        F.least(F.lit(1.0), F.sum(F.col("votes") + GRAM - 1) / F.first("length")).alias("share"),
        F.coalesce(F.bool_or("decided"), F.lit(False)).alias("decided"))
    exact = F.col("base") & (F.col("share") >= 1.0)
    span = F.struct("label", "base", exact.alias("exact"), "first", "last", "share", "decided")
    return merged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("template").isNotNull(), span))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of ``spans``."""
    base = F.filter("spans", lambda s: s["exact"])
    kept = F.filter("spans", lambda s: s["exact"] | (~s["base"] & (s["share"] >= SHARE) & s["decided"]))
    starts = F.transform(base, lambda s: s["first"].cast("bigint"))

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")

    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(kept).alias("labels"), score.alias("score"))
