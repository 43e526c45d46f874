"""The command log: raw lines to records, one day's listing, and its counters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions.classify import cid_subsystem
from pagewright.functions.text import escape_unprintable, java, split_lines, strip
from pagewright.operators.ordered import blocks_of, number_rows

FIELDS = ["sl_no", "code", "cid", "mnemonic", "command_time", "command_data", "data_cmd_value", "orbit_no", "status",
          "source_station", "dest_station"]
_MARK = "\x1c"      # a line end in the source, so no line holds it


def log_lines(files: DataFrame) -> DataFrame:
    """Log files ``(doc_key, doc_filename, content)`` to lines; every byte is one character."""
    return files.select("doc_key", "doc_filename",
                        F.posexplode(split_lines(F.decode("content", "ISO-8859-1"))).alias("ord", "line"))


def parse_log(lines: DataFrame, line: Column) -> DataFrame:
    """Rows of the log as command records; lines of any other form are dropped. One regex run per line."""
    marks = _MARK.join(f"${i}" for i in range(1, len(FIELDS) + 1))
    spread = F.regexp_replace(line, java(rules.LOG_ROW, dotall=True) + r"[\s\S]*", marks)
    found = lines.select("*", F.explode(F.filter(F.array(F.split(spread, _MARK)),
                                                 lambda p: F.size(p) == len(FIELDS))).alias("_p"))
    raw = {name: F.col("_p")[i] for i, name in enumerate(FIELDS)}
    taken = {name: strip(value) for name, value in raw.items()} | {
        "command_data": strip(escape_unprintable(raw["command_data"]))}
    when = taken["command_time"]
    cell = {
        "record_id": F.concat(F.lit("TCH_"), taken["sl_no"]),
        "content_type": F.lit("command_log"),
        **taken,
        "date": F.translate(F.substring(when, 1, 10), " ", "-"),
        "time": F.substring(when, 12, 8),
        "milliseconds": F.substring(when, 21, 3),
        "subsystem": cid_subsystem(taken["cid"]),
    }
    rows = found.withColumns(cell).drop("_p")
    sentence = F.format_string(
        "Command %s (CID: %s) was uplinked on %s at %s UTC from %s to %s. Orbit number: %s. Status: %s. Subsystem: %s.",
        "mnemonic", "cid", "date", "time", "source_station", "dest_station", "orbit_no", "status", "subsystem")
    return rows.withColumn("text", sentence)


def on_day(commands: DataFrame, day: str) -> DataFrame:
    """All commands of a day in time order, numbered from 1 in ``nth``.

    The numbering is segmented by second and list position: a day, or a second, may hold most of the log.
    """
    picked = commands.where(F.col("date") == day)
    return number_rows(picked.withColumn("_all", F.lit(0)), ["_all"], ["time", "ord"],
                       F.struct("time", blocks_of(F.col("ord")).alias("slice")), "nth").drop("_all")


def counted(commands: DataFrame, column: str) -> DataFrame:
    """Occurrences ``n`` per value, and ``first``, the (time, list order) of its first appearance."""
    return commands.groupBy(column).agg(F.count("*").alias("n"), F.min(F.struct("time", "ord")).alias("first"))


def counter(commands: DataFrame, column: str) -> DataFrame:
    """Occurrences per value, most frequent first, ties in order of first appearance."""
    return counted(commands, column).orderBy(F.col("n").desc(), "first").drop("first")


def table_view(commands: DataFrame) -> DataFrame:
    """The eight columns a command table shows."""
    shown = {"Time": "time", "CID": "cid", "Mnemonic": "mnemonic", "Orbit": "orbit_no", "Status": "status",
             "From": "source_station", "To": "dest_station", "Subsystem": "subsystem"}
    return commands.select(*[F.col(old).alias(new) for new, old in shown.items()])
