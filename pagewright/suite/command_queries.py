"""Command log and questions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright import rules
from pagewright.functions import classify, intents
from pagewright.functions.text import escape_unprintable
from pagewright.operators import command_log
from pagewright.plans import render
from pagewright.session import new_folder
from pagewright.sources.files import log_pieces
from pagewright.sources.tables import table
from pagewright.suite import checks as c
from pagewright.suite.inputs import derived, given, sql

DAY = "2024-01-15"


def log_parse(spark, folder):
    """Events written as latin-1 log files, then read in byte ranges and parsed like delivered files."""
    fields = derived(spark, folder, "log_fields")
    line = F.concat(F.concat_ws(" | ", *command_log.FIELDS), F.lit(" |"))
    # the writer ends every row with a line feed
    ends = F.element_at(F.array(F.lit(""), F.lit("\r"), F.lit("\x0c"), F.lit("\x85")), (F.col("event_id") % 4 + 1).cast("int"))
    path = new_folder(spark, "log")
    fields.select(F.encode(F.concat(line, ends), "ISO-8859-1").cast("string").alias("value")).write.text(path)
    lines = log_pieces(spark, path, "TCH")
    rows = command_log.parse_log(lines, F.col("line"))
    return rows.select("record_id", *command_log.FIELDS, "date", "time", "milliseconds", "subsystem", "text")


_DATA = ("trim(replace(replace(command_data, chr(7), '\\x07'), chr(233), '\\xe9'))")
_DAY_OF = "replace(substring(command_time, 1, 10), ' ', '-')"
_SUB = "CASE substring(cid, 1, 4) WHEN 'OBCS' THEN 'OBC' WHEN 'TTCS' THEN 'TTC_XBAND' WHEN 'PLDA' THEN 'PAYLOAD' " \
       "WHEN 'DTGS' THEN 'DTG' ELSE 'UNKNOWN' END"

LOG_PARSE_SQL = f"""
SELECT 'TCH_' || sl_no AS record_id, sl_no, code, cid, mnemonic, command_time, {_DATA} AS command_data, data_cmd_value,
       orbit_no, status, source_station, dest_station, {_DAY_OF} AS date, substring(command_time, 12, 8) AS time,
       substring(command_time, 21, 3) AS milliseconds, {_SUB} AS subsystem,
       'Command ' || mnemonic || ' (CID: ' || cid || ') was uplinked on ' || {_DAY_OF} || ' at '
       || substring(command_time, 12, 8) || ' UTC from ' || source_station || ' to ' || dest_station
       || '. Orbit number: ' || orbit_no || '. Status: ' || status || '. Subsystem: ' || {_SUB} || '.' AS text
FROM {sql('log_fields')} WHERE length(sl_no) = 4"""


def _day_commands(spark, folder):
    """The day's commands; the day also bounds the time stamp, which the scan can use to skip row groups."""
    ts = F.col("ts")
    start = F.lit(DAY).cast("timestamp_ntz")
    events = table(spark, folder, "events").where((ts >= start) & (ts < start + F.expr("INTERVAL 1 DAY")))
    return derived(spark, folder, "commands", events=events)


def log_by_date(spark, folder):
    return command_log.on_day(_day_commands(spark, folder), DAY)


_DAY_ROWS = f"""SELECT *, row_number() OVER (ORDER BY time, ord) AS nth FROM {sql('commands')} WHERE date = '{DAY}'"""


def log_date_counts(spark, folder):
    commands = _day_commands(spark, folder)
    place = F.row_number().over(W.orderBy(F.col("n").desc(), "first")).alias("place")     # one row a value of the day
    by = [command_log.counted(commands, name).select(F.lit(name).alias("kind"), F.col(name).alias("value"), "n", place)
          for name in ("subsystem", "mnemonic")]
    return by[0].unionByName(by[1])


def log_counts_by_day(spark, folder):
    """Every day's commands per subsystem with the first one's position, for tie order."""
    return derived(spark, folder, "commands").groupBy("date", "subsystem").agg(
        F.count("*").alias("n"), F.min(F.struct("time", "ord")).alias("first")).select(
        "date", "subsystem", "n", F.col("first.ord").alias("first_ord"))


def log_top_mnemonics(spark, folder):
    return command_log.counter(derived(spark, folder, "commands"), "mnemonic").limit(5)


def log_command_table(spark, folder):
    return command_log.table_view(log_by_date(spark, folder))


def log_day_lines(spark, folder):
    return render.day_lines(log_by_date(spark, folder)).select(F.col("nth").cast("bigint").alias("nth"), "line")


def log_escape_bytes(spark, folder):
    return given(spark, folder, "documents").select("doc_id", escape_unprintable(F.col("text")).alias("escaped"))


_ESCAPED = ("array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda ch: CASE WHEN "
            "regexp_matches(ch, '[^\\x20-\\x7e]') THEN '\\x' || printf('%02x', unicode(ch)) ELSE ch END), '')")


def route_questions(spark, folder):
    return derived(spark, folder, "questions").select("qid", intents.route(F.col("question")).alias("route"))


_ROUTE = "CASE WHEN " + " OR ".join(
    [c.has("question", rules.QUESTION_DATE)] + [c.has("question", p) for p in rules.LOG_QUESTION_EXACT]
    + [c.has("question", p, True) for p in rules.LOG_QUESTION_ANY_CASE]) + " THEN 'commands' ELSE 'knowledge' END"


def question_dates(spark, folder):
    return derived(spark, folder, "questions").select("qid", intents.question_date(F.col("question")).alias("day"))


_DATE_RE = c.quoted(c.spelled(rules.QUESTION_DATE))
_DATE = (f"CASE WHEN {c.has('question', rules.QUESTION_DATE)} THEN regexp_extract(question, {_DATE_RE}, 1) || '-' || "
         f"regexp_extract(question, {_DATE_RE}, 2) || '-' || regexp_extract(question, {_DATE_RE}, 3) END")


def question_intents(spark, folder):
    q = F.col("question")
    return derived(spark, folder, "questions").select(
        "qid", intents.wants_image(q).cast("int").alias("image"), intents.wants_procedure(q).cast("int").alias("procedure"))


def question_subsystems(spark, folder):
    return derived(spark, folder, "questions").select(
        "qid", classify.question_subsystem(F.col("question")).alias("subsystem"))


def conversation_routes(spark, folder):
    """Turns of real conversations, whole texts, through every question rule."""
    q = F.col("text")
    return given(spark, folder, "conversations").select(
        "conv_id", "turn", intents.route(q).alias("route"), intents.question_date(q).alias("day"),
        intents.wants_image(q).cast("int").alias("image"), intents.wants_procedure(q).cast("int").alias("procedure"))


QUERIES = {
    "log_by_date": (log_by_date, _DAY_ROWS),
    "log_parse": (log_parse, LOG_PARSE_SQL),
    "log_date_counts": (log_date_counts, f"""WITH d AS ({_DAY_ROWS})
        SELECT 'subsystem' AS kind, subsystem AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, min((time, ord)))::INT AS place FROM d GROUP BY subsystem
        UNION ALL SELECT 'mnemonic', mnemonic, count(*), row_number() OVER (ORDER BY count(*) DESC, min((time, ord)))::INT
            FROM d GROUP BY mnemonic"""),
    "log_counts_by_day": (log_counts_by_day, f"""SELECT date, subsystem, count(*) AS n,
        arg_min(ord, (time, ord)) AS first_ord FROM {sql('commands')} GROUP BY ALL"""),
    "log_top_mnemonics": (log_top_mnemonics, f"""SELECT mnemonic, count(*) AS n FROM {sql('commands')}
        GROUP BY mnemonic ORDER BY n DESC, min((time, ord)) LIMIT 5"""),
    "log_command_table": (log_command_table, f"""SELECT time AS "Time", cid AS "CID", mnemonic AS "Mnemonic",
        orbit_no AS "Orbit", status AS "Status", source_station AS "From", dest_station AS "To",
        subsystem AS "Subsystem" FROM ({_DAY_ROWS})"""),
    "log_day_lines": (log_day_lines, f"""SELECT nth, rpad(nth::VARCHAR, greatest(4, length(nth::VARCHAR))::INT, ' ')
        || '  ' || rpad(time, greatest(10, length(time))::INT, ' ')
        || '  ' || rpad(cid, greatest(14, length(cid))::INT, ' ')
        || '  ' || rpad(mnemonic, greatest(40, length(mnemonic))::INT, ' ')
        || '  ' || rpad(orbit_no, greatest(7, length(orbit_no))::INT, ' ') || '  ' || status AS line
        FROM ({_DAY_ROWS})"""),
    "log_escape_bytes": (log_escape_bytes, f"SELECT doc_id, {_ESCAPED} AS escaped FROM documents"),
    "route_questions": (route_questions, f"SELECT qid, {_ROUTE} AS route FROM {sql('questions')}"),
    "question_dates": (question_dates, f"SELECT qid, {_DATE} AS day FROM {sql('questions')}"),
    "question_intents": (question_intents, f"""SELECT qid, {c.has('question', rules.IMAGE_INTENT, True)}::INT AS image,
        {c.has('question', rules.PROCEDURE_INTENT, True)}::INT AS procedure FROM {sql('questions')}"""),
    "question_subsystems": (question_subsystems, f"""SELECT qid,
        {c.keyword_case('question', rules.QUESTION_KEYWORDS)} AS subsystem FROM {sql('questions')}"""),
    "conversation_routes": (conversation_routes, f"""SELECT conv_id, turn, {_ROUTE} AS route, {_DATE} AS day,
        {c.has('question', rules.IMAGE_INTENT, True)}::INT AS image,
        {c.has('question', rules.PROCEDURE_INTENT, True)}::INT AS procedure
        FROM (SELECT conv_id, turn, text AS question FROM conversations)"""),
}
