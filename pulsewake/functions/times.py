"""Time expressions. Every function takes and returns Columns and stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that a written date may hold besides its month.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
ZONES = ["z", "utc", "gmt", "est", "edt", "cst", "cdt", "mst", "mdt", "pst", "pdt", "wet", "west", "bst", "cet", "cest", "eet", "eest", "msk", "ist", "jst"]
FILLERS = ["at", "on", "of", "and", "t", "st", "nd", "rd", "th"]

_MONTH_WORDS = "|".join([*MONTHS, *(m[:3] for m in MONTHS), "sept"])
_OTHER_WORDS = "|".join([*WEEKDAYS, *(d[:3] for d in WEEKDAYS), "tues", "wednes", "thur", "thurs", "satur", *ZONES, *FILLERS])
_MONTH = rf"(?<![a-z])({_MONTH_WORDS})(?![a-z])"
_KNOWN = rf"^(?:(?<![a-z])(?:{_MONTH_WORDS}|{_OTHER_WORDS})(?![a-z])|[0-9\s,./-])*+$"
_HALF = r"\s*([ap])\.?m\b\.?"
#: Hour, minute, second and half of the day, with fraction and zone behind; or an hour and a half of the day
CLOCK = (rf"(?:^|[\s,t])(?:(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?(?:{_HALF})?(?:\s*(?:{'|'.join(ZONES)})\b)?(?:\s*[+-]\d{{2}}:?\d{{2}}\b)?"
         rf"|(\d{{1,2}}){_HALF})")


def parse_post_time(text: Column) -> Column:
    """``Wed May 26 07:21:12 +0000 2021`` to a timestamp; null where the text has another form.

    The weekday is cut off before parsing: it is redundant, and the parser has no letter for it.
    """
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit("MMM d H:mm:ss Z yyyy"))


# The clock of the text: its parts are empty where it has none.
_CLOCK_SQL = ", ".join([f"if(w = '', t, regexp_replace(t, r'{CLOCK}', ' ')) AS rest", *[
    f"concat(regexp_extract(w, r'{CLOCK}', {i}), regexp_extract(w, r'{CLOCK}', {j})) AS {c}" if j else f"regexp_extract(w, r'{CLOCK}', {i}) AS {c}"
    for c, i, j in (("hour", 1, 5), ("minute", 2, 0), ("second", 3, 0), ("half", 4, 6))]])

_WORDS_SQL = rf"c.rest RLIKE r'{_KNOWN}' AS known, regexp_extract_all(c.rest, r'\d+', 0) AS n, regexp_extract_all(c.rest, r'{_MONTH}', 1) AS months"
_HOUR = "if(c.hour = '', 0, CAST(c.hour AS INT))"
_FOUND_SQL = f"""x.known AND (c.half = '' OR {_HOUR} BETWEEN 0 AND 12) AS known, size(x.n) AS n, size(x.months) AS months,
  CAST(ceil(instr('{"".join(m[:3] for m in MONTHS)}', substring(get(x.months, 0), 1, 3)) / 3) AS STRING) AS named,
  get(x.n, 0) AS a, get(x.n, 1) AS b, get(x.n, 2) AS c, concat(get(x.n, 0), coalesce(get(x.n, 1), '')) AS digits,
  concat_ws(':', lpad(CAST(if(c.half = '', {_HOUR}, {_HOUR} % 12 + if(c.half = 'p', 12, 0)) AS STRING), 2, '0'), lpad(c.minute, 2, '0'), lpad(c.second, 2, '0')) AS time"""


def _full(year: str) -> str:
    return f"CASE length({year}) WHEN 4 THEN {year} WHEN 2 THEN concat(if({year} < '70', '20', '19'), {year}) END"


def _row(year: str, month: str, day: str) -> str:
    return f"concat({year}, '-', lpad({month}, 2, '0'), '-', lpad({day}, 2, '0'), ' ', f.time)"


_PACKED = """concat(substring(f.digits, 1, 4), '-', substring(f.digits, 5, 2), '-', substring(f.digits, 7, 2), ' ',
  if(length(f.digits) = 8, f.time, concat_ws(':', substring(f.digits, 9, 2), substring(f.digits, 11, 2), lpad(substring(f.digits, 13, 2), 2, '0'))))"""

# The decision table: which number is the day, the month, the year. With a named month there are two more, and the year is the one
# that can't be a day, else the second. Of three the year is the first if it has four digits, else the last; month before day,
# unless it can't be a month. One or two long numbers are digits without separators.
_DATE_SQL = f"""CASE WHEN NOT f.known THEN NULL
  WHEN f.months = 1 AND f.n = 2 AND length(f.b) <= 2 AND (length(f.a) = 4 OR (length(f.a) = 2 AND f.a > '31')) THEN {_row(_full('f.a'), 'f.named', 'f.b')}
  WHEN f.months = 1 AND f.n = 2 AND length(f.a) <= 2 THEN {_row(_full('f.b'), 'f.named', 'f.a')}
  WHEN f.months = 0 AND f.n = 3 AND length(f.a) = 4 AND length(f.b) <= 2 AND length(f.c) <= 2 THEN
    if(lpad(f.b, 2, '0') > '12', {_row('f.a', 'f.c', 'f.b')}, {_row('f.a', 'f.b', 'f.c')})
  WHEN f.months = 0 AND f.n = 3 AND length(f.a) <= 2 AND length(f.b) <= 2 THEN
    if(lpad(f.a, 2, '0') > '12', {_row(_full('f.c'), 'f.b', 'f.a')}, {_row(_full('f.c'), 'f.a', 'f.b')})
  WHEN f.months = 0 AND ((f.n = 1 AND length(f.a) IN (8, 12, 14)) OR (f.n = 2 AND length(f.a) = 8 AND length(f.b) IN (4, 6))) THEN {_PACKED} END"""

_READ_SQL = f"""t -> get(transform(transform(array(regexp_extract(t, r'{CLOCK}', 0)), w -> struct({_CLOCK_SQL})), c ->
  get(transform(transform(array(struct({_WORDS_SQL})), x -> struct({_FOUND_SQL})), f -> try_cast({_DATE_SQL} AS TIMESTAMP_NTZ)), 0)), 0)"""


def parse_wall_time(text: Column) -> Column:
    """Free-form date text to a timestamp without zone; the written wall time is kept.

    The text falls into a clock, words and numbers. Words must be known: at most one month, weekdays, zones, ordinal endings and a
    few fillers. What the numbers are is read off a small table. Null for any other text, a date without its day, or one
    that doesn't exist. The whole is one SQL lambda: as many column calls would take longer than the work.
    """
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.get(F.call_function("transform", F.array(plain), F.expr(_READ_SQL)), F.lit(0))


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def shift_zone(ts: Column, source: str, target: str) -> Column:
    """Wall time in ``source`` to wall time in ``target`` (timestamp without zone)."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def date_key(ts: Column) -> Column:
    """Integer ``yyyyMMdd``."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def bucket_start(ts: Column, every: str) -> Column:
    """Start of the tumbling bucket; keeps the timestamp type, null times fall out."""
    return F.window(ts, every).start


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def minutes_before(ts: Column, minutes: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def local_text_to_epoch(text: Column, zone: str, form: str = "yyyy-MM-dd HH:mm") -> Column:
    """Epoch seconds of a wall time written in ``zone``."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(form)), zone))


def local_day(ts: Column, zone: str, shift_days: int = 0) -> Column:
    """Calendar day in ``zone``; ``shift_days=-1`` is yesterday."""
    return F.date_add(shift_zone(ts, "UTC", zone).cast("date"), shift_days)


def day_bounds_text(first: Column, last: Column) -> Column:
    """``{start: 'yyyy-MM-dd 00:00', stop: 'yyyy-MM-dd 00:00'}`` of two days."""
    return F.struct(
        F.concat(first.cast("string"), F.lit(" 00:00")).alias("start"),
        F.concat(last.cast("string"), F.lit(" 00:00")).alias("stop"),
    )


def day_steps(first: Column, last: Column) -> Column:
    """Array of half-open day ranges ``{since, until}`` from ``first`` to ``last``."""
    days = F.sequence(first, F.date_sub(last, 1), F.expr("INTERVAL 1 DAY"))
    return F.transform(days, lambda d: F.struct(d.alias("since"), F.date_add(d, 1).alias("until")))


def label_slice(ts: Column, first: str | None, last: str | None, unit: str = "MINUTE") -> Column:
    """Time-label slice: both ends inclusive, the end label covers its whole ``unit``."""
    condition = F.lit(True)
    if first is not None:
        condition = condition & (ts >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        condition = condition & (ts < F.lit(last).cast("timestamp_ntz") + F.expr(f"INTERVAL 1 {unit}"))
    return condition
