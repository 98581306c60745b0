"""Golden windows: which window, if any, a publication falls into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewake.runtime import scratch_path


def ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def golden_windows(events: Sequence[str], minutes: int) -> list[tuple[Column, Column]]:
    """Windows ``[event - minutes, event]``, folded to constants by the optimizer."""
    return [(ntz(e) - F.expr(f"INTERVAL {int(minutes)} MINUTES"), ntz(e)) for e in events]


def window_number(ts: Column, windows: Sequence[tuple[Column, Column]]) -> Column:
    """1-based number of the first window that holds ``ts`` (ends inclusive), 0 when none does.

    For a window list the caller wrote down: no join, no shuffle.
    """
    chosen = F.lit(0)
    for number, (start, end) in reversed(list(enumerate(windows, 1))):
        chosen = F.when(ts.between(start, end), F.lit(number)).otherwise(chosen)
    return chosen


def in_any_window(ts: Column, windows: Sequence[tuple[Column, Column]]) -> Column:
    return F.when(window_number(ts, windows) > 0, 1).otherwise(0)


def windows_from_events(events: DataFrame, event_ts: str, minutes: int, window_id: str = "window_id") -> DataFrame:
    """Window table from an event table."""
    return events.select(
        window_id,
        (F.col(event_ts) - F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("start"),
        F.col(event_ts).alias("end"),
    )


#: A cell of a level is 2 ** BITS cells of the level below. The narrowest is a microsecond, the widest longer than the calendar.
BITS = 3
LEVELS = range(0, 60, BITS)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _shifted(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number, level)


def _each_level() -> Column:
    return F.explode(F.array(*[F.lit(level) for level in LEVELS]))


def dyadic_cells(windows: DataFrame, first: str = "start", last: str = "end") -> DataFrame:
    """Each window once per ``level`` and ``cell`` of the aligned cells that make it up, both ends included.

    A cell holds the microseconds that give its number when shifted right by ``level``. Of each level a window takes the whole
    cells that no wider one covers, fewer than 2 ** (BITS + 1), so the number of cells grows with the logarithm of its length. A window
    without an end, or that ends before it starts, has none.
    """
    def whole(level: Column) -> tuple[Column, Column]:
        """The cells of a level that lie within: from the first up to, not including, the second."""
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        return _shifted(F.col("_first") + width - 1, level), _shifted(F.col("_last") + 1, level)

    def span(begin: Column, end: Column) -> Column:
        return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))

    timed = windows.withColumns({"_first": _micros(F.col(first)), "_last": _micros(F.col(last))}).where("_first <= _last")
    borders = timed.withColumn("level", _each_level())
    left, right = whole(F.col("level"))
    inner, outer = whole(F.col("level") + BITS)
    borders = borders.withColumns({"_left": left, "_right": right, "_inner": inner * 2**BITS, "_outer": outer * 2**BITS})
    split = F.concat(span(F.col("_left"), F.col("_inner")), span(F.col("_outer"), F.col("_right")))
    cells = F.when(F.col("_inner") < F.col("_outer"), split).otherwise(span(F.col("_left"), F.col("_right")))
    return borders.withColumn("cell", F.explode(cells)).drop("_first", "_last", "_left", "_right", "_inner", "_outer")


def tag_with_windows(pubs: DataFrame, windows: DataFrame, ts: str, row_id: str) -> DataFrame:
    """Range join for any number of windows, also overlapping ones: lowest ``window_id`` wins, 0 when none.

    An index keeps the lowest window of every cell of :func:`dyadic_cells`. A publication looks at the one cell of each level that
    holds it, of the levels that occur, so it never meets the windows one by one, however many overlap and however long they are.
    The index is written when the join is stated.
    A time of null is in no window.
    """
    spark = pubs.sparkSession
    lowest = dyadic_cells(windows.select("window_id", "start", "end")).groupBy("level", "cell").agg(F.min("window_id").alias("_lowest"))
    # written, so that the join is chosen by the size of the cells, which Spark would guess from that of the windows
    path = scratch_path(spark, "windows")
    lowest.write.parquet(path)
    index = spark.read.schema(lowest.schema).parquet(path)
    levels = index.agg(F.collect_set("level")).scalar()
    looked = pubs.select(row_id, _micros(F.col(ts)).alias("_at"), _each_level().alias("level")).where(F.array_contains(levels, F.col("level")))
    found = looked.select(row_id, "level", _shifted(F.col("_at"), F.col("level")).alias("cell")).join(index, ["level", "cell"])
    hits = found.groupBy(row_id).agg(F.min("_lowest").alias("golden_window"))
    return pubs.join(hits, row_id, "left").fillna({"golden_window": 0})


def busy_hours(posts: DataFrame, ts: str, rows_per_task: int) -> DataFrame:
    """``(hour, salts)`` of every hour with more than ``rows_per_task`` posts: as many salts as tasks of that size.

    One aggregate that combines on the map side, written as a table, so that joins know its size. It has at most one row for each
    ``rows_per_task`` posts.
    """
    spark = posts.sparkSession
    hours = posts.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.count("*").alias("n"))
    busy = hours.where((F.col("n") > rows_per_task) & F.col("hour").isNotNull()).select("hour", F.ceil(F.col("n") / rows_per_task).cast("int").alias("salts"))
    path = scratch_path(spark, "busy")
    busy.write.parquet(path)
    return spark.read.schema(busy.schema).parquet(path)


def pairs_within(
    posts: DataFrame, events: DataFrame, ts: str, event_ts: str, minutes: int, salts: int = 1, busy: DataFrame | None = None
) -> DataFrame:
    """Posts at most ``minutes`` before an event, beside it; batch or stream.

    The hour is the equality key: an event is listed under every hour its window touches. All rows of an hour would be
    one task, so the posts of an hour are spread over its salts, by a hash of their columns, and the events that touch it repeated for
    each. The table ``busy`` (see :func:`busy_hours`) says how many; an hour that it does not have takes ``salts``. Streams
    may use the table of an earlier day or of what has arrived: it steers the work, not the result, but has to stay the same
    for the life of a query.
    """
    reach = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    left = posts.withColumn("_hour", F.date_trunc("hour", F.col(ts)))
    hours = F.sequence(F.date_trunc("hour", F.col(event_ts) - reach), F.date_trunc("hour", F.col(event_ts)), F.expr("INTERVAL 1 HOUR"))
    right = events.withColumn("_event_hour", F.explode(hours))
    number = F.lit(salts)
    if busy is not None:
        known = busy.select(F.col("hour").alias("_busy_hour"), F.col("salts").alias("_salts"))
        left = left.join(known, F.col("_hour") == F.col("_busy_hour"), "left")
        right = right.join(known, F.col("_event_hour") == F.col("_busy_hour"), "left")
        number = F.coalesce("_salts", F.lit(salts))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*posts.columns), number).cast("int")).drop("_busy_hour", "_salts")
    right = right.withColumn("_event_salt", F.explode(F.sequence(F.lit(0), number - 1))).drop("_busy_hour", "_salts")
    near = (F.col(ts) >= F.col(event_ts) - reach) & (F.col(ts) <= F.col(event_ts))
    on = (F.col("_hour") == F.col("_event_hour")) & (F.col("_salt") == F.col("_event_salt")) & near
    return left.join(right, on).drop("_hour", "_event_hour", "_salt", "_event_salt")
