"""Influence score: how often an agent speaks shortly before the events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewake.operators.ordering import next_event
from pulsewake.operators.windows import golden_windows, ntz, window_number
from pulsewake.runtime import cut_lineage

SCORE_COLUMNS = [
    "total_nbr_publish", "total_nbr_publish_in_golden_window", "nbr_golden_window_hit", "wtf",
]


def _in_period(pubs: DataFrame, ts: str, period: tuple[str, str]) -> DataFrame:
    return pubs.where(F.col(ts).between(ntz(period[0]), ntz(period[1])))


def sample_with_windows(pubs: DataFrame, ts: str, period: tuple[str, str], events: Sequence[str], minutes: int) -> DataFrame:
    """Publications of the period with the window flag and the window number."""
    number = window_number(F.col(ts), golden_windows(events, minutes))
    return _in_period(pubs, ts, period).withColumns({
        "publish_in_golden_window": F.when(number > 0, 1).otherwise(0),
        "golden_window": number,
    })


def _with_score(totals: DataFrame, number_of_events) -> DataFrame:
    share = F.col("total_nbr_publish_in_golden_window") / F.col("total_nbr_publish")
    return totals.withColumn("wtf", share * F.try_divide(F.col("nbr_golden_window_hit"), number_of_events))


def _score_few_windows(tagged: DataFrame, keys: Sequence[str], windows: int) -> DataFrame:
    """One aggregation with one shuffle, in place of three aggregates and two joins.

    The windows an agent hits are bits of a long, so counting distinct ones needs no second shuffle and a
    loud agent sends one partial row per task.
    """
    if windows > 63:
        return _score_any_windows(tagged, keys, F.lit(windows))
    hit = F.col("golden_window") != 0
    bit = F.expr("shiftleft(1L, golden_window - 1)")
    totals = tagged.groupBy(*keys).agg(
        F.count("*").alias("total_nbr_publish"),
        F.count_if(hit).alias("total_nbr_publish_in_golden_window"),
        F.bit_count(F.coalesce(F.bit_or(F.when(hit, bit)), F.lit(0))).cast("bigint").alias("nbr_golden_window_hit"),
    )
    return _with_score(totals, F.lit(windows))


def _score_any_windows(tagged: DataFrame, keys: Sequence[str], number_of_events) -> DataFrame:
    """Two levels: (agent, window) combines on the map side, the second level only adds those up."""
    per_window = tagged.groupBy(*keys, "golden_window").agg(F.count("*").alias("_n"))
    hit = F.col("golden_window") != 0
    totals = per_window.groupBy(*keys).agg(
        F.sum("_n").alias("total_nbr_publish"),
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("total_nbr_publish_in_golden_window"),
        F.count_if(hit).alias("nbr_golden_window_hit"),
    )
    return _with_score(totals, number_of_events)


def influence_score(
    pubs: DataFrame, agent: str, ts: str, period: tuple[str, str], events: Sequence[str], minutes: int
) -> DataFrame:
    """Score per agent for an event list the caller wrote down. Best agents first, agent breaks ties."""
    number = window_number(F.col(ts), golden_windows(events, minutes))
    tagged = _in_period(pubs, ts, period).select(agent, number.alias("golden_window"))
    scored = _score_few_windows(tagged, [agent], len(events))
    return scored.select(agent, *SCORE_COLUMNS).orderBy(F.desc("wtf"), agent)


def influence_by_bandwidth(
    pubs: DataFrame, agent: str, ts: str, period: tuple[str, str], events: Sequence[str], bandwidths: Sequence[int]
) -> DataFrame:
    """Scores for several bandwidths from one scan."""
    tags = F.array(*[
        F.struct(F.lit(m).alias("bandwidth_before_event_mins"),
                 window_number(F.col(ts), golden_windows(events, m)).alias("golden_window"))
        for m in bandwidths
    ])
    tagged = _in_period(pubs, ts, period).select(agent, F.inline(tags))
    scored = _score_few_windows(tagged, [agent, "bandwidth_before_event_mins"], len(events))
    return scored.select(agent, *SCORE_COLUMNS, "bandwidth_before_event_mins")


def influence_of_events(
    pubs: DataFrame, events: DataFrame, agent: str, ts: str, event_ts: str, period: tuple[str, str], minutes: int
) -> DataFrame:
    """Score against an event *table* of any size, such as the output of a shock detection.

    A publication lies in the window of the first event at or after it when that event is at most
    ``minutes`` away, so one as-of join replaces the window list.
    """
    moments = cut_lineage(events.select(event_ts).distinct())  # read several times below
    sample = _in_period(pubs.select(agent, ts), ts, period)
    near = next_event(sample, moments, ts, event_ts)
    following = F.col(f"next_{event_ts}")
    inside = F.col(ts) >= following - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    tagged = near.select(agent, F.when(inside, F.unix_micros(following.cast("timestamp"))).otherwise(F.lit(0)).alias("golden_window"))
    total = moments.agg(F.count("*").alias("n")).scalar()
    return _score_any_windows(tagged, [agent], total).select(agent, *SCORE_COLUMNS)


def with_display_name(scores: DataFrame, names: DataFrame, agent: str, name: str) -> DataFrame:
    """Attach the display name, name column first, sorted once at the very end."""
    joined = scores.join(names.select(agent, name), agent, "left")
    return joined.select(name, *scores.columns).orderBy(F.desc("wtf"), agent)
