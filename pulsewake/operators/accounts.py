"""Account slices: follower bands and timelines beside events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewake.operators.ordering import next_event
from pulsewake.operators.relational import by_accounts, keep_first
from pulsewake.operators.stats import exact_percentiles
from pulsewake.runtime import cut_lineage


def follower_band(
    accounts: DataFrame, account: str, followers: str, low: float = 0.5, high: float = 0.75, tie: Sequence[str] = ()
) -> DataFrame:
    """Accounts between two quantiles of the follower count, bounds cut to whole numbers and inclusive.

    Quantiles are taken over distinct accounts; largest first.
    """
    unique = cut_lineage(keep_first(accounts.distinct(), [account], [followers, *tie]))
    marks = exact_percentiles(unique, followers, [low, high])
    bounds = marks.agg(F.min("value").cast("bigint").alias("low"), F.max("value").cast("bigint").alias("high"))
    inside = F.col(followers).between(bounds.select("low").scalar(), bounds.select("high").scalar())
    return unique.where(inside).orderBy(F.desc(followers), account)


def account_timeline(
    posts: DataFrame, events: DataFrame, account: str, ts: str, event_ts: str, accounts: Sequence[str]
) -> DataFrame:
    """Posts of the named accounts, each with the next event and the minutes until it."""
    named = by_accounts(posts.select(account, ts), account, accounts)
    near = next_event(named, events.select(event_ts), ts, event_ts)
    seconds = F.unix_micros(F.col(f"next_{event_ts}").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return near.withColumn("minutes_to_event", seconds / 60_000_000)
