"""From raw nested post JSON to flat post tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsewake.functions.times import parse_post_time, shift_zone

# Columns of the post tables, by the field of the raw post that fills them.
TEXT_FIELDS = {
    "tweet_id": "id_str",
    "twitter_handle_id": "user.id_str",
    "twitter_handle_desc": "user.description",
    "tweet": "text",
    "truncated": "truncated",
}
COUNT_FIELDS = {
    "followers_count": "user.followers_count",
    "friends_count": "user.friends_count",
    "listed_count": "user.listed_count",
    "statuses_count": "user.statuses_count",
}
NAME_FIELD = "user.name"
HANDLE_FIELD = "user.screen_name"
POST_TIME_FIELD = "created_at"
ACCOUNT_TIME_FIELD = "user.created_at"


def is_original() -> Column:
    """True for posts that repeat no other."""
    return F.col("retweeted_status").isNull()


def _fields(name: str, counts_as_text: bool = False) -> list[Column]:
    """The columns that every post table has; ``name`` is the field of the account's name."""
    counts = {c: F.col(f).cast("string") if counts_as_text else F.col(f) for c, f in COUNT_FIELDS.items()}
    return [F.col(name).alias("twitter_handle_name"), *(F.col(f).alias(c) for c, f in TEXT_FIELDS.items()), *(v.alias(c) for c, v in counts.items())]


def flatten_posts(raw: DataFrame) -> DataFrame:
    """Original posts with their times as written."""
    times = [F.col(POST_TIME_FIELD).alias("tweet_datetime"), F.col(ACCOUNT_TIME_FIELD).alias("user_created_at")]
    return raw.where(is_original()).select(*_fields(NAME_FIELD), *times)


def cleanse_posts(raw: DataFrame, counts_as_text: bool = False) -> DataFrame:
    """Original posts with both times read and the hour of the post. Narrow: one scan, no shuffle, also on a stream."""
    posted = parse_post_time(F.col(POST_TIME_FIELD))
    return raw.where(is_original()).select(
        *_fields(NAME_FIELD, counts_as_text),
        posted.alias("tweet_datetime_timestamp"),
        parse_post_time(F.col(ACCOUNT_TIME_FIELD)).alias("created_at_timestamp"),
        F.date_trunc("hour", posted).alias("twitter_datetime_hour"),
    )


def searched_posts_to_rows(raw: DataFrame, zone: str = "Asia/Singapore") -> DataFrame:
    """Posts of the search service as the 13-column warehouse row; post time in ``zone``, account time as written."""
    local = shift_zone(parse_post_time(F.col(POST_TIME_FIELD)), "UTC", zone)
    return raw.select(
        *_fields(HANDLE_FIELD),
        local.alias("tweet_datetime"),
        parse_post_time(F.col(ACCOUNT_TIME_FIELD)).cast("timestamp_ntz").alias("created_at_datetime"),
        F.date_trunc("hour", local).cast("timestamp_ntz").alias("twitter_datetime_hour"),
    )
