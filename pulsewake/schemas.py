"""Declared schemas; nothing in the library infers a schema in production reads.

Fixed values: the column names and types of this module must equal those of the stored data.
"""

from pyspark.sql import types as T

_STRING, _INT, _LONG, _DOUBLE, _TIME = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POSTS = _struct(
    tweet_id=_STRING, twitter_handle_name=_STRING, twitter_handle_id=_STRING, tweet_datetime=_TIME,
    twitter_handle_desc=_STRING, followers_count=_INT, friends_count=_INT, listed_count=_INT,
    created_at_datetime=_TIME, twitter_datetime_hour=_TIME, statuses_count=_INT, tweet=_STRING,
    truncated=T.BooleanType(),
)

RAW_POSTS = _struct(
    id_str=_STRING, created_at=_STRING, text=_STRING, truncated=T.BooleanType(),
    retweeted_status=_struct(id_str=_STRING),
    user=_struct(
        id_str=_STRING, name=_STRING, screen_name=_STRING, description=_STRING, created_at=_STRING,
        followers_count=_INT, friends_count=_INT, listed_count=_INT, statuses_count=_INT,
    ),
)

ACCOUNTS = _struct(
    twitter_handle_name=_STRING, twitter_handle_id=_STRING, twitter_handle_desc=_STRING,
    followers_count=T.FloatType(), friends_count=T.FloatType(),
)

FOLLOWER_PAGE = _struct(ids=T.ArrayType(_LONG), next_cursor=_LONG)

PRICES = _struct(time=_TIME, open=_DOUBLE, close=_DOUBLE, high=_DOUBLE, low=_DOUBLE, volume=_DOUBLE, id_date=_INT)

ARTICLES = _struct(
    authors=T.ArrayType(_STRING), date_download=_STRING, date_modify=_STRING, date_publish=_STRING,
    description=_STRING, filename=_STRING, image_url=_STRING, language=_STRING, localpath=_STRING,
    source_domain=_STRING, maintext=_STRING, title=_STRING, title_page=_STRING, title_rss=_STRING, url=_STRING,
)

CORPUS_COLUMNS = [
    "authors", "date_download", "date_publish", "description", "filename",
    "language", "maintext", "source_domain", "title", "url",
]

EDGES = _struct(src=_STRING, dst=_STRING, weight=_STRING)

ARCHIVE_RECORDS = _struct(url=_STRING, download_date=_STRING, content_type=_STRING, payload=T.BinaryType())
