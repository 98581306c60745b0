"""De-duplication, filters, projections and look-ups shared by all pipelines."""

from __future__ import annotations

import re

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewake import schemas
from pulsewake.functions.let import let
from pulsewake.functions.text import normalise_null
from pulsewake.functions.times import parse_wall_time


# -- distinct -----------------------------------------------------------------------------------------


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    """One whole row per key through a combinable aggregate.

    ``min_by``/``max_by`` reduce on the map side, so a key that holds a third of all rows still sends
    one row per input task, which a ``row_number`` window would not.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Key distinct: the first row in ``order``. Null keys are equal to each other."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


# -- filters ------------------------------------------------------------------------------------------


def in_languages(languages: Sequence[str], column: str = "language"):
    """A closure for ``df.transform``."""
    return lambda df: df.where(F.col(column).isin(list(languages)))


def any_match(pattern: str, columns: Sequence[str] = ("maintext", "title", "description")) -> Column:
    """True where any of the columns matches; a null column never vetoes a hit in another."""
    hit = F.col(columns[0]).rlike(pattern)
    for column in columns[1:]:
        hit = hit | F.col(column).rlike(pattern)
    return hit


def matches_any(pattern: str, columns: Sequence[str] = ("maintext", "title", "description")):
    return lambda df: df.where(any_match(pattern, columns))


def search_posts(df: DataFrame, words: Sequence[str], language: str, since: str, until: str,
                 text: str = "text", lang: str = "lang", ts: str = "ts", repost: str = "retweeted_status") -> DataFrame:
    """Original posts of a language and a half-open day range that hold one of the words, taken literally, in any case."""
    pattern = "(?i)" + "|".join(re.escape(w) for w in words)
    return df.where(
        F.col(repost).isNull()
        & (F.col(lang) == language)
        & (F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
        & (F.col(ts) < F.lit(until).cast("timestamp_ntz"))
        & F.col(text).rlike(pattern)
    )


def is_from_hosts(url: Column, hosts: Sequence[str], mode: str = "contains") -> Column:
    """``contains``: the host text occurs anywhere in the address. ``host``: host or sub-domain of it."""
    if mode == "contains":
        tests = [url.contains(h) for h in hosts]
    else:
        own = F.lower(F.try_parse_url(url, F.lit("HOST")))
        tests = [(own == h) | own.endswith("." + h) for h in hosts]
    keep = F.lit(False)
    for test in tests:
        keep = keep | test
    return keep


def from_hosts(hosts: Sequence[str], url: str = "url", mode: str = "contains"):
    return lambda df: df.where(is_from_hosts(F.col(url), hosts, mode))


def is_published_between(when: Column, first: str | None, last: str | None, strict: bool = False) -> Column:
    """Inclusive range over a time; no time is inside unless ``strict``."""

    def kept(t: Column) -> Column:
        inside = F.lit(True)
        if first is not None:
            inside = inside & (t >= F.lit(first).cast("timestamp_ntz"))
        if last is not None:
            inside = inside & (t <= F.lit(last).cast("timestamp_ntz"))
        return F.when(t.isNull(), F.lit(not strict)).otherwise(inside)

    return let(when, kept)


def published_between(df: DataFrame, column: str, first: str | None, last: str | None, strict: bool = False) -> DataFrame:
    """Inclusive range over a date text; rows without a readable date stay unless ``strict``."""
    when = parse_wall_time(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.where(is_published_between(when, first, last, strict))


def by_accounts(df: DataFrame, column: str, accounts: Sequence[str]) -> DataFrame:
    return df.where(F.lower(F.col(column)).isin([a.lower() for a in accounts]))


def usable_response(df: DataFrame, status: str = "status", body: str = "html", content_type: str = "content_type",
                    shortest: int = 10, longest: int = 20_000_000) -> DataFrame:
    return df.where(is_usable_response(F.col(status), F.col(body), F.col(content_type), shortest, longest))


def is_usable_response(status: Column, body: Column, content_type: Column, shortest: int = 10, longest: int = 20_000_000) -> Column:
    return (status == 200) & F.length(body).between(shortest, longest) & content_type.startswith("text/html")


# -- projections --------------------------------------------------------------------------------------


def corpus_columns(df: DataFrame) -> DataFrame:
    return df.select(*schemas.CORPUS_COLUMNS)


def clean_nulls(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: normalise_null(F.col(c)) for c in columns})


# Crawl item field -> article field.
ITEM_TO_ARTICLE = {
    "article_author": "authors",
    "download_date": "date_download",
    "modified_date": "date_modify",
    "article_publish_date": "date_publish",
    "article_description": "description",
    "filename": "filename",
    "article_image": "image_url",
    "article_language": "language",
    "local_path": "localpath",
    "article_title": "title",
    "html_title": "title_page",
    "rss_title": "title_rss",
    "source_domain": "source_domain",
    "article_text": "maintext",
    "url": "url",
}


def items_to_articles(df: DataFrame) -> DataFrame:
    """Rename the item fields, turn null markers to null and parse the three dates."""
    kinds = dict(df.dtypes)

    def field(source: str, target: str) -> Column:
        value = normalise_null(F.col(source)) if kinds[source] == "string" else F.col(source)
        return (parse_wall_time(value) if target.startswith("date_") else value).alias(target)

    return df.select(*[field(source, target) for source, target in ITEM_TO_ARTICLE.items()])


def serialisable(df: DataFrame) -> DataFrame:
    """The three article dates as text; a missing date stays null."""
    return df.withColumns({c: F.col(c).cast("string") for c in ("date_download", "date_modify", "date_publish")})


# -- look-ups and anti joins --------------------------------------------------------------------------


def enrich(df: DataFrame, lookup: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left look-up; the last of several entries for one key counts, unmatched rows get nulls."""
    last = keep_last(lookup.select(key, *columns, *[o for o in order if o not in columns]), [key], order)
    return df.join(last.select(key, *columns), key, "left")


def not_yet_done(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return df.join(ledger.select(key), key, "left_anti")


def occurring(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def count_by(df: DataFrame, *keys, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def counts_of_accounts(accounts: DataFrame, posts: DataFrame, name: str = "handle", on: str = "handle") -> DataFrame:
    """Posts per listed account, ignoring case; a listed account without posts shows 0.

    Posts are counted before the join, so a loud account costs one row there.
    """
    counts = posts.groupBy(F.lower(F.col(on)).alias("_key")).agg(F.count("*").alias("_n"))
    return (
        accounts.withColumn("_key", F.lower(F.col(name)))
        .join(counts, "_key", "left")
        .select(name, F.coalesce("_n", F.lit(0)).alias("n_posts"))
    )


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))
