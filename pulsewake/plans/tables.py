"""Projection, filter, distinct, aggregate and join queries."""

from pyspark.sql import functions as F

from pulsewake.functions import text as tx
from pulsewake.operators import accounts as acc
from pulsewake.operators import articles as art
from pulsewake.operators import posts as po
from pulsewake.operators import relational as rel
from pulsewake.operators import stats as st
from pulsewake.operators import timeseries as tsr
from pulsewake.plans.inputs import cte, given, table
from pulsewake.plans.registry import query
from pulsewake.plans.storage import RAW_SQL, raw_posts


def _articles(spark, sf):
    """Articles with an author list in place of the author."""
    return given(spark, sf, "articles").withColumn("authors", F.array("author"))


# -- projections --------------------------------------------------------------------------------------


@query("p01_select", "SELECT event_id, user_id FROM events")
def p01(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id")


@query("p02_nested_projection", RAW_SQL + """
  SELECT id_str AS tweet_id, uname AS twitter_handle_name, uid AS twitter_handle_id, udesc AS twitter_handle_desc,
         strftime(ts, '%a %b %-d %H:%M:%S +0000 %Y') AS tweet_datetime, followers_count, friends_count, listed_count,
         strftime(ts, '%a %b %-d %H:%M:%S +0000 %Y') AS user_created_at, statuses_count, text AS tweet, truncated
  FROM raw WHERE repost IS NULL""")
def p02(spark, sf):
    return po.flatten_posts(raw_posts(spark, sf))


@query("p03_dotted_names", cte("edges") + "SELECT '1' AS weight, src, dst FROM edges")
def p03(spark, sf):
    wide = given(spark, sf, "edges").select(F.lit("1").alias("rel.type"), F.col("src").alias("source.id"), F.col("dst").alias("target.id"))
    return wide.selectExpr("`rel.type` AS weight", "`source.id` AS src", "`target.id` AS dst")


@query("p04_rename", cte("articles") + "SELECT doc_id, date_publish AS date_publish_str FROM articles")
def p04(spark, sf):
    return given(spark, sf, "articles").select("doc_id", "date_publish").withColumnRenamed("date_publish", "date_publish_str")


@query("p06_drop", "SELECT event_id, ts, user_id, event_type FROM events")
def p06(spark, sf):
    return table(spark, sf, "events").drop("value", "props")


def _full_articles(spark, sf):
    stamp = F.lit("2024-02-01 00:00:00")
    return _articles(spark, sf).withColumns({"date_download": stamp, "filename": F.concat(F.col("doc_id").cast("string"), F.lit(".json"))})


@query("p07_corpus_columns", cte("articles") + """
  SELECT author AS authors, '2024-02-01 00:00:00' AS date_download, date_publish, md5(description) AS description, doc_id || '.json' AS filename,
         language, md5(maintext) AS maintext, source_domain, md5(title) AS title, url FROM articles""")
def p07(spark, sf):
    corpus = rel.corpus_columns(_full_articles(spark, sf))
    return corpus.withColumns({"authors": F.array_join("authors", ","), **{c: F.md5(c) for c in ("description", "maintext", "title")}})


def _items(spark, sf):
    a = given(spark, sf, "articles")
    return a.select(
        F.array("author").alias("article_author"), F.lit("2024-02-01T10:20:30Z").alias("download_date"), F.lit("None").alias("modified_date"),
        F.col("date_publish").alias("article_publish_date"), F.col("description").alias("article_description"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("filename"), F.lit("").alias("article_image"),
        F.col("language").alias("article_language"), F.lit("NULL").alias("local_path"), F.col("title").alias("article_title"),
        F.col("title").alias("html_title"), F.lit("NULL").alias("rss_title"), "source_domain", F.col("maintext").alias("article_text"), "url",
    )


_ITEM_SQL = cte("articles") + """SELECT url, author AS authors, {0}, md5(nullif(title, '')) AS title, md5(nullif(description, '')) AS description,
  md5(nullif(maintext, '')) AS maintext, CAST(NULL AS VARCHAR) AS image_url, CAST(NULL AS VARCHAR) AS localpath, language, doc_id || '.json' AS filename FROM articles"""


@query("p08_item_to_article", _ITEM_SQL.format("""TIMESTAMP '2024-02-01 10:20:30' AS date_download, CAST(NULL AS TIMESTAMP) AS date_modify,
  CAST(date_publish AS TIMESTAMP) AS date_publish"""))
def p08(spark, sf):
    df = rel.items_to_articles(_items(spark, sf))
    return df.select(
        "url", F.array_join("authors", ",").alias("authors"), "date_download", "date_modify", "date_publish", F.md5("title").alias("title"),
        F.md5("description").alias("description"), F.md5("maintext").alias("maintext"), "image_url", "localpath", "language", "filename",
    )


@query("p09_serialisable", _ITEM_SQL.format("""'2024-02-01 10:20:30' AS date_download, CAST(NULL AS VARCHAR) AS date_modify,
  date_publish || ' 00:00:00' AS date_publish"""))
def p09(spark, sf):
    return rel.serialisable(p08(spark, sf))


@query("p10_post_row", RAW_SQL + """
  SELECT id_str AS tweet_id, sname AS twitter_handle_name, uid AS twitter_handle_id, date_trunc('second', ts) + INTERVAL 8 HOUR AS tweet_datetime,
         udesc AS twitter_handle_desc, followers_count, friends_count, listed_count, date_trunc('second', ts) AS created_at_datetime,
         date_trunc('hour', ts + INTERVAL 8 HOUR) AS twitter_datetime_hour, statuses_count, text AS tweet, truncated FROM raw""")
def p10(spark, sf):
    return po.searched_posts_to_rows(raw_posts(spark, sf))


# -- filters ------------------------------------------------------------------------------------------


@query("f03_not_null", RAW_SQL + "SELECT id_str FROM raw WHERE repost IS NULL")
def f03(spark, sf):
    return raw_posts(spark, sf).where(F.col("retweeted_status").isNull()).select("id_str")


@query("f04_language_in_list", cte("articles") + "SELECT doc_id FROM articles WHERE language IN ('en', 'de')")
def f04(spark, sf):
    return given(spark, sf, "articles").transform(rel.in_languages(["en", "de"])).select("doc_id")


WORDS = "(?i)license|copyright|password|th(e|ing) end"


@query("f05_keyword_regex", cte("articles") + f"""
  SELECT doc_id FROM articles WHERE regexp_matches(maintext, '{WORDS}') OR regexp_matches(CASE WHEN doc_id % 3 > 0 THEN title END, '{WORDS}')
    OR regexp_matches(description, '{WORDS}')""")
def f05(spark, sf):
    holes = given(spark, sf, "articles").withColumn("title", F.when(F.col("doc_id") % 3 > 0, F.col("title")))
    return holes.transform(rel.matches_any(WORDS)).select("doc_id")


@query("f06_post_search", """SELECT doc_id FROM documents WHERE lang = 'en' AND regexp_matches(text, '(?i)and|[.] the') AND doc_id % 7 > 0 AND DATE '2024-01-01' + CAST(doc_id % 28 AS INT) >= DATE '2024-01-05'
  AND DATE '2024-01-01' + CAST(doc_id % 28 AS INT) < DATE '2024-01-12'""")
def f06(spark, sf):
    docs = table(spark, sf, "documents").withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("timestamp_ntz"))
    docs = docs.withColumn("retweeted_status", F.when(F.col("doc_id") % 7 == 0, F.struct(F.col("doc_id").cast("string").alias("id_str"))))
    return rel.search_posts(docs, ["and", ". the"], "en", "2024-01-05", "2024-01-12").select("doc_id")


@query("f07_host_contains", "SELECT page_id FROM pages WHERE contains(url, 'example.net') OR contains(url, 'blog.')")
def f07(spark, sf):
    return table(spark, sf, "pages").transform(rel.from_hosts(["example.net", "blog."])).select("page_id")


@query("f07_host_exact", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://([^/?#]*[.])?example[.]net([/?#:]|$)')")
def f07_exact(spark, sf):
    return table(spark, sf, "pages").transform(rel.from_hosts(["example.net"], mode="host")).select("page_id")


def _some_dates(spark, sf):
    d = given(spark, sf, "articles")
    return d.withColumn("date_publish", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.lit("soon")).otherwise(F.col("date_publish")))


_DATED = cte("articles") + ", d AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN CAST(date_publish AS TIMESTAMP) END AS t FROM articles)"


@query("f08_publish_date", _DATED + "SELECT doc_id FROM d WHERE t IS NULL OR t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def f08(spark, sf):
    return rel.published_between(_some_dates(spark, sf), "date_publish", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("doc_id")


@query("f08_publish_date_strict", _DATED + "SELECT doc_id FROM d WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def f08_strict(spark, sf):
    return rel.published_between(_some_dates(spark, sf), "date_publish", "2024-01-05 00:00:00", "2024-01-20 00:00:00", True).select("doc_id")


@query("f13_drop_nulls", cte("posts") + "SELECT tweet_id FROM posts WHERE truncated AND followers_count > 200")
def f13(spark, sf):
    holes = given(spark, sf, "posts").select(
        "tweet_id", F.when(F.col("truncated"), 1).alias("a"), F.when(F.col("followers_count") > 200, 1).alias("b"), F.lit(None).cast("int").alias("c")
    )
    return holes.na.drop(subset=["a", "b"]).select("tweet_id")


@query("f15_accounts_any_case", cte("posts") + "SELECT tweet_id, twitter_handle_name FROM posts WHERE lower(twitter_handle_name) IN ('user_3', 'user_7')")
def f15(spark, sf):
    return rel.by_accounts(given(spark, sf, "posts"), "twitter_handle_name", ["USER_3", "user_7"]).select("tweet_id", "twitter_handle_name")


@query("f17_numeric_id", cte("accounts") + ", a AS (SELECT CASE WHEN friends_count > 10 THEN twitter_handle_id ELSE twitter_handle_name END AS handle FROM accounts) SELECT handle FROM a WHERE regexp_full_match(handle, '[0-9]+')")
def f17(spark, sf):
    mixed = given(spark, sf, "accounts").select(F.when(F.col("friends_count") > 10, F.col("twitter_handle_id")).otherwise(F.col("twitter_handle_name")).alias("handle"))
    return mixed.where(tx.is_digits(F.col("handle")))


@query("f18_response_guards", "SELECT page_id FROM pages WHERE page_id % 5 <> 1 AND page_id % 4 <> 2 AND length(html) BETWEEN 10 AND 5000")
def f18(spark, sf):
    answers = table(spark, sf, "pages").withColumns({
        "status": F.when(F.col("page_id") % 5 == 1, 404).otherwise(200),
        "content_type": F.when(F.col("page_id") % 4 == 2, F.lit("image/png")).otherwise(F.lit("text/html; charset=utf-8")),
    })
    return rel.usable_response(answers, longest=5000).select("page_id")


# -- distinct and aggregates --------------------------------------------------------------------------


@query("a04_count_per_domain_and_authors", cte("articles") + "SELECT source_domain, author AS authors, count(*) AS n FROM articles GROUP BY 1, 2")
def a04(spark, sf):
    counts = rel.count_by(_articles(spark, sf), "source_domain", "authors", name="n")
    return counts.withColumn("authors", F.array_join("authors", ","))


@query("a04_count_per_domain", cte("articles") + "SELECT source_domain, count(*) AS n FROM articles GROUP BY 1")
def a04_domain(spark, sf):
    return rel.count_by(given(spark, sf, "articles"), "source_domain", name="n")


@query("a05_count_per_domain_and_day", cte("articles") + "SELECT source_domain, date_publish AS day, count(*) AS n FROM articles WHERE source_domain IS NOT NULL GROUP BY 1, 2")
def a05(spark, sf):
    dated = given(spark, sf, "articles").withColumn("day", F.to_date("date_publish")).na.drop(subset=["source_domain", "day"])
    return rel.count_by(dated, "source_domain", "day", name="n").withColumn("day", F.col("day").cast("string"))


@query("a06_shape", "SELECT count(*) AS rows, 6::BIGINT AS columns FROM events")
def a06(spark, sf):
    return rel.shape(table(spark, sf, "events"))


@query("a07_summary", """SELECT 'value' AS "column", count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, CAST(min(value) AS VARCHAR) AS min, CAST(max(value) AS VARCHAR) AS max FROM events
  UNION ALL SELECT 'event_type', count(event_type), NULL, NULL, min(event_type), max(event_type) FROM events""")
def a07(spark, sf):
    return st.summary(table(spark, sf, "events"), ["value", "event_type"]).withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


@query("a10_percentiles", "SELECT p, round(quantile_cont(c_acctbal, p), 6) AS value FROM (SELECT c_acctbal, unnest([0.5::DOUBLE, 0.75::DOUBLE]) AS p FROM customer) GROUP BY p".replace("quantile_cont(c_acctbal, p)", "CASE WHEN p = 0.5 THEN quantile_cont(c_acctbal, 0.5) ELSE quantile_cont(c_acctbal, 0.75) END"))
def a10(spark, sf):
    return st.exact_percentiles(table(spark, sf, "customer"), "c_acctbal", [0.5, 0.75]).withColumn("value", F.round("value", 6))


@query("a11_extremes", cte("ticks") + "SELECT event_id, close, (SELECT min(close) FROM ticks) AS lowest FROM ticks WHERE close = (SELECT max(close) FROM ticks)")
def a11(spark, sf):
    ticks = given(spark, sf, "ticks").select("event_id", "close")
    low = st.extremes(ticks, "close").select("lowest").scalar()
    return st.rows_holding_max(ticks, "close").withColumn("lowest", low)


@query("a14_null_counts", cte("articles") + "SELECT count(*) FILTER (doc_id % 3 = 0) AS title, count(*) FILTER (language = 'de') AS language, 0::BIGINT AS url FROM articles")
def a14(spark, sf):
    holes = given(spark, sf, "articles").select(
        F.when(F.col("doc_id") % 3 != 0, F.col("title")).alias("title"), F.when(F.col("language") != "de", F.col("language")).alias("language"), "url"
    )
    return st.null_counts(holes)


@query("a15_full_row_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def a15(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


@query("a16_key_distinct_first", "SELECT event_id, user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def a16(spark, sf):
    return rel.keep_first(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"])


@query("a17_key_distinct_last", "SELECT event_id, user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def a17(spark, sf):
    return rel.keep_last(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"])


@query("w06_first_and_latest_per_key", """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2""")
def w06(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    first = rel.keep_first(rows, keys, order).select(*keys, F.col("event_id").alias("first_id"))
    return first.join(rel.keep_last(rows, keys, order).select(*keys, F.col("event_id").alias("last_id")), keys)


_DISTINCT = cte("articles") + "SELECT url FROM articles QUALIFY row_number() OVER (PARTITION BY {} date_publish, title, description, source_domain ORDER BY url) = 1"


@query("a18_article_distinct", _DISTINCT.format("author,"))
def a18(spark, sf):
    return art.distinct_articles(_articles(spark, sf).select(*art.ARTICLE_KEYS, "url")).select("url")


@query("a18_article_distinct_no_authors", _DISTINCT.format(""))
def a18_four(spark, sf):
    keys = art.ARTICLE_KEYS_WITHOUT_AUTHORS
    return art.distinct_articles(_articles(spark, sf).select(*keys, "url"), keys).select("url")


@query("a20_run_counters", """SELECT source AS file, count(*) AS total, count(*) FILTER (n_chars >= 500 AND lang <> 'es') AS passed, count(*) FILTER (n_chars < 500 AND lang <> 'es') AS discarded,
  count(*) FILTER (lang = 'es') AS failed, round(sum(n_chars / 1000) / count(*), 6) AS seconds_per_article FROM documents GROUP BY 1""")
def a20(spark, sf):
    runs = table(spark, sf, "documents").select(
        F.col("source").alias("file"), (F.col("n_chars") / 1000).alias("seconds"),
        F.when(F.col("lang") == "es", F.lit("error")).when(F.col("n_chars") < 500, F.lit("discarded")).otherwise(F.lit("passed")).alias("status"),
    )
    return art.run_counters(runs, "file", "status", "seconds").withColumn("seconds_per_article", F.round("seconds_per_article", 6))


@query("a20_remaining_hours", """WITH f AS (SELECT source, sum(n_chars) / 1e6::DOUBLE AS hours, source < 'src15' AS done FROM documents GROUP BY 1)
  SELECT count(*) AS files, round(avg(hours) FILTER (done), 6) AS hours_per_file, round(avg(hours) FILTER (done) * count(*) FILTER (NOT done), 6) AS hours_left FROM f""")
def a20_left(spark, sf):
    files = table(spark, sf, "documents").groupBy("source").agg((F.sum("n_chars") / 1e6).alias("hours"), (F.col("source") < "src15").alias("done"))
    return art.remaining_hours(files, "hours", "done").withColumns({"hours_per_file": F.round("hours_per_file", 6), "hours_left": F.round("hours_left", 6)})


@query("a21_five_numbers", cte("ticks") + """, q AS (SELECT min(close) AS low, quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.5) AS median, quantile_cont(close, 0.75) AS q3, max(close) AS high FROM ticks)
  SELECT round(low, 6) AS low, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(high, 6) AS high,
    (SELECT min(close) FROM ticks WHERE close >= q1 - 1.5::DOUBLE * (q3 - q1)) AS whisker_low, (SELECT max(close) FROM ticks WHERE close <= q3 + 1.5::DOUBLE * (q3 - q1)) AS whisker_high FROM q""")
def a21(spark, sf):
    box = st.five_numbers(given(spark, sf, "ticks"), "close")
    return box.withColumns({c: F.round(c, 6) for c in ("low", "q1", "median", "q3", "high")})


@query("a22_posts_per_named_account", cte("posts") + """, names AS (SELECT unnest(['USER_1', 'user_5', 'nobody']) AS handle)
  SELECT handle, count(p.tweet_id) AS n_posts FROM names LEFT JOIN posts p ON lower(p.twitter_handle_name) = lower(handle) GROUP BY 1""")
def a22(spark, sf):
    names = spark.createDataFrame([("USER_1",), ("user_5",), ("nobody",)], "handle string")
    return rel.counts_of_accounts(names, given(spark, sf, "posts"), on="twitter_handle_name")


# -- sorts and set operations -------------------------------------------------------------------------


@query("o03_mixed_sort", cte("articles") + "SELECT source_domain, author, count(*) AS n FROM articles GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2")
def o03(spark, sf):
    counts = rel.count_by(given(spark, sf, "articles"), "source_domain", "author", name="n")
    return counts.orderBy("source_domain", F.desc("n"), "author")


@query("o04_sort_by_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def o04(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy("ts", "event_id")


@query("u01_distinct_urls", "SELECT DISTINCT url FROM pages")
def u01(spark, sf):
    return table(spark, sf, "pages").select("url").distinct()


@query("u02_word_sets", """WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(left(text, length(text) // 2), '\\s+'), lambda x: x <> '')) AS a,
    list_distinct(list_filter(regexp_split_to_array(substr(text, length(text) // 2 + 1), '\\s+'), lambda x: x <> '')) AS b FROM documents)
  SELECT doc_id, CAST(len(list_intersect(a, b)) AS INT) AS shared, CAST(len(a) + len(b) - 2 * len(list_intersect(a, b)) AS INT) AS apart FROM w""")
def u02(spark, sf):
    """The words of the first half of each text against those of the second."""
    half = F.expr("length(text) div 2").cast("int")
    part = lambda text: F.array_distinct(tx.words(text))
    sets = table(spark, sf, "documents").select(
        "doc_id", part(F.left("text", half)).alias("a"), part(F.substr("text", half + 1)).alias("b"))
    return sets.select("doc_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(tx.symmetric_difference(F.col("a"), F.col("b"))).alias("apart"))


@query("u03_append", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 50) GROUP BY 1")
def u03(spark, sf):
    events = table(spark, sf, "events")
    return rel.count_by(events.select("event_type").unionByName(events.where("value > 50").select("event_type")), "event_type", name="n")


# -- joins --------------------------------------------------------------------------------------------


@query("j08_enrich_by_id", cte("posts") + """, bio AS (SELECT c_custkey % 100 AS k, arg_max(c_name, c_custkey) AS handle, arg_max(c_mktsegment, c_custkey) AS bio FROM customer GROUP BY 1)
  SELECT tweet_id, twitter_handle_id, handle, bio FROM posts LEFT JOIN bio ON twitter_handle_id = CAST(k AS VARCHAR)""")
def j08(spark, sf):
    lookup = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 100).cast("string").alias("twitter_handle_id"), F.col("c_name").alias("handle"), F.col("c_mktsegment").alias("bio"), "c_custkey"
    )
    posts = given(spark, sf, "posts").select("tweet_id", "twitter_handle_id")
    return rel.enrich(posts, lookup, "twitter_handle_id", ["c_custkey"], ["handle", "bio"])


@query("j10_skip_processed_files", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 20000)")
def j10(spark, sf):
    docs = table(spark, sf, "documents")
    return rel.not_yet_done(docs.select("source").distinct(), docs.where("lang = 'es' AND n_chars > 20000"), "source")


@query("j11_skip_exported_accounts", "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def j11(spark, sf):
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return rel.not_yet_done(accounts, table(spark, sf, "events"), "user_id")


@query("j12_occurring_accounts", "SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def j12(spark, sf):
    accounts = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return rel.occurring(accounts, table(spark, sf, "events"), "user_id")


@query("j07_join_on_day_of_month", cte("ticks") + """, daily AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, avg(close) AS close FROM ticks GROUP BY 1),
  idx AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderdate, sum(o_totalprice) AS level FROM orders GROUP BY 1, 2)
  SELECT bucket, round(close, 6) AS close, o_orderdate, round(level, 2) AS level FROM daily LEFT JOIN idx ON day(bucket) = day(o_orderdate)""")
def j07(spark, sf):
    daily = tsr.bucket_mean(given(spark, sf, "ticks"), "ts", "close", "1 day", gaps=False)
    index = table(spark, sf, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("level"))
    joined = tsr.join_on_day(daily, index, "bucket", "o_orderdate")
    return joined.select("bucket", F.round("close", 6).alias("close"), "o_orderdate", F.round("level", 2).alias("level"))


@query("j07_join_on_date", """WITH clicks AS (SELECT date_trunc('day', ts) AS bucket, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1),
  views AS (SELECT date_trunc('day', ts) AS day, count(*) AS views FROM events WHERE event_type = 'view' AND user_id % 3 = 0 AND day(ts) % 5 > 0 GROUP BY 1)
  SELECT CAST(bucket AS TIMESTAMP) AS bucket, clicks, CAST(day AS TIMESTAMP) AS day, views FROM clicks LEFT JOIN views ON bucket = day""")
def j07_date(spark, sf):
    """The same join on the whole date; days without a partner keep nulls."""
    events = table(spark, sf, "events").withColumn("bucket", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    clicks = events.where("event_type = 'click'").groupBy("bucket").agg(F.count("*").alias("clicks"))
    some = events.where("event_type = 'view' AND user_id % 3 = 0 AND day(ts) % 5 > 0")
    views = some.groupBy(F.col("bucket").alias("day")).agg(F.count("*").alias("views"))
    return tsr.join_on_day(clicks, views, "bucket", "day", key="date").select("bucket", "clicks", "day", "views")


@query("x09_day_of_month", "SELECT o_orderkey, CAST(day(o_orderdate) AS INT) AS day FROM orders")
def x09(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.dayofmonth("o_orderdate").alias("day"))


# -- composites ---------------------------------------------------------------------------------------


@query("c06_corpus", cte("articles") + f""", u AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY author, date_publish, title, description, source_domain ORDER BY url) = 1)
  SELECT url, language, md5(maintext) AS body FROM u WHERE language IN ('en') AND (regexp_matches(maintext, '{WORDS}') OR regexp_matches(title, '{WORDS}') OR regexp_matches(description, '{WORDS}'))""")
def c06(spark, sf):
    return art.build_corpus(_full_articles(spark, sf), ["en"], WORDS).select("url", "language", F.md5("maintext").alias("body"))


@query("c06_corpus_counts", cte("articles") + f""", u AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY author, date_publish, title, description, source_domain ORDER BY url) = 1)
  SELECT (SELECT count(*) FROM articles) AS before, count(*) AS after FROM u WHERE language IN ('en') AND (regexp_matches(maintext, '{WORDS}') OR regexp_matches(title, '{WORDS}') OR regexp_matches(description, '{WORDS}'))""")
def c06_counts(spark, sf):
    articles = _full_articles(spark, sf)
    return art.corpus_counts(articles, art.build_corpus(articles, ["en"], WORDS))


ORACLE_CLEANSE = RAW_SQL + """
  SELECT id_str AS tweet_id, uname AS twitter_handle_name, uid AS twitter_handle_id, udesc AS twitter_handle_desc, CAST(followers_count AS VARCHAR) AS followers_count,
         CAST(friends_count AS VARCHAR) AS friends_count, CAST(listed_count AS VARCHAR) AS listed_count, CAST(statuses_count AS VARCHAR) AS statuses_count,
         text AS tweet, truncated, date_trunc('second', ts) AS tweet_datetime_timestamp, date_trunc('second', ts) AS created_at_timestamp,
         date_trunc('hour', ts) AS twitter_datetime_hour FROM raw WHERE repost IS NULL"""


@query("c07_post_cleanse", ORACLE_CLEANSE)
def c07(spark, sf):
    return po.cleanse_posts(raw_posts(spark, sf), counts_as_text=True)


_BAND = cte("accounts") + """, b AS (SELECT CAST(trunc(quantile_cont(followers_count, 0.5)) AS BIGINT) AS lo, CAST(trunc(quantile_cont(followers_count, 0.75)) AS BIGINT) AS hi FROM accounts)
  SELECT twitter_handle_id, followers_count FROM accounts, b WHERE followers_count BETWEEN lo AND hi"""


@query("c09_follower_band", _BAND)
def c09(spark, sf):
    accounts = given(spark, sf, "accounts")
    return acc.follower_band(accounts.unionByName(accounts), "twitter_handle_id", "followers_count").select("twitter_handle_id", "followers_count")


@query("f09_band_filter", _BAND)
def f09(spark, sf):
    return acc.follower_band(given(spark, sf, "accounts").select("twitter_handle_id", "followers_count"), "twitter_handle_id", "followers_count")


@query("o06_sort_by_followers", _BAND + " ORDER BY followers_count DESC, twitter_handle_id")
def o06(spark, sf):
    return f09(spark, sf).orderBy(F.desc("followers_count"), "twitter_handle_id")


@query("c10_account_timeline", cte("posts", "ticks") + """, ev AS (SELECT ts AS event_ts FROM ticks WHERE close > 200),
  n AS (SELECT twitter_handle_name, tweet_datetime, (SELECT min(event_ts) FROM ev WHERE event_ts >= tweet_datetime) AS next_event_ts FROM posts WHERE lower(twitter_handle_name) IN ('user_1', 'user_2', 'user_3'))
  SELECT *, round(date_diff('microsecond', tweet_datetime, next_event_ts) / 60000000, 9) AS minutes_to_event FROM n""")
def c10(spark, sf):
    events = given(spark, sf, "ticks").where("close > 200").select(F.col("ts").alias("event_ts"))
    line = acc.account_timeline(given(spark, sf, "posts"), events, "twitter_handle_name", "tweet_datetime", "event_ts", ["User_1", "USER_2", "user_3"])
    return line.withColumn("minutes_to_event", F.round("minutes_to_event", 9))
