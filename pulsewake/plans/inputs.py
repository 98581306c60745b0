"""How the given tables stand in for posts, prices, followers, articles and pages.

Each stand-in is one SELECT that both engines read, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Parameters that give results at every test scale.
PERIOD = ("2024-01-02 00:00:00", "2024-01-28 00:00:00")
EVENTS = ["2024-01-05 06:00:00", "2024-01-11 07:00:00", "2024-01-18 10:30:00", "2024-01-25 01:00:00"]
BANDWIDTH = 180

INPUTS: dict[str, tuple[str, str]] = {
    "posts": ("events", """
        SELECT CAST(event_id AS STRING) AS tweet_id, 'User_' || CAST(user_id AS STRING) AS twitter_handle_name,
               CAST(user_id AS STRING) AS twitter_handle_id, ts AS tweet_datetime,
               event_type AS twitter_handle_desc, CAST(user_id * 10 AS INT) AS followers_count,
               CAST(user_id AS INT) AS friends_count, CAST(1 AS INT) AS listed_count,
               CAST(event_id AS INT) AS statuses_count, props AS tweet, value > 50 AS truncated
        FROM {events}"""),
    "pubs": ("events", "SELECT event_id, user_id, ts, event_type FROM {events}"),
    "ticks": ("events", "SELECT event_id, ts, value AS close FROM {events} WHERE event_type = 'purchase'"),
    "views": ("events", "SELECT event_id, ts FROM {events} WHERE event_type = 'view'"),
    "edges": ("events", """
        SELECT DISTINCT CAST(user_id AS STRING) AS src, regexp_extract(props, '[0-9]+', 0) AS dst
        FROM {events}"""),
    "accounts": ("customer", """
        SELECT c_name AS twitter_handle_name, CAST(c_custkey AS STRING) AS twitter_handle_id,
               c_mktsegment AS twitter_handle_desc, c_acctbal AS followers_count,
               CAST(c_nationkey AS DOUBLE) AS friends_count
        FROM {customer}"""),
    "articles": ("documents", """
        SELECT doc_id, source AS author, '2024-01-' || lpad(CAST(1 + n_chars % 28 AS STRING), 2, '0') AS date_publish,
               split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description, lang || '.example.com' AS source_domain,
               text AS maintext, lang AS language, 'http://' || source || '.example.com/' || CAST(doc_id AS STRING) AS url
        FROM {documents}"""),
    "visits": ("events", """
        SELECT event_id AS id, event_type || '/' || CAST(user_id AS STRING) AS url, ts AS download_date
        FROM {events}"""),
    # pages with the head and body parts that the raw ones lack, a different mix per page
    "rich": ("pages", """
        SELECT page_id, url, replace(replace(html, '<head>', '<head>' || CASE page_id % 7
            WHEN 0 THEN '<meta property="og:type" content="article"><meta name="author" content="A. Writer">'
            WHEN 1 THEN '<meta content="article" property="og:type"><meta name="pubdate" content="2015-11-26T07:11:02Z">'
            WHEN 2 THEN '<script type="application/ld+json">{{"datePublished": "2016-02-03T04:05:06+01:00"}}</script>'
            WHEN 3 THEN '<meta name="description" content="An article about &lt;things&gt;"><meta property="og:image" content="/img/2015/11/26/a.jpg">'
            WHEN 4 THEN '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><meta property="og:locale" content="de_DE">'
            WHEN 5 THEN '<meta name="DATE_PUBLISHED" content="11/24/2015 01:05AM"><meta property="og:image" content="http://img.example.com/b.png">'
            ELSE '<meta name="keywords" content="news">' END),
          '<article>', CASE page_id % 4
            WHEN 0 THEN '<h2><a href="/a.pdf">a</a></h2><h2><a href="b/c">b</a></h2><h3>c</h3><h3>d</h3><time datetime="2017-01-02 03:04:05">x</time>'
            WHEN 1 THEN '<h2><a href="' || url || '">a</a></h2><h2><a href="//other.example.com/x">b</a></h2><h3><a href="?q=1">c</a></h3><h4>d</h4>'
            WHEN 2 THEN '<span itemprop="datePublished" content="2018-05-06">y</span><img src="pics/1.png">'
            ELSE '' END || '<article>') AS html
        FROM {pages}"""),
}


# Declared column types of the tables in use; a declared schema saves the footer-reading job of each read.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame."""
    base, text = INPUTS[name]
    return spark.sql(text, **{base: table(spark, sf_dir, base)})


def cte(*names: str) -> str:
    """The same stand-ins as a WITH list."""
    parts = []
    for name in names:
        base, text = INPUTS[name]
        parts.append(f"{name} AS ({text.format(**{base: base})})")
    return "WITH " + ",\n".join(parts) + "\n"
