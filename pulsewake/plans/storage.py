"""Source and sink queries: the given tables go through each format and come back."""

from datetime import datetime

from pyspark.sql import functions as F, types as T

from pulsewake import schemas
from pulsewake.operators import graph as g
from pulsewake.operators.history import version_history
from pulsewake.plans.inputs import cte, given, table
from pulsewake.plans.registry import query
from pulsewake.runtime import cut_lineage, scratch_path
from pulsewake.sources import archive, readers, sinks

_RAW_COLUMNS = ["id_str", "created_at", "text", "truncated", "retweeted_status", "user"]
RAW_SQL = cte("posts") + """, raw AS (
  SELECT tweet_id AS id_str, tweet_datetime AS ts, tweet AS text, truncated,
         CASE WHEN twitter_handle_desc = 'error' THEN 'rt' || tweet_id END AS repost,
         twitter_handle_id AS uid, twitter_handle_name AS uname, lower(twitter_handle_name) AS sname, twitter_handle_desc AS udesc,
         followers_count, friends_count, listed_count, statuses_count
  FROM posts)"""


def raw_posts(spark, sf):
    """Events as nested post JSON."""
    created = F.date_format("tweet_datetime", "EEE MMM d HH:mm:ss '+0000' yyyy")
    return given(spark, sf, "posts").select(
        F.col("tweet_id").alias("id_str"), created.alias("created_at"), F.col("tweet").alias("text"), "truncated",
        F.when(F.col("twitter_handle_desc") == "error", F.struct(F.concat(F.lit("rt"), "tweet_id").alias("id_str"))).alias("retweeted_status"),
        F.struct(
            F.col("twitter_handle_id").alias("id_str"), F.col("twitter_handle_name").alias("name"),
            F.lower("twitter_handle_name").alias("screen_name"), F.col("twitter_handle_desc").alias("description"),
            created.alias("created_at"), "followers_count", "friends_count", "listed_count", "statuses_count",
        ).alias("user"),
    )


def raw_posts_file(spark, sf):
    path = scratch_path(spark, "rawposts")
    raw_posts(spark, sf).write.json(path)
    return path


def _posts_csv(spark, sf):
    path = scratch_path(spark, "posts")
    posts = given(spark, sf, "posts").withColumns({
        "created_at_datetime": F.col("tweet_datetime"), "twitter_datetime_hour": F.date_trunc("hour", "tweet_datetime").cast("timestamp_ntz"),
    })
    posts.select(*[F.col(c).cast("string") for c in schemas.POSTS.names]).write.csv(path, header=True)
    return path


_POSTS = cte("posts") + """SELECT tweet_id, twitter_handle_name, twitter_handle_id, tweet_datetime, twitter_handle_desc, followers_count,
  friends_count, listed_count, tweet_datetime AS created_at_datetime, date_trunc('hour', tweet_datetime) AS twitter_datetime_hour,
  statuses_count, tweet, truncated FROM posts"""


@query("s01_csv_fixed_schema", _POSTS)
def s01(spark, sf):
    return readers.read_posts_csv(spark, _posts_csv(spark, sf))


@query("s02_csv_inferred", cte("posts") + "SELECT twitter_handle_name, CAST(followers_count AS BIGINT) AS followers_count, truncated FROM posts")
def s02(spark, sf):
    df = readers.read_csv_inferred(spark, _posts_csv(spark, sf))
    return df.select("twitter_handle_name", F.col("followers_count").cast("bigint"), "truncated")


@query("s03_json_lines_nested", RAW_SQL + """
  SELECT id_str, strftime(ts, '%a %b %-d %H:%M:%S +0000 %Y') AS created_at, text, truncated, repost AS repost_of, uname, followers_count FROM raw""")
def s03(spark, sf):
    return readers.read_raw_posts(spark, raw_posts_file(spark, sf)).select(
        "id_str", "created_at", "text", "truncated", F.col("retweeted_status.id_str").alias("repost_of"),
        F.col("user.name").alias("uname"), F.col("user.followers_count").alias("followers_count"),
    )


@query("s04_json_multiline_articles", "SELECT url, page_id || '' AS title, md5(html) AS body, '[w' || (page_id % 5) || ']' AS authors FROM pages")
def s04(spark, sf):
    """Pretty-printed JSON spread over many lines, up to a hundred articles per file."""
    path = scratch_path(spark, "articles")
    article = F.struct(
        "url", F.col("page_id").cast("string").alias("title"), F.col("html").alias("maintext"),
        F.array(F.concat(F.lit("w"), (F.col("page_id") % 5).cast("string"))).alias("authors"),
    )
    files = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("file")).agg(F.collect_list(article).alias("a"))
    files.select("file", F.to_json("a", {"pretty": "true"}).alias("value")).write.partitionBy("file").text(path)
    df = readers.read_articles_json(spark, f"{path}/*", "*.txt")
    return df.select("url", "title", F.md5("maintext").alias("body"), F.col("authors").cast("string").alias("authors"))


@query("s05_parquet_scan", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click'")
def s05(spark, sf):
    return readers.read_parquet(spark, f"{sf}/events.parquet").where("event_type = 'click'").select("event_id", "user_id", "event_type")


@query("s06_orc_scan", "SELECT event_id, user_id, event_type, value FROM events")
def s06(spark, sf):
    path = scratch_path(spark, "orc")
    sinks.write_orc(table(spark, sf, "events").drop("ts"), path)
    return readers.read_orc(spark, path).select("event_id", "user_id", "event_type", "value")


@query("s07_table_with_pushed_filter", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def s07(spark, sf):
    window = "ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts <= TIMESTAMP_NTZ '2024-01-09 12:00:00'"
    return readers.read_table(spark, "parquet", {}, window, ["event_id", "ts"], f"{sf}/events.parquet")


@query("s08_account_slice", cte("accounts") + "SELECT * FROM accounts")
def s08(spark, sf):
    rows = readers.read_table(spark, "parquet", {}, path=f"{sf}/customer.parquet")
    return rows.selectExpr(
        "c_name AS twitter_handle_name", "CAST(c_custkey AS STRING) AS twitter_handle_id", "c_mktsegment AS twitter_handle_desc",
        "c_acctbal AS followers_count", "CAST(c_nationkey AS DOUBLE) AS friends_count",
    )


@query("s09_relationship_scan", cte("edges") + "SELECT src, dst, '1' AS weight FROM edges")
def s09(spark, sf):
    path = scratch_path(spark, "edges")
    sinks.write_table(given(spark, sf, "edges").withColumn("weight", F.lit("1")), "parquet", "overwrite", path=path)
    return readers.read_table(spark, "parquet", {}, columns=["src", "dst", "weight"], path=path)


@query("s10_vertex_scan", "SELECT c_name AS screen_name, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS description, CAST(floor(c_acctbal) AS INT) AS followers_count FROM customer")
def s10(spark, sf):
    return readers.read_table(spark, "parquet", {}, path=f"{sf}/customer.parquet").selectExpr(
        "c_name AS screen_name", "CAST(c_custkey AS STRING) AS id", "c_mktsegment AS description", "CAST(floor(c_acctbal) AS INT) AS followers_count"
    )


def archive_file(spark, sf, pages=None, path=None):
    """Pages as archive files: a request and a response for each, in both versions of the format and in three charsets."""
    path = path or scratch_path(spark, "archive")
    pages = table(spark, sf, "pages") if pages is None else pages
    latin = F.col("html").rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    k = F.col("page_id") % 3
    name = F.when((k == 0) & latin, "windows-1252").when(k == 1, "utf-8").otherwise("utf-16le")
    body = F.when(name == "windows-1252", F.encode("html", "ISO-8859-1")).when(name == "utf-8", F.encode("html", "UTF-8")).otherwise(F.encode("html", "UTF-16LE"))

    def record(kind, http, content):
        block = F.concat(F.encode(http, "UTF-8"), content)
        head = F.concat(
            F.format_string("WARC/1.%d\r\nWARC-Type: " + kind + "\r\nWARC-Target-URI: ", F.col("page_id") % 2), "url",
            F.lit("\r\nWARC-Date: 2024-02-03T04:05:06Z\r\nContent-Type: application/http\r\nContent-Length: "), F.length(block).cast("string"), F.lit("\r\n\r\n"))
        return F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))

    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset="), name, F.lit("\r\n\r\n"))
    both = F.concat(record("request", F.lit("GET / HTTP/1.1\r\nHost: x\r\n\r\n"), F.encode(F.lit(""), "UTF-8")), record("response", answer, body))
    # the text writer puts out the bytes of a value as they are
    pages.select(both.cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)
    return path


@query("s12_archive_ranges", """SELECT url, '2024-02-03T04:05:06Z' AS download_date, 200 AS http_status, md5(html) AS body FROM pages""")
def s12_ranges(spark, sf):
    """Archives by an index of pieces; each piece is read by itself."""
    path = archive_file(spark, sf)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    index = cut_lineage(archive.record_ranges(files, size=1 << 18))
    return archive.decoded_pages(archive.records_in_ranges(index)).select("url", "download_date", "http_status", F.md5("html").alias("body"))


@query("s12_archive_scan", "SELECT url, '2024-02-03T04:05:06Z' AS download_date, 200 AS http_status, md5(html) AS body FROM pages")
def s12(spark, sf):
    pages = archive.decoded_pages(archive.read_archive(spark, archive_file(spark, sf)))
    return pages.select("url", "download_date", "http_status", F.md5("html").alias("body"))


@query("s13_url_list", "SELECT DISTINCT url FROM pages")
def s13(spark, sf):
    path = scratch_path(spark, "urls")
    urls = table(spark, sf, "pages").select(F.explode(F.array("url", F.concat(F.lit("  "), "url", F.lit(" ")), F.lit("   "))).alias("value"))
    urls.write.text(path)
    return readers.read_url_list(spark, path)


@query("s14_archive_listing", """
  WITH listing AS (SELECT 'crawl-data/CC-NEWS/' || strftime(ts + INTERVAL (event_id % 90) DAY, '%Y/%m') || '/CC-NEWS-' ||
                   strftime(ts + INTERVAL (event_id % 90) DAY, '%Y%m%d%H%M%S') || '-' || event_id || '.warc.gz' AS path,
                   date_trunc('second', ts + INTERVAL (event_id % 90) DAY) AS stamp FROM events)
  SELECT path, stamp FROM listing WHERE stamp >= TIMESTAMP '2024-01-20 00:00:00' AND date_trunc('month', stamp) <= TIMESTAMP '2024-02-10'""")
def s14(spark, sf):
    at = F.col("ts") + F.make_dt_interval((F.col("event_id") % 90).cast("int"))
    listing = table(spark, sf, "events").select(F.concat(
        F.lit("crawl-data/CC-NEWS/"), F.date_format(at, "yyyy/MM"), F.lit("/CC-NEWS-"), F.date_format(at, "yyyyMMddHHmmss"),
        F.lit("-"), F.col("event_id").cast("string"), F.lit(".warc.gz"),
    ).alias("path"))
    return archive.archive_files(listing, "2024-01-20 00:00:00", "2024-02-10 00:00:00")


@query("s15_event_export", "SELECT DISTINCT url FROM pages")
def s15(spark, sf):
    path = scratch_path(spark, "export")
    pages = table(spark, sf, "pages")
    doubled = pages.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x"), "page_id", "url")
    doubled.select(F.concat_ws("\t", "x", F.col("page_id").cast("string"), "url").alias("value")).write.text(path)
    return readers.read_event_export(spark, path)


def _feed_xml():
    item = "<item><title>page {}</title><link>{}</link></item>"
    link = F.regexp_replace("url", "&", "&amp;")
    return F.format_string(item.replace("{}", "%s"), F.col("page_id").cast("string"), link)


@query("s16_feed_items", "SELECT page_id, url AS link, 'page ' || page_id AS title FROM pages")
def s16(spark, sf):
    feeds = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<rss><channel>"), _feed_xml(), F.lit("</channel></rss>")).alias("xml"))
    return readers.feed_items(feeds)


@query("s16_feed_file", "SELECT url AS link, 'page ' || page_id AS title FROM pages")
def s16_file(spark, sf):
    """Feed files of up to a hundred items."""
    path = scratch_path(spark, "feed")
    files = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 100).alias("file")).agg(F.collect_list(_feed_xml()).alias("items"))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join("items", "\n"), F.lit("</channel></rss>"))
    files.select("file", feed.alias("value")).write.partitionBy("file").text(path)
    return readers.read_feed(spark, f"{path}/*")


@query("s17_follower_pages", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS src, regexp_extract(props, '[0-9]+', 0) AS dst FROM events WHERE event_type = 'error'""")
def s17(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'")
    payload = F.to_json(F.struct(F.array("user_id", "user_id").alias("ids"), F.lit(0).alias("next_cursor")))
    pages = errors.select(F.get_json_object("props", "$.k").alias("account"), payload.alias("payload"))
    return g.edges_from_pages(readers.follower_pages(pages))


@query("s18_csv_directory", cte("edges") + "SELECT src, dst FROM edges")
def s18(spark, sf):
    path = scratch_path(spark, "edgescsv")
    sinks.write_csv(given(spark, sf, "edges").select("src", "dst"), path)
    return readers.read_csv_dir(spark, path, T.StructType.fromDDL("src string, dst string"))


@query("s19_candles", """
  SELECT DISTINCT date_trunc('millisecond', ts) + INTERVAL 8 HOUR AS time, value AS open, value + 1 AS close, value + 2 AS high, value - 1 AS low,
         CAST(user_id AS DOUBLE) AS volume, CAST(strftime(date_trunc('millisecond', ts) + INTERVAL 8 HOUR, '%Y%m%d') AS INT) AS id_date
  FROM events WHERE event_type = 'purchase'""")
def s19(spark, sf):
    ticks = table(spark, sf, "events").where("event_type = 'purchase'")
    numbers = [F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.col("value") + 1, F.col("value") + 2, F.col("value") - 1, F.col("user_id")]
    candles = ticks.select(F.array(*[n.cast("double") for n in numbers]).alias("candle"))
    return readers.candles_to_prices(candles.unionByName(candles))


# -- sinks --------------------------------------------------------------------------------------------


@query("k01_parquet_job_folder", cte("articles") + "SELECT doc_id, title, language FROM articles")
def k01(spark, sf):
    articles = given(spark, sf, "articles").select("doc_id", "title", "language")
    return spark.read.parquet(sinks.write_job_parquet(articles, scratch_path(spark, "jobs"), datetime(2024, 1, 2, 3, 4, 5)))


@query("k02_orc_json", "SELECT event_id, 'orc' AS kind FROM events UNION ALL SELECT event_id, 'json' AS kind FROM events")
def k02(spark, sf):
    path = scratch_path(spark, "alt")
    ids = table(spark, sf, "events").select("event_id")
    sinks.write_orc(ids, f"{path}/orc")
    sinks.write_json(ids, f"{path}/json")
    orc = spark.read.orc(f"{path}/orc").withColumn("kind", F.lit("orc"))
    return orc.unionByName(spark.read.schema("event_id bigint").json(f"{path}/json").withColumn("kind", F.lit("json")))


@query("k03_append_and_overwrite", "SELECT event_type, 2 * count(*) AS appended, count(*) AS replaced FROM events GROUP BY 1")
def k03(spark, sf):
    path = scratch_path(spark, "warehouse")
    kinds = table(spark, sf, "events").select("event_type")
    for mode in ("append", "append"):
        sinks.write_table(kinds, "parquet", mode, path=f"{path}/grown")
    for mode in ("overwrite", "overwrite"):
        sinks.write_table(kinds, "parquet", mode, path=f"{path}/fresh")
    count = lambda name, alias: spark.read.schema("event_type string").parquet(f"{path}/{name}").groupBy("event_type").agg(F.count("*").alias(alias))
    return count("grown", "appended").join(count("fresh", "replaced"), "event_type")


@query("k04_single_csv", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k04(spark, sf):
    path = scratch_path(spark, "result")
    sinks.write_result_csv(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type"), path, single_file=True)
    return spark.read.schema("event_type string, n bigint").csv(path, header=True)


@query("k05_articles_by_domain", cte("articles") + "SELECT source_domain, url, sha256(url) || '.json' AS file_key, title FROM articles")
def k05(spark, sf):
    path = scratch_path(spark, "domains")
    sinks.write_articles_by_domain(given(spark, sf, "articles").select("source_domain", "url", "title"), path)
    return spark.read.schema("url string, file_key string, title string, source_domain string").json(path).select("source_domain", "url", "file_key", "title")


@query("k06_raw_page_store", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, md5(html) AS body FROM pages")
def k06(spark, sf):
    path = scratch_path(spark, "raw")
    pages = table(spark, sf, "pages").withColumn("lang", F.regexp_extract("html", '<html lang="([a-z]+)"', 1))
    sinks.write_raw_pages(pages.select("page_id", "html", "lang"), path, "lang")
    return spark.read.schema("page_id bigint, html string, lang string").parquet(path).select("page_id", "lang", F.md5("html").alias("body"))


@query("k08_edge_vertex_csv", cte("edges") + "SELECT src AS a, dst AS b, 'edge' AS kind FROM edges UNION ALL SELECT DISTINCT unnest([src, dst]), '', 'vertex' FROM edges")
def k08(spark, sf):
    path = scratch_path(spark, "viewer")
    edges = given(spark, sf, "edges").select("src", "dst")
    sinks.write_graph(edges, g.vertices_of(edges), path)
    read = lambda name, ddl: readers.read_csv_dir(spark, f"{path}/{name}", T.StructType.fromDDL(ddl))
    e = read("edges", "a string, b string").withColumn("kind", F.lit("edge"))
    return e.unionByName(read("vertices", "a string").withColumns({"b": F.lit(""), "kind": F.lit("vertex")}))


@query("g09_adjacency_json", cte("edges") + "SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS followees FROM edges GROUP BY 1")
def g09(spark, sf):
    path = scratch_path(spark, "viewer")
    edges = given(spark, sf, "edges").select("src", "dst")
    sinks.write_graph(edges, g.vertices_of(edges), path)
    lists = spark.read.schema("id string, part int, followees array<string>").json(f"{path}/adjacency")
    return lists.select("id", F.array_join("followees", ",").alias("followees"))


@query("k09_batch_append", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k09(spark, sf):
    """Two bulk appends in place of row inserts."""
    path = scratch_path(spark, "append")
    events = table(spark, sf, "events").select("event_id", "event_type")
    sinks.append_rows(events.where("event_type < 'f'"), path)
    sinks.append_rows(events.where("event_type >= 'f'"), path)
    return spark.read.schema("event_id bigint, event_type string").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("k10_publish_result_tree", cte("articles") + "SELECT language, count(*) AS n FROM articles GROUP BY 1")
def k10(spark, sf):
    """Results are written straight to the target address, partitioned."""
    path = scratch_path(spark, "published")
    given(spark, sf, "articles").select("doc_id", "language").write.mode("overwrite").partitionBy("language").parquet(path)
    return spark.read.schema("doc_id bigint, language string").parquet(path).groupBy("language").agg(F.count("*").alias("n"))


@query("k11_versioned_tables", cte("visits") + """, h AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY download_date, id) AS version,
    lead(id) OVER (PARTITION BY url ORDER BY download_date, id) AS nxt FROM visits)
  SELECT url, id, version, CASE WHEN nxt IS NULL THEN 'current' ELSE 'archive' END AS kept_in FROM h""")
def k11(spark, sf):
    path = scratch_path(spark, "versions")
    sinks.write_versions(version_history(given(spark, sf, "visits"), "url", "download_date", "id"), path)
    read = lambda name: spark.read.parquet(f"{path}/{name}").select("url", "id", "version", F.lit(name).alias("kept_in"))
    return read("current").unionByName(read("archive")).withColumn("version", F.col("version").cast("bigint"))
