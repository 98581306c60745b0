"""Version history, throttle and streaming queries."""

from pyspark.sql import functions as F, types as T

from pulsewake.operators import history as hist
from pulsewake.operators.windows import busy_hours
from pulsewake.plans.inputs import cte, given, table
from pulsewake.plans.registry import query
from pulsewake.plans.storage import raw_posts_file
from pulsewake.plans.tables import ORACLE_CLEANSE
from pulsewake.plans.scores import ORACLE_NEAR
from pulsewake.runtime import cut_lineage, scratch_path
from pulsewake.streaming import flows
from pulsewake.streaming.versions import VersionTables

_HISTORY = cte("visits") + """, h AS (SELECT url, id, download_date, row_number() OVER o AS version, coalesce(lag(id) OVER o, 0) AS ancestor, coalesce(lead(id) OVER o, 0) AS descendant,
    lead(id) OVER o IS NULL AS is_current FROM visits WINDOW o AS (PARTITION BY url ORDER BY download_date, id))\n"""


def history(spark, sf):
    versions = hist.version_history(given(spark, sf, "visits"), "url", "download_date", "id")
    return versions.withColumn("version", F.col("version").cast("bigint"))


@query("w05_versions", _HISTORY + "SELECT * FROM h")
def w05(spark, sf):
    return history(spark, sf)


@query("c05_current_and_archive", _HISTORY + "SELECT url, id, version, ancestor, is_current FROM h")
def c05(spark, sf):
    versions = cut_lineage(history(spark, sf))
    kept = hist.current_versions(versions).unionByName(hist.archived_versions(versions))
    return kept.select("url", "id", "version", "ancestor", "is_current")


@query("j13_arrivals_with_current", _HISTORY + """SELECT v.url, v.id, c.id AS current_id, c.version AS current_version FROM visits v
  LEFT JOIN (SELECT * FROM h WHERE is_current AND url NOT LIKE 'view/%') c USING (url)""")
def j13(spark, sf):
    stored = hist.newest(given(spark, sf, "visits"), "url", "download_date", "id").where(~F.col("url").startswith("view/"))
    return hist.arrivals_with_current(given(spark, sf, "visits").select("url", "id"), stored, "url", ["id", "version"])


_THROTTLE = cte("visits") + """, l AS (SELECT {key} AS key, list_transform(list(DISTINCT epoch_us(download_date) ORDER BY epoch_us(download_date)), lambda t: [t]) AS ts FROM visits GROUP BY 1),
  k AS (SELECT key, unnest(list_reduce(ts, lambda kept, t: CASE WHEN t[1] - kept[-1] >= 6 * 3600000000 THEN list_concat(kept, t) ELSE kept END)) AS t FROM l)
  SELECT key AS {name}, make_timestamp(t) AS download_date FROM k"""


@query("t04_throttle_batch", _THROTTLE.format(key="split_part(url, '/', 2)", name="page"))
def t04_batch(spark, sf):
    """Kept moments per page, by step doubling."""
    visits = given(spark, sf, "visits").select(F.substring_index("url", "/", -1).alias("page"), "download_date")
    return hist.throttle(visits, "page", "download_date", 6)


# -- streaming: each flow works off files and is read back ---------------------------------------------


def _run(spark, stream, name, mode="append"):
    path = scratch_path(spark, name)
    flows.run_to_files(stream, path, scratch_path(spark, name + "-state"), mode)
    return spark.read.schema(stream.schema).parquet(path)


def _zoned(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_stream(spark, sf, columns, copies=1, files_per_batch=100):
    """Events as files with a zoned time, which watermarks need."""
    path = scratch_path(spark, "arrivals")
    events = _zoned(spark, sf).select(*columns)
    for _ in range(copies):
        events.write.mode("append").parquet(path)
    return flows.stream_parquet(spark, path, events.schema, files_per_batch)


def _span(spark, sf):
    """A lateness under which no event is late, in whatever order and batches the files come."""
    first, last = _zoned(spark, sf).agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    return f"{(last or 0) - (first or 0) + 3600} seconds"


@query("t01_stream_cleanse", ORACLE_CLEANSE)
def t01(spark, sf):
    return _run(spark, flows.clean_stream(flows.stream_raw_posts(spark, raw_posts_file(spark, sf))), "clean").withColumns(
        {c: F.col(c).cast("string") for c in ("listed_count", "statuses_count", "followers_count", "friends_count")}
    )


@query("t02_stream_distinct", "SELECT event_id, ts FROM events")
def t02(spark, sf):
    twice = _event_stream(spark, sf, ["event_id", "ts"], copies=2)
    return _run(spark, flows.distinct_stream(twice, "event_id", "ts", "60 days"), "distinct")


@query("t03_stream_volume", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS volume FROM events GROUP BY 1")
def t03(spark, sf, files_per_batch=100):
    """Every window, the open ones as well: each micro-batch brings the counts that changed, and the last one counts."""
    path = scratch_path(spark, "volume")
    stream = flows.volume_stream(_event_stream(spark, sf, ["event_id", "ts"], files_per_batch=files_per_batch), "ts", "1 hour", _span(spark, sf))
    flows.upsert_to_files(stream, path, scratch_path(spark, "volume-state"))
    return flows.latest(spark, path, stream.schema, ["bucket"])


@query("t04_stream_throttle", _THROTTLE.format(key="split_part(url, '/', 2)", name="page"))
def t04(spark, sf, files_per_batch=100):
    """Arrivals in any files and batches; a last one, far later and of no page, moves the watermark past all others."""
    arrivals = _zoned(spark, sf).select(F.col("user_id").cast("string").alias("page"), F.col("ts").alias("download_date"))
    path, span = scratch_path(spark, "arrivals"), _span(spark, sf)
    arrivals.write.parquet(path)
    last = arrivals.agg((F.max("download_date") + F.expr(f"INTERVAL {span}") + F.expr("INTERVAL 1 DAY")).alias("download_date"))
    last.select(F.lit(None).cast("string").alias("page"), "download_date").write.mode("append").parquet(path)
    stream = flows.throttle_stream(flows.stream_parquet(spark, path, arrivals.schema, files_per_batch), "page", "download_date", 6, span)
    target = scratch_path(spark, "throttle")
    flows.run_to_files(stream, target, scratch_path(spark, "throttle-state"), conf=flows.KEYED_STATE)
    return spark.read.schema(stream.schema).parquet(target)


@query("t05_stream_versions", _HISTORY + "SELECT url, id, version, ancestor, descendant FROM h")
def t05(spark, sf, files_per_batch=4):
    """Two halves by id, whose times lie among each other: every bucket gets arrivals older than its current rows."""
    source = scratch_path(spark, "visits")
    visits = given(spark, sf, "visits")
    for half in ("id % 2 = 0", "id % 2 = 1"):
        visits.where(half).write.mode("append").parquet(source)
    tables = VersionTables(spark, scratch_path(spark, "versions"), "url", "download_date", "id", visits.schema, buckets=8)
    stream = flows.stream_parquet(spark, source, visits.schema, files_per_batch)
    flows.run_batches(stream, tables.merge, scratch_path(spark, "versions-state"))
    return tables.history().select("url", "id", "version", "ancestor", "descendant")


@query("t06_stream_interval_join", ORACLE_NEAR)
def t06(spark, sf, files_per_batch=100, rows_per_task=100_000):
    busy = busy_hours(_zoned(spark, sf), "ts", rows_per_task)
    pubs = _event_stream(spark, sf, ["event_id", "ts"], files_per_batch=files_per_batch)
    trades = _event_stream(spark, sf, [F.col("event_id").alias("trade_id"), F.col("ts").alias("event_ts"), "event_type", "value"], files_per_batch=files_per_batch)
    big = trades.where("event_type = 'purchase' AND value > 200").select("trade_id", "event_ts")
    return _run(spark, flows.publications_near_events(pubs, big, "ts", "event_ts", 30, _span(spark, sf), busy=busy), "near").select("event_id", "trade_id")


@query("t07_incremental_pickup", "SELECT event_id FROM events")
def t07(spark, sf):
    """Two runs over a growing folder with one checkpoint: every file is taken exactly once."""
    source, target, state = (scratch_path(spark, n) for n in ("inbox", "picked", "picked-state"))
    events = table(spark, sf, "events").select("event_id")
    schema = T.StructType([T.StructField("event_id", T.LongType())])
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        events.where(part).write.mode("append").parquet(source)
        flows.run_to_files(flows.stream_parquet(spark, source, schema), target, state)
    return spark.read.schema(schema).parquet(target)
