"""Influence score queries."""

from pyspark.sql import functions as F

from pulsewake.functions.times import minutes_before
from pulsewake.operators import articles as art
from pulsewake.operators import influence as inf
from pulsewake.operators import timeseries as tsr
from pulsewake.operators import windows as win
from pulsewake.operators.ordering import number_in_order
from pulsewake.plans.inputs import BANDWIDTH, EVENTS, PERIOD, cte, given, table
from pulsewake.plans.registry import query
from pulsewake.runtime import scratch_path
from pulsewake.sources import sinks

_NUMBER = "CASE " + " ".join(
    f"WHEN ts BETWEEN TIMESTAMP '{e}' - INTERVAL {BANDWIDTH} MINUTE AND TIMESTAMP '{e}' THEN {i}" for i, e in enumerate(EVENTS, 1)
) + " ELSE 0 END"
_SAMPLE = cte("pubs") + f""", sample AS (
  SELECT *, {_NUMBER} AS w FROM pubs WHERE ts BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}')"""
_SCORES = _SAMPLE + """, scores AS (
  SELECT user_id, count(*) AS total_nbr_publish,
         count(*) FILTER (w <> 0) AS total_nbr_publish_in_golden_window,
         count(DISTINCT CASE WHEN w <> 0 THEN w END) AS nbr_golden_window_hit
  FROM sample GROUP BY user_id), final AS (
  SELECT *, round(total_nbr_publish_in_golden_window / total_nbr_publish * nbr_golden_window_hit / 4.0::DOUBLE, 9) AS wtf FROM scores)
"""


def _sample(spark, sf):
    return inf.sample_with_windows(given(spark, sf, "pubs"), "ts", PERIOD, EVENTS, BANDWIDTH)


def _scores(spark, sf):
    return inf.influence_score(given(spark, sf, "pubs"), "user_id", "ts", PERIOD, EVENTS, BANDWIDTH)


@query("c01_influence_score", _SCORES + "SELECT * FROM final")
def c01(spark, sf):
    return _scores(spark, sf).withColumn("wtf", F.round("wtf", 9))


@query("c01_influence_by_bandwidth", cte("pubs") + ", b AS (SELECT unnest([15, 30, 180]) AS bw), e AS (SELECT unnest([" + ",".join(f"TIMESTAMP '{e}'" for e in EVENTS) + f"""]) AS ev, unnest([1,2,3,4]) AS w),
  tagged AS (SELECT user_id, event_id, bw, coalesce(min(w), 0) AS w FROM (
      SELECT p.user_id, p.event_id, b.bw, e.w FROM (SELECT * FROM pubs WHERE ts BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}') p
      CROSS JOIN b LEFT JOIN e ON p.ts <= e.ev AND p.ts >= e.ev - to_minutes(b.bw)) GROUP BY ALL)
  SELECT user_id, CAST(bw AS INT) AS bandwidth_before_event_mins, count(*) AS total_nbr_publish,
         count(*) FILTER (w <> 0) AS total_nbr_publish_in_golden_window,
         count(DISTINCT w) FILTER (w <> 0) AS nbr_golden_window_hit,
         round(count(*) FILTER (w <> 0) / count(*) * (count(DISTINCT w) FILTER (w <> 0)) / 4.0::DOUBLE, 9) AS wtf
  FROM tagged GROUP BY user_id, bw""")
def c01_bandwidths(spark, sf):
    scores = inf.influence_by_bandwidth(given(spark, sf, "pubs"), "user_id", "ts", PERIOD, EVENTS, [15, 30, 180])
    return scores.withColumn("wtf", F.round("wtf", 9))


@query("c02_shock_influence", cte("pubs", "ticks") + f""", m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, avg(close) AS close FROM ticks GROUP BY 1),
  cal AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM m),
  d AS (SELECT bucket, close, close - lag(close) OVER (ORDER BY bucket) AS delta FROM cal LEFT JOIN m USING (bucket)),
  ev AS (SELECT bucket FROM d WHERE abs(delta) / close > 1.0),
  tagged AS (SELECT user_id, (SELECT min(bucket) FROM ev WHERE ev.bucket >= p.ts AND ev.bucket - INTERVAL 60 MINUTE <= p.ts) AS w
             FROM pubs p WHERE ts BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}')
  SELECT user_id, count(*) AS total_nbr_publish, count(w) AS total_nbr_publish_in_golden_window,
         count(DISTINCT w) AS nbr_golden_window_hit,
         round(count(w) / count(*) * count(DISTINCT w) / (SELECT count(*) FROM ev), 9) AS wtf
  FROM tagged GROUP BY user_id""")
def c02_c01(spark, sf):
    """Shocks found in the price series feed the score: no event is picked by eye."""
    events = tsr.detect_shocks(given(spark, sf, "ticks"), "ts", "close", "1 hour", relative=1.0).select("bucket")
    scores = inf.influence_of_events(given(spark, sf, "pubs"), events, "user_id", "ts", "bucket", PERIOD, 60)
    return scores.withColumn("wtf", F.round("wtf", 9))


_NEWS_EVENTS = ["2024-01-05 00:00:00", "2024-01-11 12:00:00", "2024-01-20 00:00:00"]
_NEWS_NUMBER = "CASE " + " ".join(
    f"WHEN ts BETWEEN TIMESTAMP '{e}' - INTERVAL 1440 MINUTE AND TIMESTAMP '{e}' THEN {i}" for i, e in enumerate(_NEWS_EVENTS, 1)
) + " ELSE 0 END"


@query("c01_news_score_per_domain", cte("articles") + f""", once AS (
    SELECT source_domain, CAST(date_publish AS TIMESTAMP) AS ts FROM articles
    QUALIFY row_number() OVER (PARTITION BY date_publish, title, description, source_domain ORDER BY url) = 1),
  sample AS (SELECT *, {_NEWS_NUMBER} AS w FROM once WHERE ts BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}')
  SELECT source_domain, count(*) AS total_nbr_publish, count(*) FILTER (w <> 0) AS total_nbr_publish_in_golden_window,
         count(DISTINCT CASE WHEN w <> 0 THEN w END) AS nbr_golden_window_hit,
         round(count(*) FILTER (w <> 0) / count(*) * count(DISTINCT CASE WHEN w <> 0 THEN w END) / 3.0::DOUBLE, 9) AS wtf
  FROM sample GROUP BY 1""")
def c01_news(spark, sf):
    """News sites from end to end: Parquet, date cast, distinct on four keys, score per site, one CSV."""
    path = scratch_path(spark, "news")
    given(spark, sf, "articles").write.parquet(f"{path}/articles")
    stored = spark.read.parquet(f"{path}/articles").withColumnRenamed("date_publish", "date_publish_str")
    dated = stored.withColumn("date_publish", F.col("date_publish_str").cast("timestamp_ntz"))
    once = art.distinct_articles(dated, art.ARTICLE_KEYS_WITHOUT_AUTHORS)
    scores = inf.influence_score(once, "source_domain", "date_publish", PERIOD, _NEWS_EVENTS, 1440).withColumn("wtf", F.round("wtf", 9))
    sinks.write_result_csv(scores, f"{path}/scores", single_file=True)
    return spark.read.schema(scores.schema).csv(f"{path}/scores", header=True)


@query("f01_sample_period", _SAMPLE + "SELECT event_id, user_id, ts FROM sample")
def f01(spark, sf):
    return _sample(spark, sf).select("event_id", "user_id", "ts")


@query("f02_golden_window_flag", _SAMPLE + "SELECT event_id, CAST(w > 0 AS INT) AS publish_in_golden_window, w AS golden_window FROM sample")
def f02(spark, sf):
    return _sample(spark, sf).select("event_id", "publish_in_golden_window", "golden_window")


@query("f16_zero_filter", _SAMPLE + "SELECT event_id, w AS golden_window FROM sample WHERE w <> 0")
def f16(spark, sf):
    return _sample(spark, sf).where(F.col("golden_window") != 0).select("event_id", "golden_window")


@query("p11_conditional_column", _SAMPLE + "SELECT event_id, CASE WHEN w > 0 THEN 1 ELSE 0 END AS publish_in_golden_window FROM sample")
def p11(spark, sf):
    flag = win.in_any_window(F.col("ts"), win.golden_windows(EVENTS, BANDWIDTH))
    return _sample(spark, sf).select("event_id", flag.alias("publish_in_golden_window"))


@query("p05_constant_column", _SCORES + f"SELECT *, {BANDWIDTH} AS bandwidth_before_event_mins FROM final")
def p05(spark, sf):
    return c01(spark, sf).withColumn("bandwidth_before_event_mins", F.lit(BANDWIDTH))


@query("a01_count_per_agent", _SAMPLE + "SELECT user_id, count(*) AS total_nbr_publish FROM sample GROUP BY 1")
def a01(spark, sf):
    return _sample(spark, sf).groupBy("user_id").agg(F.count("*").alias("total_nbr_publish"))


@query("a02_count_in_window", _SAMPLE + "SELECT user_id, count(*) AS total_nbr_publish_in_golden_window FROM sample WHERE w > 0 GROUP BY 1")
def a02(spark, sf):
    inside = _sample(spark, sf).where("publish_in_golden_window = 1")
    return inside.groupBy("user_id").agg(F.count("*").alias("total_nbr_publish_in_golden_window"))


@query("a03_windows_hit", _SAMPLE + "SELECT user_id, count(DISTINCT w) AS nbr_golden_window_hit FROM sample WHERE w > 0 GROUP BY 1")
def a03(spark, sf):
    inside = _sample(spark, sf).where("golden_window <> 0")
    return inside.groupBy("user_id").agg(F.countDistinct("golden_window").alias("nbr_golden_window_hit"))


@query("j01_score_assembly", _SAMPLE + """
  SELECT t.user_id, t.n AS total_nbr_publish, coalesce(i.n, 0) AS total_nbr_publish_in_golden_window, coalesce(h.n, 0) AS nbr_golden_window_hit
  FROM (SELECT user_id, count(*) AS n FROM sample GROUP BY 1) t
  LEFT JOIN (SELECT user_id, count(*) AS n FROM sample WHERE w > 0 GROUP BY 1) i USING (user_id)
  LEFT JOIN (SELECT user_id, count(DISTINCT w) AS n FROM sample WHERE w > 0 GROUP BY 1) h USING (user_id)""")
def j01(spark, sf):
    """Three aggregates and two left joins, fused into one aggregation."""
    return _scores(spark, sf).drop("wtf")


@query("f14_fill_nulls", _SAMPLE + """
  SELECT t.user_id, t.n AS total_nbr_publish, coalesce(i.n, 0) AS total_nbr_publish_in_golden_window
  FROM (SELECT user_id, count(*) AS n FROM sample GROUP BY 1) t
  LEFT JOIN (SELECT user_id, count(*) AS n FROM sample WHERE w > 0 GROUP BY 1) i USING (user_id)""")
def f14(spark, sf):
    return a01(spark, sf).join(a02(spark, sf), "user_id", "left").fillna({"total_nbr_publish_in_golden_window": 0})


@query("j02_display_name", _SCORES + "SELECT c_name, f.* FROM final f LEFT JOIN customer c ON f.user_id = c.c_custkey")
def j02(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return inf.with_display_name(_scores(spark, sf), names, "user_id", "c_name").withColumn("wtf", F.round("wtf", 9))


@query("o01_sort_by_score", _SCORES + "SELECT *, row_number() OVER (ORDER BY wtf DESC, user_id) AS place FROM final")
def o01(spark, sf):
    """The whole ranking, with the place made visible."""
    ranked = c01(spark, sf).withColumn("neg", -F.col("wtf"))
    placed = number_in_order(ranked, [], ["neg", "user_id"], position="place")
    return placed.select("user_id", *inf.SCORE_COLUMNS, "place").orderBy("place")


@query("o05_limit_top_k", cte("pubs") + "SELECT event_id, ts FROM pubs ORDER BY ts DESC, event_id LIMIT 10")
def o05(spark, sf):
    return given(spark, sf, "pubs").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10)


@query("j05_range_join", cte("pubs", "ticks") + """, big AS (SELECT row_number() OVER (ORDER BY close DESC, event_id) AS window_id, ts FROM ticks WHERE close > 200)
  SELECT event_id, coalesce((SELECT min(window_id) FROM big b WHERE p.ts BETWEEN b.ts - INTERVAL 30 MINUTE AND b.ts), 0) AS golden_window FROM pubs p""")
def j05(spark, sf):
    """Windows of every large trade, many and overlapping; the largest trade wins."""
    big = given(spark, sf, "ticks").where("close > 200")
    numbered = number_in_order(
        big.withColumn("neg", -F.col("close")), [], ["neg", "event_id"], position="window_id"
    )
    windows = win.windows_from_events(numbered, "ts", 30)
    return win.tag_with_windows(given(spark, sf, "pubs"), windows, "ts", "event_id").select("event_id", "golden_window")


ORACLE_NEAR = cte("pubs", "ticks") + """
  SELECT p.event_id, b.event_id AS trade_id FROM pubs p JOIN ticks b ON p.ts BETWEEN b.ts - INTERVAL 30 MINUTE AND b.ts AND b.close > 200"""


@query("j15_publications_before_events", ORACLE_NEAR)
def j15(spark, sf, rows_per_task=100_000):
    """Batch form of the stream-stream interval join; crowded hours are spread by their number of publications."""
    big = given(spark, sf, "ticks").where("close > 200").select(F.col("event_id").alias("trade_id"), F.col("ts").alias("event_ts"))
    pubs = given(spark, sf, "pubs").select("event_id", "ts")
    busy = win.busy_hours(pubs, "ts", rows_per_task)
    return win.pairs_within(pubs, big, "ts", "event_ts", 30, busy=busy).select("event_id", "trade_id")


@query("x08_minutes_before_event", _SAMPLE + f"SELECT event_id, ts - INTERVAL {BANDWIDTH} MINUTE AS window_start FROM sample")
def x08(spark, sf):
    return _sample(spark, sf).select("event_id", minutes_before(F.col("ts"), BANDWIDTH).alias("window_start"))


@query("x10_arithmetic", cte("ticks") + """
  SELECT event_id, round(abs(close - 50), 6) AS distance, round(close / 7, 6) AS ratio, round(close * 1.5::DOUBLE, 6) AS product,
         CASE WHEN close > 50 THEN NULL ELSE round(1.0::DOUBLE / 3, 6) END AS guarded FROM ticks""")
def x10(spark, sf):
    zero = F.when(F.col("close") > 50, 0.0).otherwise(3.0)
    return given(spark, sf, "ticks").select(
        "event_id", F.round(F.abs(F.col("close") - 50), 6).alias("distance"), F.round(F.col("close") / 7, 6).alias("ratio"),
        F.round(F.col("close") * 1.5, 6).alias("product"), F.round(F.try_divide(F.lit(1.0), zero), 6).alias("guarded"),
    )
