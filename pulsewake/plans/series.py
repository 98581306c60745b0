"""Time-series and time-function queries."""

from pyspark.sql import functions as F

from pulsewake.functions import times as tm
from pulsewake.operators import ordering
from pulsewake.operators import timeseries as tsr
from pulsewake.plans.inputs import cte, given, table
from pulsewake.plans.registry import query
from pulsewake.plans.storage import RAW_SQL, raw_posts
from pulsewake.runtime import cut_lineage

_HOURLY = cte("ticks", "views") + """, m AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, avg(close) AS close FROM ticks GROUP BY 1),
  cal AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM m),
  grid AS (SELECT bucket, close FROM cal LEFT JOIN m USING (bucket)),
  d AS (SELECT bucket, close, lag(close) OVER (ORDER BY bucket) AS lag, close - lag(close) OVER (ORDER BY bucket) AS delta FROM grid),
  v AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS volume FROM views GROUP BY 1),
  both_ AS (SELECT bucket, close, delta, volume FROM d JOIN v USING (bucket)),
  full_ AS (SELECT *, volume - lag(volume) OVER (ORDER BY bucket) AS dvolume, close - lag(close) OVER (ORDER BY bucket) AS dclose
            FROM both_ WHERE close IS NOT NULL AND delta IS NOT NULL)
"""


def hourly(spark, sf):
    """Gap-filled hourly price."""
    return tsr.bucket_mean(given(spark, sf, "ticks"), "ts", "close", "1 hour")


def deltas(spark, sf):
    return tsr.delta_on_grid(hourly(spark, sf), "close", "1 hour")


def volume(spark, sf):
    return tsr.bucket_volume(given(spark, sf, "views"), "ts", "1 hour")


def combined(spark, sf):
    """Volume beside price and price change, complete rows only."""
    return tsr.join_on_bucket(deltas(spark, sf).drop("lag"), volume(spark, sf)).na.drop()


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a08_bucket_mean", _HOURLY + "SELECT bucket, round(close, 6) AS close FROM grid")
def a08(spark, sf):
    return _rounded(hourly(spark, sf), "close")


@query("a08_bucket_mean_by_type", """WITH m AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS bucket, avg(value) AS value FROM events GROUP BY 1, 2)
  SELECT event_type, bucket, round(value, 6) AS value FROM m""")
def a08_by(spark, sf):
    return _rounded(tsr.bucket_mean(table(spark, sf, "events"), "ts", "value", "1 day", by=["event_type"], gaps=False), "value")


@query("a09_bucket_volume", """WITH h AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS volume FROM events WHERE event_type = 'view' GROUP BY 1) SELECT * FROM h""")
def a09(spark, sf):
    return tsr.bucket_volume(given(spark, sf, "views"), "ts", "15 minutes")


@query("w01_lag", _HOURLY + "SELECT bucket, round(lag, 6) AS lag FROM d")
def w01(spark, sf):
    return _rounded(tsr.lag_on_grid(hourly(spark, sf), "close", "1 hour").select("bucket", "lag"), "lag")


@query("w01_lag_by_surviving_row", _HOURLY + "SELECT bucket, volume, CAST(lag(volume) OVER (ORDER BY bucket) AS BIGINT) AS volume_lag FROM v")
def w01_rows(spark, sf):
    return tsr.delta_by_row(volume(spark, sf), ["volume"]).select("bucket", "volume", "volume_lag")


@query("w02_first_difference", _HOURLY + "SELECT bucket, round(delta, 6) AS delta FROM d")
def w02(spark, sf):
    return _rounded(deltas(spark, sf).select("bucket", "delta"), "delta")


@query("w03_gap_fill", """WITH v AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, count(*) AS volume FROM events GROUP BY 1, 2),
  c AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM v GROUP BY 1)
  SELECT event_type, bucket, volume FROM c LEFT JOIN v USING (event_type, bucket)""")
def w03(spark, sf):
    counts = tsr.bucket_volume(table(spark, sf, "events"), "ts", "1 hour", by=["event_type"])
    return tsr.fill_gaps(counts, "bucket", "1 hour", ["event_type"])


_ACF = cte("ticks") + """, s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, avg(close) AS x FROM ticks GROUP BY 1),
  n AS (SELECT row_number() OVER (ORDER BY bucket) AS t, x - (SELECT avg(x) FROM s) AS d FROM s)
"""


@query("w04_autocorrelation", _ACF + """SELECT CAST(b.t - a.t AS INT) AS lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM n), 6) AS r
  FROM n a JOIN n b ON b.t > a.t GROUP BY 1""")
def w04(spark, sf):
    series = tsr.bucket_mean(given(spark, sf, "ticks"), "ts", "close", "1 hour", gaps=False)
    return _rounded(tsr.autocorrelation(series, "close"), "r")


@query("w04_lag_pairs", _ACF + "SELECT bucket, round(x, 6) AS x, round(x_next, 6) AS x_next FROM (SELECT bucket, x, lead(x) OVER (ORDER BY bucket) AS x_next FROM s) WHERE x_next IS NOT NULL")
def w04_pairs(spark, sf):
    series = tsr.bucket_mean(given(spark, sf, "ticks"), "ts", "close", "1 hour", gaps=False)
    return _rounded(tsr.lag_pairs(series, "close"), "x", "x_next")


@query("f10_shock_absolute", _HOURLY + "SELECT bucket, round(delta, 6) AS delta FROM d WHERE abs(delta) > 100")
def f10(spark, sf):
    return _rounded(tsr.shocks(deltas(spark, sf), absolute=100).select("bucket", "delta"), "delta")


@query("f11_shock_relative", _HOURLY + "SELECT bucket, round(delta, 6) AS delta FROM d WHERE abs(delta) / close > 1.0")
def f11(spark, sf):
    return _rounded(tsr.shocks(deltas(spark, sf), relative=1.0).select("bucket", "delta"), "delta")


@query("c02_shock_detection", _HOURLY + "SELECT bucket, round(close, 6) AS close, round(lag, 6) AS lag, round(delta, 6) AS delta FROM d WHERE abs(delta) / close > 1.0")
def c02(spark, sf):
    return _rounded(tsr.detect_shocks(given(spark, sf, "ticks"), "ts", "close", "1 hour", relative=1.0), "close", "lag", "delta")


@query("f12_label_slice", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-09 07:01:00'")
def f12(spark, sf):
    return table(spark, sf, "events").where(tm.label_slice(F.col("ts"), "2024-01-05 12:00:00", "2024-01-09 07:00:00")).select("event_id", "ts")


@query("f12_label_slice_open", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-18'")
def f12_open(spark, sf):
    return table(spark, sf, "events").where(tm.label_slice(F.col("ts"), "2024-01-18 00:00:00", None, "DAY")).select("event_id", "ts")


@query("j06_volume_and_price", _HOURLY + "SELECT bucket, round(close, 6) AS close, volume FROM grid JOIN v USING (bucket)")
def j06(spark, sf):
    return _rounded(tsr.join_on_bucket(hourly(spark, sf), volume(spark, sf)), "close")


@query("a13_correlation", _HOURLY + "SELECT nullif(round(corr(volume, close), 6), 'nan'::DOUBLE) AS volume_close, nullif(round(corr(volume, abs(delta)), 6), 'nan'::DOUBLE) AS volume_change FROM full_")
def a13(spark, sf):
    rows = combined(spark, sf).withColumn("change", F.abs("delta"))
    out = tsr.correlation(rows, {"volume_close": ("volume", "close"), "volume_change": ("volume", "change")})
    return _rounded(out, "volume_close", "volume_change")


@query("x11_min_max_scale", "SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 6) AS value_scaled, 0.0::DOUBLE AS one_scaled FROM events")
def x11(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", F.lit(1.0).alias("one"))
    return _rounded(tsr.min_max_scale(rows, ["value", "one"]).select("event_id", "value_scaled", "one_scaled"), "value_scaled")


@query("c08_volume_price_study", _HOURLY + """SELECT nullif(round(corr(volume, close), 6), 'nan'::DOUBLE) AS volume_close, nullif(round(corr(volume, abs(delta)), 6), 'nan'::DOUBLE) AS volume_change,
  nullif(round(corr(dvolume, dclose), 6), 'nan'::DOUBLE) AS dvolume_dclose, count(*) AS hours,
  round(avg(CASE WHEN (SELECT max(volume) = min(volume) FROM full_) THEN 0.0::DOUBLE ELSE (volume - (SELECT min(volume) FROM full_)) / ((SELECT max(volume) FROM full_) - (SELECT min(volume) FROM full_)) END), 6) AS mean_scaled_volume FROM full_""")
def c08(spark, sf):
    """Distinct posts, hourly volume, hourly price, join, differences, scaling, correlation."""
    rows = cut_lineage(combined(spark, sf))  # one row per hour, used several times below
    changes = tsr.delta_by_row(rows, ["volume", "close"]).withColumn("change", F.abs("delta"))
    scaled = tsr.min_max_scale(changes.withColumn("volume", F.col("volume").cast("double")), ["volume"])
    return scaled.agg(
        F.round(tsr.pearson("volume", "close"), 6).alias("volume_close"),
        F.round(tsr.pearson("volume", "change"), 6).alias("volume_change"),
        F.round(tsr.pearson("volume_delta", "close_delta"), 6).alias("dvolume_dclose"),
        F.count("*").alias("hours"),
        F.round(F.avg("volume_scaled"), 6).alias("mean_scaled_volume"),
    )


@query("o05_nth_in_time_order", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 499")
def o05_nth(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts")
    return ordering.nth_in_order(rows, ["ts", "event_id"], 500)


# -- time functions -----------------------------------------------------------------------------------


@query("x01_parse_post_time", RAW_SQL + "SELECT id_str, date_trunc('second', ts) AS at FROM raw")
def x01(spark, sf):
    return raw_posts(spark, sf).select("id_str", tm.parse_post_time(F.col("created_at")).alias("at"))


_FORMS = ["%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %I:%M%p", "%A, %B %-d, %Y,  %-I:%M %p", "soon"]


@query("x02_parse_any_date", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS at FROM events")
def x02(spark, sf):
    """The same moment written in several ways."""
    k, ts = F.col("event_id") % 5, F.col("ts")
    text = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "MM/dd/yyyy hh:mma")).when(k == 3, F.date_format(ts, "EEEE, MMMM d, yyyy,  h:mm a")).otherwise("soon")
    )
    return table(spark, sf, "events").select("event_id", tm.parse_wall_time(text).alias("at"))


@query("x03_from_millis", "SELECT event_id, epoch_ms(event_id * 86400123) AS at FROM events")
def x03(spark, sf):
    return table(spark, sf, "events").select("event_id", tm.from_millis(F.col("event_id") * 86400123).alias("at"))


@query("x04_zone_convert", "SELECT event_id, ts + INTERVAL 8 HOUR AS local FROM events")
def x04(spark, sf):
    return table(spark, sf, "events").select("event_id", tm.shift_zone(F.col("ts"), "UTC", "Asia/Singapore").alias("local"))


@query("x05_date_key", "SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS id_date FROM events")
def x05(spark, sf):
    return table(spark, sf, "events").select("event_id", tm.date_key(F.col("ts")).alias("id_date"))


@query("x06_truncate", "SELECT event_id, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def x06(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id", tm.hour_start(ts).alias("hour"), tm.bucket_start(ts, "15 minutes").alias("quarter"), F.to_date(ts).cast("string").alias("day")
    )


@query("x07_local_days", """SELECT event_id, CAST(epoch(date_trunc('minute', ts) - INTERVAL 8 HOUR) AS BIGINT) AS epoch, CAST(CAST(ts + INTERVAL 8 HOUR - INTERVAL 1 DAY AS DATE) AS VARCHAR) || ' 00:00' AS start,
  CAST(CAST(ts AS DATE) AS VARCHAR) || ' 00:00' AS stop FROM events""")
def x07(spark, sf):
    ts = F.col("ts")
    rows = table(spark, sf, "events").select(
        "event_id", tm.local_text_to_epoch(F.date_format(ts, "yyyy-MM-dd HH:mm"), "Asia/Singapore").alias("epoch"),
        tm.day_bounds_text(tm.local_day(ts, "Asia/Singapore", -1), F.to_date(ts)).alias("b"),
    )
    return rows.select("event_id", "epoch", "b.start", "b.stop")


@query("x07_day_steps", """WITH r AS (SELECT event_type, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events GROUP BY 1), s AS (SELECT event_type, unnest(generate_series(a, b - 1, INTERVAL 1 DAY)) AS d FROM r)
  SELECT event_type, CAST(CAST(d AS DATE) AS VARCHAR) AS since, CAST(CAST(d + INTERVAL 1 DAY AS DATE) AS VARCHAR) AS until FROM s""")
def x07_steps(spark, sf):
    spans = table(spark, sf, "events").groupBy("event_type").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    steps = spans.select("event_type", F.inline(tm.day_steps(F.col("a"), F.col("b"))))
    return steps.withColumns({"since": F.col("since").cast("string"), "until": F.col("until").cast("string")})
