from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsewake.functions import times as tm
from pulsewake.operators import accounts as acc
from pulsewake.operators import relational as rel
from pulsewake.operators import stats as st
from pulsewake.operators import timeseries as tsr

T0 = datetime(2024, 3, 1)


def ticks(spark, points):
    return spark.createDataFrame([(T0 + timedelta(minutes=m), float(v) if v is not None else None) for m, v in points], "ts timestamp_ntz, close double")


def test_empty_hour_is_filled_and_breaks_the_difference(spark):
    series = tsr.bucket_mean(ticks(spark, [(0, 10), (30, 20), (125, 40), (190, 100)]), "ts", "close", "1 hour")
    got = {r.bucket.hour: (r.close, r.lag, r.delta) for r in tsr.delta_on_grid(series, "close", "1 hour").collect()}
    assert got == {0: (15.0, None, None), 1: (None, 15.0, None), 2: (40.0, None, None), 3: (100.0, 40.0, 60.0)}


def test_volume_has_no_empty_buckets(spark):
    volume = tsr.bucket_volume(ticks(spark, [(0, 1), (1, 1), (125, 1)]), "ts", "1 hour")
    assert sorted((r.bucket.hour, r.volume) for r in volume.collect()) == [(0, 2), (2, 1)]


def test_shocks_are_strict_and_drop_unknown_changes(spark):
    d = spark.createDataFrame([(1, 100.0, 1000.0), (2, 100.0, 1000.1), (3, 0.0, 5.0), (4, 50.0, None)], "id int, close double, delta double")
    assert [r.id for r in tsr.shocks(d, absolute=1000).collect()] == [2]
    assert sorted(r.id for r in tsr.shocks(d, relative=9.9).collect()) == [1, 2]


def test_autocorrelation_equals_numpy(spark):
    x = np.random.RandomState(1).rand(40)
    series = spark.createDataFrame([(T0 + timedelta(days=i), float(v)) for i, v in enumerate(x)], "bucket timestamp_ntz, close double")
    got = {r.lag: r.r for r in tsr.autocorrelation(series, "close").collect()}
    d = x - x.mean()
    assert set(got) == set(range(1, 40))
    for lag, r in got.items():
        assert r == pytest.approx((d[:-lag] * d[lag:]).sum() / (d * d).sum())
    assert {r.lag for r in tsr.autocorrelation(series, "close", max_lag=3).collect()} == {1, 2, 3}


@pytest.mark.parametrize(("n", "block", "max_lag"), [(40, 7, None), (40, 8, 17), (41, 1, 5), (40, 40, None), (100, 16, 16), (9, 4, 100)])
def test_autocorrelation_in_blocks(spark, n, block, max_lag):
    x = np.random.RandomState(n).rand(n)
    rows = [(T0 + timedelta(days=i), float(v)) for i, v in enumerate(x)] + [(T0 - timedelta(days=1), None)]
    got = {r.lag: r.r for r in tsr.autocorrelation(spark.createDataFrame(rows, "bucket timestamp_ntz, close double"), "close", max_lag=max_lag, block=block).collect()}
    d = x - x.mean()
    assert got == pytest.approx({lag: (d[:-lag] * d[lag:]).sum() / (d * d).sum() for lag in range(1, min(n - 1, max_lag or n) + 1)})


def test_autocorrelation_of_nothing_and_of_a_constant(spark):
    series = lambda *values: spark.createDataFrame([(T0 + timedelta(days=i), v) for i, v in enumerate(values)], "bucket timestamp_ntz, close double")
    assert tsr.autocorrelation(series(), "close").collect() == []
    assert tsr.autocorrelation(series(1.0), "close").collect() == []
    assert {r.lag: r.r for r in tsr.autocorrelation(series(2.0, 2.0, 2.0), "close").collect()} == {1: None, 2: None}


def test_scaling_and_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (2.0, None)], "x double, c double")
    rows = sorted((r.x_scaled, r.c_scaled) for r in tsr.min_max_scale(df.na.drop(), ["x", "c"]).collect())
    assert rows == [(0.0, 0.0), (1.0, 0.0)]
    assert tsr.correlation(df, {"r": ("x", "c")}).first().r is None
    pair = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 7.0), (4.0, None)], "x double, c double")
    assert tsr.correlation(pair, {"r": ("x", "c")}).first().r == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 7])[0, 1])


def test_label_slice_covers_the_last_unit(spark):
    rows = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in (59, 60, 119, 120)], "ts timestamp_ntz")
    kept = rows.where(tm.label_slice(F.col("ts"), "2024-03-01 00:01:00", "2024-03-01 00:01:00"))
    assert kept.count() == 2


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_percentiles_equal_numpy(spark, size):
    values = np.random.RandomState(size).randint(0, 50, size) / 4
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.p: r.value for r in st.exact_percentiles(df, "x", probabilities).collect()}
    assert got == pytest.approx({p: float(np.percentile(values, 100 * p)) for p in probabilities})


def test_percentiles_beyond_the_sketch(spark):
    """More rows than the sketch can hold exactly, a third of them one value."""
    values = np.concatenate([np.random.RandomState(5).rand(20000), np.full(10000, 0.5)])
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(6)
    probabilities = [0.001, 0.3, 0.5, 0.9, 0.9999]
    got = {r.p: r.value for r in st.exact_percentiles(df, "x", probabilities, accuracy=200).collect()}
    assert got == pytest.approx({p: float(np.percentile(values, 100 * p)) for p in probabilities})


def test_summary_counts_nulls_and_text(spark):
    df = spark.createDataFrame([(1, "b"), (3, None), (None, "a")], "n int, s string")
    rows = {r["column"]: r for r in st.summary(df, ["n", "s"]).collect()}
    assert (rows["n"]["count"], rows["n"]["mean"], rows["s"]["min"], rows["s"]["mean"]) == (2, 2.0, "a", None)
    assert st.null_counts(df).first().asDict() == {"n": 1, "s": 1}


def test_all_rows_of_the_maximum(spark):
    df = spark.createDataFrame([(1, 5), (2, 7), (3, 7)], "id int, v int")
    assert sorted(r.id for r in st.rows_holding_max(df, "v").collect()) == [2, 3]


def test_follower_band_bounds_are_whole_and_inclusive(spark):
    rows = [(str(i), float(i)) for i in range(1, 11)] + [("5", 5.0)]
    band = acc.follower_band(spark.createDataFrame(rows, "id string, n float"), "id", "n").collect()
    # quantiles 5.5 and 7.75 become 5 and 7
    assert [r.n for r in band] == [7.0, 6.0, 5.0]


def test_keep_first_and_last_treat_null_keys_alike(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 1, None), ("k", 3, "c")], "k string, t int, v string")
    assert sorted((str(r.k), r.v) for r in rel.keep_first(df, ["k"], ["t"]).collect()) == [("None", "a"), ("k", None)]
    assert sorted((str(r.k), r.v) for r in rel.keep_last(df, ["k"], ["t"]).collect()) == [("None", "b"), ("k", "c")]


def test_null_column_does_not_veto_a_keyword(spark):
    df = spark.createDataFrame([(1, None, "all about Bitcoin", None), (2, None, None, None), (3, "nothing", None, None)],
                               "id int, title string, maintext string, description string")
    assert [r.id for r in df.transform(rel.matches_any("(?i)bitcoin")).collect()] == [1]


def test_named_accounts_without_posts_show_zero(spark):
    names = spark.createDataFrame([("Ann",), ("bob",)], "handle string")
    posts = spark.createDataFrame([("ANN",), ("ann",)], "handle string")
    assert sorted(map(tuple, rel.counts_of_accounts(names, posts).collect())) == [("Ann", 2), ("bob", 0)]


def test_publish_date_filter_keeps_unreadable_dates_unless_strict(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, None), (3, "soon"), (4, "2024-01-02 00:00:01"), (5, "2024-01-02 00:00:00")], "id int, d string")
    kept = lambda strict: sorted(r.id for r in rel.published_between(df, "d", "2024-01-01 00:00:00", "2024-01-02 00:00:00", strict).collect())
    assert kept(False) == [1, 2, 3, 5] and kept(True) == [1, 5]


@pytest.mark.parametrize("text,want", [
    ("2015-11-26T07:11:02Z", "2015-11-26 07:11:02"), ("201511261006", "2015-11-26 10:06:00"), ("2015-11-25T19:56:04+0530", "2015-11-25 19:56:04"),
    ("2015-11-26T11:53:00.000Z", "2015-11-26 11:53:00"), ("Thursday, November 26, 2015,  6:42 AM", "2015-11-26 06:42:00"),
    ("2015-11-26T14:42Z", "2015-11-26 14:42:00"), ("11/24/2015 01:05AM", "2015-11-24 01:05:00"), ("Thu, 26 Nov 2015 10:11:12 GMT", "2015-11-26 10:11:12"),
    ("2015-13-45", None), ("", None), ("None", None),
])
def test_dates_in_free_form(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(tm.parse_wall_time(F.col("s")).cast("string").alias("t")).first().t
    assert got == want


def test_post_time(spark):
    df = spark.createDataFrame([("Wed May 26 07:21:12 +0000 2021",), ("Sat May 1 7:01:02 +0000 2021",), ("yesterday",), (None,)], "s string")
    got = [r.t for r in df.select(tm.parse_post_time(F.col("s")).cast("string").alias("t")).collect()]
    assert got == ["2021-05-26 07:21:12", "2021-05-01 07:01:02", None, None]
