"""Bucketed series: resampling, differences, shocks, scaling, correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsewake.functions.times import bucket_start
from pulsewake.operators.ordering import number_in_order
from pulsewake.runtime import cut_lineage


def calendar(series: DataFrame, bucket: str, every: str, by: Sequence[str] = ()) -> DataFrame:
    """Every bucket between the first and the last one (per series)."""
    return (
        series.groupBy(*by)
        .agg(F.min(bucket).alias("_a"), F.max(bucket).alias("_b"))
        .select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {every}"))).alias(bucket))
    )


def fill_gaps(series: DataFrame, bucket: str, every: str, by: Sequence[str] = ()) -> DataFrame:
    """Empty buckets appear with null values."""
    return calendar(series, bucket, every, by).join(series, [*by, bucket], "left")


def bucket_mean(ticks: DataFrame, ts: str, value: str, every: str, by: Sequence[str] = (), gaps: bool = True) -> DataFrame:
    """Mean per bucket; averaged on the map side first, and gap-filled like a resample."""
    means = ticks.groupBy(*by, bucket_start(F.col(ts), every).alias("bucket")).agg(F.avg(value).alias(value))
    return fill_gaps(means, "bucket", every, by) if gaps else means


def bucket_volume(posts: DataFrame, ts: str, every: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bucket; empty buckets do not appear."""
    return posts.groupBy(*by, bucket_start(F.col(ts), every).alias("bucket")).agg(F.count("*").alias("volume"))


def lag_on_grid(series: DataFrame, value: str, every: str, by: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """Value of the bucket before, on a gap-filled grid.

    On a grid the previous row is known by name: each row also reports itself to the bucket after it
    and one aggregate per bucket brings both together. No task sees a whole series.
    """
    step = F.expr(f"INTERVAL {every}")
    empty = F.lit(None).cast(series.schema[value].dataType)
    reports = series.select(*by, F.inline(F.array(
        F.struct(F.col(bucket), F.col(value), empty.alias("lag"), F.lit(True).alias("_own")),
        F.struct((F.col(bucket) + step).alias(bucket), empty.alias(value), F.col(value).alias("lag"), F.lit(False).alias("_own")),
    )))
    return (
        reports.groupBy(*by, bucket)
        .agg(F.max(value).alias(value), F.max("lag").alias("lag"), F.max("_own").alias("_own"))
        .where("_own")
        .drop("_own")
    )


def delta_on_grid(series: DataFrame, value: str, every: str, by: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    return lag_on_grid(series, value, every, by, bucket).withColumn("delta", F.col(value) - F.col("lag"))


def delta_by_row(series: DataFrame, values: Sequence[str], bucket: str = "bucket", by: Sequence[str] = ()) -> DataFrame:
    """Lag and first difference against the previous surviving row, whatever its distance."""
    ordered = number_in_order(series, by, [bucket], carry=values)
    return ordered.select(
        *series.columns,
        *[F.col(f"prev_{v}").alias(f"{v}_lag") for v in values],
        *[(F.col(v) - F.col(f"prev_{v}")).alias(f"{v}_delta") for v in values],
    )


def shocks(deltas: DataFrame, *, absolute: float | None = None, relative: float | None = None, value: str = "close") -> DataFrame:
    """Buckets whose change passes the threshold (strictly); the relative form divides by the current value."""
    size = F.abs(F.col("delta"))
    if absolute is not None:
        deltas = deltas.where(size > absolute)
    if relative is not None:
        deltas = deltas.where(F.try_divide(size, F.col(value)) > relative)
    return deltas


def detect_shocks(ticks: DataFrame, ts: str, value: str, every: str, **threshold: float) -> DataFrame:
    """Ticks to shock events: bucket mean, gaps filled, difference, threshold."""
    return shocks(delta_on_grid(bucket_mean(ticks, ts, value, every), value, every), value=value, **threshold)


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """``(x - min) / (max - min)`` over the whole frame; a constant column becomes 0.

    Minimum and maximum come from one combinable aggregate used as a scalar subquery.
    """
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str):
        low, high = bounds.select(f"lo_{c}").scalar(), bounds.select(f"hi_{c}").scalar()
        return F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0)))

    return df.withColumns({f"{c}{suffix}": scaled(c) for c in columns})


def pearson(x: str, y: str) -> Column:
    """Pearson correlation over complete pairs; null for a constant column, where the built-in one fails."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Correlation of several column pairs in one pass."""
    return df.agg(*[pearson(x, y).alias(name) for name, (x, y) in pairs.items()])


def join_on_bucket(left: DataFrame, right: DataFrame, bucket: str = "bucket") -> DataFrame:
    return left.join(right, bucket, "inner")


def join_on_day(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, key: str = "day_of_month") -> DataFrame:
    """Left join on the day of month (collides across months) or on the full date."""
    part = F.dayofmonth if key == "day_of_month" else F.to_date
    a = left.withColumn(key, part(F.col(left_ts)))
    b = right.withColumn(key, part(F.col(right_ts)))
    return a.join(b, key, "left")


def lag_pairs(series: DataFrame, value: str, order: str = "bucket") -> DataFrame:
    """``(x, next x)`` pairs of the series in row order."""
    ordered = number_in_order(series.select(order, value), [], [order], carry=[value])
    return ordered.where(F.col(f"next_{value}").isNotNull()).select(
        order, F.col(value).alias("x"), F.col(f"next_{value}").alias("x_next")
    )


def _lagged_products(earlier: Column, later: Column) -> Column:
    """Sums of products of two blocks of numbers at every distance between their places: from ``later`` being
    ``size(earlier) - 1`` places behind to its being ``size(later) - 1`` places ahead."""

    def products(blocks: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([np.correlate(b, a, "full") for a, b in zip(blocks, others, strict=True)])

    return F.pandas_udf(products, "array<double>")(earlier, later)


def autocorrelation(
    series: DataFrame, value: str, order: str = "bucket", max_lag: int | None = None, block: int = 256
) -> DataFrame:
    """r(h) for every lag h, or up to ``max_lag``: Σ(xₜ−x̄)(xₜ₊ₕ−x̄) ÷ Σ(xₜ−x̄)².

    The series is cut into blocks of ``block`` values. Two blocks bring all lags between their members at once, so n values
    meet in n² ÷ 2·block² rows instead of n² ÷ 2, and the products are added up per lag on the map side. A ``max_lag`` leaves out
    the pairs of blocks further apart. A constant series has null for every lag, one of fewer than two values no lag.
    """
    if block < 1:
        raise ValueError("a block holds one value at least")
    series = cut_lineage(series.where(F.col(value).isNotNull()).select(order, value))
    ordered = cut_lineage(number_in_order(series, [], [order], position="t"))
    stats = ordered.agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.var_pop(value).alias("c0"))
    centred = ordered.select(F.col("t") - 1, (F.col(value) - stats.select("mean").scalar()).alias("d")).toDF("t", "d")
    listed = centred.groupBy(F.expr(f"t DIV {int(block)}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("t", "d"))).alias("values"))
    blocks = cut_lineage(listed.select("block", F.col("values.d").alias("d")))
    size = stats.select("n").scalar()
    furthest = (size - 1) if max_lag is None else F.least(size - 1, F.lit(max_lag))
    # values of two blocks are at least (apart - 1) * block + 1 from each other
    last = stats.select(F.expr(f"(n - 1) DIV {int(block)}").alias("last")).scalar()
    if max_lag is not None:
        last = F.least(last, F.col("block") + (max_lag + block - 1) // block)
    earlier = blocks.select(F.col("block").alias("first"), F.col("d").alias("a"), F.explode(F.sequence("block", last)).alias("block"))
    products = earlier.join(blocks, "block").select(
        (F.col("block") - F.col("first")).alias("apart"), F.size("a").alias("width"), F.posexplode(_lagged_products(F.col("a"), F.col("d"))).alias("place", "s")
    )
    lags = products.select((F.col("apart") * int(block) + F.col("place") - (F.col("width") - 1)).cast("int").alias("lag"), "s")
    return (
        lags.where((F.col("lag") >= 1) & (F.col("lag") <= furthest))
        .groupBy("lag")
        .agg(F.sum("s").alias("s"))
        .select("lag", F.try_divide(F.col("s"), size * stats.select("c0").scalar()).alias("r"))
    )
