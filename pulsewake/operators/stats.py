"""Whole-frame statistics whose memory does not grow with the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewake.operators.ordering import running_total
from pulsewake.runtime import cut_lineage


def exact_percentiles(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int = 100_000) -> DataFrame:
    """Exact percentiles with linear interpolation, as rows ``(p, value)``.

    The built-in exact percentile keeps every distinct value in one task. Here a mergeable sketch gives
    a bracket that surely holds the wanted rank (its error is bounded), one count tells how many values lie below it, and only
    the values inside the bracket (about ``8 / accuracy`` of the rows, repeated values already folded)
    are put in order, range by range, so no task holds a whole bracket.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    margin = 4.0 / accuracy
    ends = [(max(p - margin, 0.0), min(p + margin, 1.0)) for p in probabilities]
    sketch = values.agg(
        F.count("*").alias("n"),
        F.min("x").alias("lowest"),
        F.max("x").alias("highest"),
        F.percentile_approx("x", [e for pair in ends for e in pair], accuracy).alias("marks"),
    )
    few = F.col("n") < accuracy  # the margin would be less than a rank: take all values
    bounds = {}
    for i, (low, high) in enumerate(ends):
        bounds[f"lo{i}"] = F.when(few | F.lit(low == 0.0), F.col("lowest")).otherwise(F.get("marks", F.lit(2 * i)))
        bounds[f"hi{i}"] = F.when(few | F.lit(high == 1.0), F.col("highest")).otherwise(F.get("marks", F.lit(2 * i + 1)))
    sure = cut_lineage(sketch.select("n", *[c.alias(name) for name, c in bounds.items()]))  # one row
    bound = lambda name: sure.select(name).scalar()
    count = bound("n")
    # one row per value and bracket it is not above; values below a bracket fold into one row of nulls
    x = F.col("x")
    marked = values.select(F.explode(F.array(*[
        F.when(x <= bound(f"hi{i}"), F.struct(F.lit(i).alias("i"), F.when(x >= bound(f"lo{i}"), x).alias("x")))
        for i in range(len(ends))
    ])).alias("m"))
    placed = marked.where(F.col("m").isNotNull()).select("m.i", "m.x")
    counted = placed.groupBy("i", "x").agg(F.count("*").alias("c"))
    ranked = running_total(counted, ["i"], ["x"], "c", "upto").where(F.col("x").isNotNull())
    p = F.get(F.array(*[F.lit(float(q)) for q in probabilities]), F.col("i"))
    target = p * (count - 1)
    low, high = F.floor(target), F.ceil(target)
    holds = lambda rank: (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
    found = ranked.groupBy("i", p.alias("p"), target.alias("target")).agg(
        F.max(F.when(holds(low), F.col("x"))).alias("a"), F.max(F.when(holds(high), F.col("x"))).alias("b")
    )
    share = F.col("target") - F.floor("target")
    return found.select("p", (F.col("a") + (F.col("b") - F.col("a")) * share).alias("value"))


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """Box-plot numbers: minimum, quartiles, maximum and the 1.5·IQR whiskers (last values inside)."""
    quartiles = exact_percentiles(df, column, [0.0, 0.25, 0.5, 0.75, 1.0])
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    wide = quartiles.agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    wide = cut_lineage(wide)  # one row
    fences = wide.select("*", (F.col("q1") - reach).alias("fence_low"), (F.col("q3") + reach).alias("fence_high"))
    inside = df.where(F.col(column).between(fences.select("fence_low").scalar(), fences.select("fence_high").scalar()))
    whiskers = inside.agg(F.min(column).alias("whisker_low"), F.max(column).alias("whisker_high"))
    return wide.select(
        *names.values(),
        whiskers.select("whisker_low").scalar().alias("whisker_low"),
        whiskers.select("whisker_high").scalar().alias("whisker_high"),
    )


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column, one pass, one row per column."""
    kinds = dict(df.dtypes)
    numeric = lambda c: F.col(c).cast("double") if kinds[c] != "string" else F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(numeric(c)).alias("mean"),
            F.stddev_samp(numeric(c)).alias("stddev"),
            F.min(c).cast("string").alias("min"),
            F.max(c).cast("string").alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def extremes(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))


def rows_holding_max(df: DataFrame, column: str) -> DataFrame:
    """All rows that hold the maximum."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())
