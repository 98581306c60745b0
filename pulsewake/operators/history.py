"""Version history of re-visited pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulsewake.functions.times import bucket_start
from pulsewake.operators.ordering import number_in_order
from pulsewake.runtime import cut_lineage


def version_history(arrivals: DataFrame, key: str, arrived: str, row_id: str) -> DataFrame:
    """Per key in order of arrival: ``version`` 1, 2, …; ``ancestor`` and ``descendant`` ids (0 when none);
    ``is_current`` on the newest. Ties in time go by id.

    A page with a third of all arrivals is numbered range by range.
    """
    ordered = number_in_order(arrivals, [key], [arrived, row_id], carry=[row_id], position="version")
    return ordered.select(
        *arrivals.columns,
        "version",
        F.coalesce(f"prev_{row_id}", F.lit(0)).alias("ancestor"),
        F.coalesce(f"next_{row_id}", F.lit(0)).alias("descendant"),
        F.col(f"next_{row_id}").isNull().alias("is_current"),
    )


def current_versions(history: DataFrame) -> DataFrame:
    return history.where("is_current")


def archived_versions(history: DataFrame) -> DataFrame:
    return history.where(~F.col("is_current"))


def newest(arrivals: DataFrame, key: str, arrived: str, row_id: str) -> DataFrame:
    """The current version of every key and its number, by one aggregate that combines on the map side; no ordering."""
    rest = [c for c in arrivals.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(arrived, row_id)).alias("_last")
    return arrivals.groupBy(key).agg(last, F.count("*").alias("version")).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest], "version")


def arrivals_with_current(arrivals: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each arriving page beside the stored current version of its address, nulls for a new address."""
    stored = current.select(key, *[F.col(c).alias(f"current_{c}") for c in columns])
    return arrivals.join(stored, key, "left")


def throttle(arrivals: DataFrame, key: str, arrived: str, hours: int = 6) -> DataFrame:
    """Moments ``(key, arrived)`` that survive the re-download throttle: at least ``hours`` after the
    last *kept* one.

    Which moments are kept depends on the whole past, yet each moment alone decides who would follow it:
    the first moment at least ``hours`` later. Those links are found slot by slot, then followed from
    the first moment of every key by doubling the step length: in each round a kept moment marks the one
    its link leads to, and every link is replaced by the link of its target. A key's history is never
    in one task, and a chain of n kept moments takes log2(n) rounds of one join and one aggregate.
    """
    moments = cut_lineage(arrivals.select(key, F.col(arrived).alias("t")).where("t IS NOT NULL").distinct())
    firsts = moments.groupBy(key).agg(F.min("t").alias("t"))
    links = _next_allowed(moments, key, hours).withColumn("kept", F.lit(False))
    state = _merge_links(links.unionByName(firsts.withColumn("kept", F.lit(True)), allowMissingColumns=True), key)
    while not state.where("next IS NOT NULL").isEmpty():
        target = state.select(F.col(key).alias("_k"), F.col("t").alias("_t"), F.col("next").alias("_after"))
        on = F.col(key).eqNullSafe(F.col("_k")) & (F.col("next") == F.col("_t"))
        nothing = F.lit(None).cast(state.schema["t"].dataType)
        doubled = F.struct(F.col("t"), F.col("_after").alias("next"), F.col("kept"))
        marked = F.struct(F.when(F.col("kept"), F.col("next")).alias("t"), nothing.alias("next"), F.col("kept"))
        moved = state.join(target, on, "left").select(key, F.inline(F.array(doubled, marked)))
        state = _merge_links(moved.where("t IS NOT NULL"), key)
    return state.where("kept").select(key, F.col("t").alias(arrived))


def _merge_links(links: DataFrame, key: str) -> DataFrame:
    """One row per moment; moments that are not kept and lead nowhere have no further part to play."""
    merged = links.groupBy(key, "t").agg(F.max("next").alias("next"), F.max("kept").alias("kept"))
    return cut_lineage(merged.where("kept OR next IS NOT NULL"))


def _next_allowed(moments: DataFrame, key: str, hours: int) -> DataFrame:
    """``(key, t, next)``: next is the first moment of the key at or after ``t + hours``.

    Moments and their deadlines meet in slots of ``hours``; a deadline whose slot holds no later moment
    takes the first moment of the key's next slot that has one.
    """
    every = f"{int(hours)} hours"
    slot = lambda at: bucket_start(at, every)
    deadline = F.col("t") + F.expr(f"INTERVAL {int(hours)} HOURS")
    points = moments.select(key, F.inline(F.array(
        F.struct(F.col("t").alias("at"), F.col("t").alias("moment"), F.lit(None).cast(moments.schema["t"].dataType).alias("asks")),
        F.struct(deadline.alias("at"), F.lit(None).cast(moments.schema["t"].dataType).alias("moment"), F.col("t").alias("asks")),
    ))).withColumn("slot", slot(F.col("at"))).withColumn("cell", F.struct(key, "slot"))
    backwards = (
        Window.partitionBy("cell").orderBy(F.desc("at"), F.col("moment").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = points.withColumn("next", F.last("moment", ignorenulls=True).over(backwards)).where("asks IS NOT NULL")
    per_slot = points.groupBy("cell").agg(F.min("moment").alias("first"))
    along = Window.partitionBy(f"cell.{key}").orderBy(F.desc("cell.slot")).rowsBetween(Window.unboundedPreceding, -1)
    later = per_slot.select("cell", F.last("first", ignorenulls=True).over(along).alias("later"))
    joined = inside.join(later, "cell", "left")
    return joined.select(key, F.col("asks").alias("t"), F.coalesce("next", "later").alias("next")).where("next IS NOT NULL")
