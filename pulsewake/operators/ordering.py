"""Row order without one task per key.

A window over a whole key sorts that key in one task; a key with a third of all rows would not fit. Here the rows are
dealt out by ranges of key and order, which Spark finds by sampling, so a large key is spread over as many tasks as its
size asks for, however its rows lie in time. The ranges are ordered on their own, and a small table with one row per key
and range carries counts and border rows across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from pulsewake.functions.times import bucket_start
from pulsewake.runtime import cut_lineage


def number_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str] = (), position: str = "position") -> DataFrame:
    """Add the 1-based ``position`` of each row within its key and, for every carried column ``c``,
    ``prev_c`` and ``next_c``.

    ``order`` must be total within a key. The dealt rows are checkpointed: sampled ranges are not the same twice.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # one struct names a range of a key: the window and the join share its partitioning and its order, and
    # null keys are equal to each other inside it
    sliced = cut_lineage(dealt.withColumn("_cell", F.struct(*keys, "_range")).drop("_range"))
    inside = Window.partitionBy("_cell").orderBy(*order)
    rows = sliced.withColumns({
        "_rank": F.row_number().over(inside),
        **{f"_prev_{c}": F.lag(c).over(inside) for c in carry},
        **{f"_next_{c}": F.lead(c).over(inside) for c in carry},
    })
    border = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")])
    slices = sliced.groupBy("_cell").agg(
        F.count("*").alias("_n"),
        F.min_by(border, F.struct(*order)).alias("_first"),
        F.max_by(border, F.struct(*order)).alias("_last"),
    )
    along = Window.partitionBy(*[F.col(f"_cell.{k}") for k in keys]).orderBy("_cell._range")
    slices = slices.select(
        "_cell",
        "_n",
        F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_last").over(along).alias("_prev"),
        F.lead("_first").over(along).alias("_next"),
    )
    joined = rows.join(slices, "_cell")
    return joined.select(
        *df.columns,
        (F.col("_before") + F.col("_rank")).alias(position),
        *[F.when(F.col("_rank") == 1, F.col(f"_prev.{c}")).otherwise(F.col(f"_prev_{c}")).alias(f"prev_{c}") for c in carry],
        *[
            F.when(F.col("_rank") == F.col("_n"), F.col(f"_next.{c}")).otherwise(F.col(f"_next_{c}")).alias(f"next_{c}")
            for c in carry
        ],
    )


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, total: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to each row, nulls first; no task holds a whole key."""
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    sliced = cut_lineage(dealt.withColumn("_cell", F.struct(*keys, "_range")).drop("_range"))
    inside = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.partitionBy(*[F.col(f"_cell.{k}") for k in keys]).orderBy("_cell._range").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy("_cell").agg(F.sum(value).alias("_sum")).select("_cell", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    return sliced.withColumn("_upto", F.sum(value).over(inside)).join(before, "_cell").select(*df.columns, (F.col("_before") + F.col("_upto")).alias(total))


def nth_in_order(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The n-th row of the whole frame.

    Counts per range say which range holds it, and only that range is put in order.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holder = counts.withColumn("_before", before).where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = dealt.join(holder, "_range").withColumn("_rank", rank)
    return ranked.where(F.col("_before") + F.col("_rank") == n).select(*df.columns)


def next_event(
    posts: DataFrame,
    events: DataFrame,
    ts: str,
    event_ts: str,
    carry: Sequence[str] = (),
    slot: str = "1 day",
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """Forward as-of join: to each post the first event at or after it, null when there is none.

    Both sides are laid on time slots; inside a slot one sort finds the next event. The posts of each slot are counted
    first: a slot of more than ``rows_per_task`` posts is spread over as many tasks as it needs, and its events alone
    are repeated there. Posts whose slot has no later event take the first event of the next slot that has one, from a table with one row per slot.
    """
    event = F.struct(F.col(event_ts), *[F.col(c) for c in carry])
    kept = posts.columns
    # the bucket function drops null times, which have no next event: they are added back at the end
    timed = posts.where(F.col(ts).isNotNull())
    placed = timed.select(*kept, F.col(ts).alias("_at"), bucket_start(F.col(ts), slot).alias("_slot"))
    spread = F.ceil(F.count("*") / rows_per_task).cast("int")
    busy = placed.groupBy("_slot").agg(spread.alias("_salts"))
    # only slots that need more than one task are looked up
    salts = F.coalesce("_salts", F.lit(1))
    busy = busy.where("_salts > 1")
    left = placed.join(busy, "_slot", "left").withColumn("_salt", F.pmod(F.xxhash64(*kept), salts).cast("int")).drop("_salts")
    slotted = events.where(F.col(event_ts).isNotNull()).select(
        event.alias("_event"), F.col(event_ts).alias("_at"), bucket_start(F.col(event_ts), slot).alias("_slot")
    )
    right = slotted.join(busy, "_slot", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    backwards = (
        Window.partitionBy("_slot", "_salt")
        .orderBy(F.desc("_at"), F.col("_event").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        left.withColumn("_post", F.lit(True))
        .unionByName(right, allowMissingColumns=True)
        .withColumn("_next", F.last("_event", ignorenulls=True).over(backwards))
        .where("_post")
    )
    # the later event of every slot between the first and the last slot that has one
    firsts = slotted.groupBy("_slot").agg(F.min("_event").alias("_first"))
    ends = firsts.agg(F.min("_slot").alias("a"), F.max("_slot").alias("b"), F.min("_first").alias("first"))
    slots = (
        ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {slot}"))).alias("_slot"))
        .join(firsts, "_slot", "left")
        .withColumn(
            "_later",
            F.last("_first", ignorenulls=True).over(
                Window.orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("_slot", "_later")
    )
    before_all = F.when(F.col("_slot") < ends.select("a").scalar(), ends.select("first").scalar())
    names = [event_ts, *carry]
    answered = found.join(slots, "_slot", "left").withColumn("_next", F.coalesce("_next", "_later", before_all))
    answered = answered.select(*kept, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in names])
    untimed = posts.where(F.col(ts).isNull())
    return answered.unionByName(untimed, allowMissingColumns=True)
