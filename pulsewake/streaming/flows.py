"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from pulsewake import schemas
from pulsewake.operators.posts import cleanse_posts
from pulsewake.operators.windows import pairs_within


def stream_raw_posts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New post files as they arrive. Which files are done is kept in the checkpoint of the query."""
    return spark.readStream.schema(schemas.RAW_POSTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def clean_stream(raw: DataFrame) -> DataFrame:
    """The batch cleansing, unchanged."""
    return cleanse_posts(raw)


def distinct_stream(posts: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """First arrival per key; keys are forgotten once the watermark has passed them."""
    return posts.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def volume_stream(posts: DataFrame, ts: str, every: str, lateness: str) -> DataFrame:
    """Rows per tumbling window; later rows than ``lateness`` are left out."""
    counts = posts.withWatermark(ts, lateness).groupBy(F.window(ts, every)).agg(F.count("*").alias("volume"))
    return counts.select(F.col("window.start").alias("bucket"), "volume")


#: Setting under which a query of :func:`throttle_stream` has to start: its state needs timers.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def _packed(batches: Iterator[pa.RecordBatch], rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a key and a moment, as many as ``rows`` at a time, to one of each key with its distinct moments and the newest."""
    def pack(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = held[0].schema.names
        keys = pa.Table.from_batches(held).group_by(key).aggregate([(at, "distinct"), (at, "max")])
        yield from keys.select([key, f"{at}_distinct", f"{at}_max"]).rename_columns([key, "_moments", "_newest"]).to_batches(1 << 12)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pack(held)
            held = []
    if held:
        yield from pack(held)


def throttle_stream(arrivals: DataFrame, key: str, arrived: str, hours: int = 6, lateness: str = "1 hour") -> DataFrame:
    """Drop a re-download less than ``hours`` after the last kept one, in event time: any order and batching within
    ``lateness`` gives the result of :func:`pulsewake.operators.history.throttle`.

    Which arrivals are kept is settled once the watermark has passed them. Until then a key holds those that may still
    be kept, at most its distinct moments of ``lateness`` beyond ``hours`` after the last kept one. One timer a key wakes
    it when the first of them is settled; a key is forgotten ``hours`` after its last kept moment, since then any arrival is
    kept anyway. An arrival without a time is left out; one behind the watermark as well. The last arrivals come out when
    a later one, of any key, moves the watermark past them. Start the query under ``KEYED_STATE``.

    Arrivals of one key are packed into one row before they reach its state, and are held there packed, so the work in
    Python and in the state store goes by keys and batches, not by arrivals.
    """
    gap, name = int(hours) * 3_600_000_000, key

    class Throttle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.settled = handle.getValueState("settled", "last bigint, wakes bigint")
            self.waiting = handle.getListState("waiting", "moments binary")

        def handleInputRows(self, key, rows, timerValues):
            last, wakes = self.settled.get() or (None, None)
            border = timerValues.getCurrentWatermarkInMs() * 1000
            moments = {at for row in rows for at in row[1] if at >= border and (last is None or at - last >= gap)}
            if moments:
                self.waiting.appendValue((array("q", moments).tobytes(),))
                self.wake(last, wakes, min(moments))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = self.settled.get()[0]
            border = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = sorted({at for row in self.waiting.get() for at in array("q", bytes(row[0]))})
            kept = []
            for at in waiting:
                if at <= border and (last is None or at - last >= gap):
                    kept.append(at)
                    last = at
            rest = [at for at in waiting if at >= border and (last is None or at - last >= gap)]
            if rest:
                self.waiting.put([(array("q", rest).tobytes(),)])
                self.wake(last, None, rest[0])
            elif last is not None and last + gap > border:
                self.waiting.clear()
                self.wake(last, None, last + gap)
            else:
                self.waiting.clear()
                self.settled.clear()
            return iter([Row(**{name: key[0], "_at": kept})] if kept else [])

        def wake(self, last, wakes, at) -> None:
            """One timer a key, at the first moment it waits for. Timers have milliseconds, moments microseconds."""
            due = at // 1000 + 1
            if wakes is None or due < wakes:
                if wakes is not None:
                    self.handle.deleteTimer(wakes)
                self.handle.registerTimer(due)
                self.settled.update((last, due))

        def close(self) -> None:
            pass

    kind = dict(arrivals.dtypes)[key]
    rows = arrivals.where(F.col(arrived).isNotNull()).select(F.col(key), F.unix_micros(arrived).alias("_at"))
    packed = rows.repartition(key).mapInArrow(_packed, f"`{key}` {kind}, _moments array<bigint>, _newest bigint")
    marked = packed.select(key, "_moments", F.timestamp_micros("_newest").alias(arrived)).withWatermark(arrived, lateness)
    kept = marked.groupBy(key).transformWithState(Throttle(), f"`{key}` {kind}, _at array<bigint>", "append", "EventTime")
    return kept.select(key, F.explode("_at").alias("_at")).select(key, F.timestamp_micros("_at").alias(arrived))


def publications_near_events(
    pubs: DataFrame, events: DataFrame, ts: str, event_ts: str, minutes: int, lateness: str, salts: int = 8, busy: DataFrame | None = None
) -> DataFrame:
    """Stream-stream join: publications at most ``minutes`` before an event. The interval bounds the state of both sides.

    ``busy`` spreads the hours known to be crowded (:func:`pulsewake.operators.windows.busy_hours`), ``salts`` all others.
    """
    return pairs_within(pubs.withWatermark(ts, lateness), events.withWatermark(event_ts, lateness), ts, event_ts, minutes, salts, busy)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what is started inside; those of before come back after."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> None:
    """Work off what is there, write Parquet, stop. ``conf`` holds for this query alone."""
    with settings(stream.sparkSession, conf or {}):
        query = (
            stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path)
        )
        query.awaitTermination()


def run_batches(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there through ``apply(batch, number)``."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(apply).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def upsert_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what is there in update mode: the rows that changed, with the number of their micro-batch.

    A batch that runs twice overwrites its own folder, so nothing is counted twice.
    """
    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, apply, checkpoint, "update")


def latest(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The newest state of every key that :func:`upsert_to_files` wrote; ``batch`` is the folder's number."""
    rows = spark.read.schema(schema if "batch" in schema.names else StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in [*keys, "batch"]]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
