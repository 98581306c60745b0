"""Versioned upsert of page arrivals, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from pulsewake.operators.history import newest, version_history
from pulsewake.runtime import cut_lineage


class VersionStore:
    """Arrival log plus a view of the versions.

    Each batch is appended to its own folder, named by the batch number and overwritten on a replay, so
    a batch that is run again after a failure does not count twice. Versions, ancestors and descendants
    are properties of the log and are computed when read: appending never rewrites older rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, arrived: str, row_id: str):
        self.spark, self.path, self.key, self.arrived, self.row_id = spark, path, key, arrived, row_id

    def append(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def history(self) -> DataFrame:
        log = self.spark.read.parquet(self.path).drop("batch")
        return version_history(log, self.key, self.arrived, self.row_id)

    def current(self) -> DataFrame:
        """The newest row of every key with its version number, by one aggregate: nothing is put in order."""
        return newest(self.spark.read.parquet(self.path).drop("batch"), self.key, self.arrived, self.row_id)


#: One row per merged batch and bucket; ``rebuilt`` where the archive of the bucket was written anew.
_COMMITS = StructType([StructField("batch", LongType()), StructField("bucket", IntegerType()), StructField("rebuilt", BooleanType())])


class VersionTables:
    """Numbered versions of every key in two tables, kept up to date by merging micro-batches.

    ``current`` has the newest row of every key, ``archive`` those it replaced; both carry ``version``, ``ancestor`` and
    ``descendant`` as :func:`pulsewake.operators.history.version_history` defines them over all arrivals, in whatever order and
    batches those come. Keys are hashed to ``buckets``. A merge reads and writes only the buckets that its batch touches, and of
    the archive it reads only buckets where an arrival is older than its key's current row, which renumbers what follows.

    Nothing is written over: a merge makes a new generation of a bucket under its batch's number, then one row per bucket in the
    table of commits, which readers go by. So readers never see half a merge, and a batch that is run again starts from
    the generations before it and replaces its own. What the driver collects are numbers of buckets, never keys.

    Rows without a key form a history of their own. ``buckets`` belongs to the tables and can't change later. A batch needs the columns
    of the first one; ``bucket``, ``batch``, ``version``, ``ancestor``, ``descendant`` and ``is_current`` are taken. Merges run one after another, as
    the micro-batches of one stream do.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, arrived: str, row_id: str, schema: StructType, buckets: int = 64):
        taken = {"bucket", "batch", "version", "ancestor", "descendant", "is_current"} & {name.lower() for name in schema.names}
        if taken:
            raise ValueError(f"columns of the tables: {sorted(taken)}")
        self.spark, self.path, self.key, self.arrived, self.row_id, self.buckets = spark, path, key, arrived, row_id, buckets
        self.columns = schema.names
        number = schema[row_id].dataType
        self.stored = StructType([
            *schema.fields, StructField("version", LongType()), StructField("ancestor", number), StructField("descendant", number),
            StructField("batch", LongType()), StructField("bucket", IntegerType()),
        ])
        spark.createDataFrame([], _COMMITS).write.mode("ignore").partitionBy("batch").parquet(f"{path}/commits")

    def _generations(self, spark: SparkSession, before: int | None = None, buckets: list[int] | None = None) -> list[tuple[int, int, int]]:
        """``(bucket, newest batch, batch that rebuilt the archive last)``: at most one row per bucket."""
        rows = spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        if before is not None:
            rows = rows.where((F.col("batch") < before) & F.col("bucket").isin(buckets))
        rebuilt = F.coalesce(F.max(F.when(F.col("rebuilt"), F.col("batch"))), F.lit(-1))
        return [tuple(r) for r in rows.groupBy("bucket").agg(F.max("batch"), rebuilt).collect()]

    def _current(self, spark: SparkSession, generations: list[tuple[int, int, int]]) -> DataFrame:
        """Only the folders of the generations are listed and read; a bucket that has been merged has a current row."""
        if not generations:
            return spark.createDataFrame([], self.stored)
        root = f"{self.path}/current"
        folders = [f"{root}/batch={batch}/bucket={bucket}" for bucket, batch, _ in generations]
        return spark.read.schema(self.stored).option("basePath", root).parquet(*folders)

    def _archive(self, spark: SparkSession, generations: list[tuple[int, int, int]]) -> DataFrame:
        """What merges have put aside since the archive of the bucket was rebuilt; a filter on folders alone."""
        live = F.lit(False)
        for bucket, batch, rebuilt in generations:
            live = live | ((F.col("bucket") == bucket) & F.col("batch").between(max(rebuilt, 0), batch))
        if not generations:
            return spark.createDataFrame([], self.stored)
        return spark.read.schema(self.stored).parquet(f"{self.path}/archive").where(live)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Bring both tables up to date with a batch of arrivals; for ``foreachBatch``."""
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        arrivals = cut_lineage(batch.select(*self.columns, bucket))
        touched = [r.bucket for r in arrivals.select("bucket").distinct().collect()]
        if not touched:
            return
        generations = self._generations(spark, number, touched)
        current = self._current(spark, generations)
        held = current.select(F.col(self.key).alias("_key"), F.col(self.arrived).alias("_at"), F.col(self.row_id).alias("_id"), F.col("version").alias("_version"))
        same_key = F.col(self.key).eqNullSafe(F.col("_key"))
        after = (F.col(self.arrived) > F.col("_at")) | ((F.col(self.arrived) == F.col("_at")) & (F.col(self.row_id) >= F.col("_id")))
        behind = arrivals.join(held, same_key).where(~F.coalesce(after, F.lit(False)))
        late = [r.bucket for r in behind.select("bucket").distinct().collect()]
        is_late = F.col("bucket").isin(late) if late else F.lit(False)
        old = current.unionByName(self._archive(spark, [g for g in generations if g[0] in set(late)]))
        old = old.select(*self.columns, "bucket", F.when(~is_late, F.col("ancestor")).alias("_ancestor"))
        ordered = version_history(old.unionByName(arrivals, allowMissingColumns=True), self.key, self.arrived, self.row_id)
        numbered = ordered.join(held.select("_key", "_version"), same_key, "left").select(
            *self.columns,
            (F.col("version") + F.when(~is_late & F.col("_version").isNotNull(), F.col("_version") - 1).otherwise(0)).cast("bigint").alias("version"),
            *[value.cast(self.stored[name].dataType).alias(name) for name, value in
              (("ancestor", F.coalesce("_ancestor", "ancestor")), ("descendant", F.col("descendant")))],
            "is_current", "bucket",
        )
        numbered = cut_lineage(numbered.hint("rebalance", "bucket"))
        for table, rows in (("current", numbered.where("is_current")), ("archive", numbered.where("NOT is_current"))):
            rows.drop("is_current").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{table}/batch={number}")
        commit = spark.createDataFrame([(b, b in set(late)) for b in touched], "bucket int, rebuilt boolean")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")

    def current(self) -> DataFrame:
        """The newest row of every key; nothing is put in order, no older generation is read."""
        return self._current(self.spark, self._generations(self.spark)).drop("batch", "bucket")

    def archive(self) -> DataFrame:
        """Every replaced row with its number, the id before and the id after it."""
        return self._archive(self.spark, self._generations(self.spark)).drop("batch", "bucket")

    def history(self) -> DataFrame:
        return self.current().unionByName(self.archive())
