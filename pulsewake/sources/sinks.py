"""Sinks. Results go from the executors straight to the target; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from pulsewake import schemas
from pulsewake.functions.text import sha_key
from pulsewake.functions.urls import json_file_name
from pulsewake.operators.graph import adjacency
from pulsewake.operators.history import archived_versions, current_versions
from pulsewake.runtime import cut_lineage


def write_job_parquet(df: DataFrame, root: str, job_time: datetime) -> str:
    """Parquet overwrite into a folder named by the job time."""
    path = f"{root}/{job_time:%Y-%m-%d_%H%M%S}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_orc(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").orc(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, fmt: str, mode: str, options: Mapping[str, str] | None = None, path: str | None = None) -> None:
    """Warehouse append or overwrite through any connector."""
    writer = df.write.format(fmt).mode(mode).options(**(options or {}))
    writer.save(path) if path else writer.save()


def write_result_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Result CSV with a header, as ordered part files.

    ``single_file`` puts the whole result into one file through one writer: for results the caller knows to be small, such
    as a score per site. The layout never depends on the size.
    """
    result = cut_lineage(df).coalesce(1) if single_file else df
    result.write.mode("overwrite").csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_articles_by_domain(articles: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Article JSON in one folder per domain, each row with its file key.

    A domain gets as many writers as its size asks for: a giant one does not end in one task, a small one
    stays in one file.
    """
    keyed = articles.withColumns({
        "file_key": F.concat(sha_key(F.col("url")), F.lit(".json")),
        "escaped_name": json_file_name(F.col("url")),
    })
    sizes = articles.groupBy(F.col("source_domain").alias("_domain")).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files"))
    spread = keyed.join(sizes, F.col("source_domain").eqNullSafe(F.col("_domain"))).withColumn("_slice", F.pmod(F.xxhash64("url", "file_key"), F.col("_files")))
    placed = spread.repartition("source_domain", "_slice").drop("_domain", "_files", "_slice")
    placed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("source_domain").json(path)


def write_raw_pages(pages: DataFrame, path: str, by: str) -> None:
    """Raw page store, columnar, one folder per ``by``."""
    pages.write.mode("overwrite").partitionBy(by).parquet(path)


def write_prices(prices: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None) -> None:
    prices.select(*schemas.PRICES.names).write.jdbc(url, table, mode="append", properties=dict(properties or {}))


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Bulk append in place of row-by-row inserts; fits ``foreachBatch``."""
    df.write.mode("append").format(fmt).save(path)


def write_graph(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    """Edge CSV, vertex CSV and adjacency JSON for a graph viewer."""
    write_csv(edges, f"{path}/edges")
    write_csv(vertices, f"{path}/vertices")
    write_json(adjacency(edges), f"{path}/adjacency")


def write_versions(history: DataFrame, path: str) -> None:
    """Current and archived versions from one history frame."""
    kept = history.persist()
    try:
        current_versions(kept).write.mode("overwrite").parquet(f"{path}/current")
        archived_versions(kept).write.mode("overwrite").parquet(f"{path}/archive")
    finally:
        kept.unpersist()
