"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pulsewake.runtime import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lost executors then read it again instead of working it out anew."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_id(docs: DataFrame, doc_id: str) -> tuple[Column, str]:
    """The id column with its type: whole numbers as bigint, anything else as it is."""
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType
    whole = isinstance(kind, IntegralType)
    return F.col(f"`{doc_id}`").cast("bigint" if whole else kind), "bigint" if whole else kind.simpleString()


def connected(pairs: DataFrame) -> DataFrame:
    """Columns ``a``, ``b`` in; ``node``, ``root`` out, the root being the least id of the component.

    Alternating stars: each node hooks its larger neighbours, then its smaller ones, on the least it knows. Every step is
    one minimum per node, found before the shuffle, and one join; the number of rounds grows with the logarithm of
    the longest path. The job that writes a round counts the edges it moved. Pairs with a null or of a node with itself link
    nothing.
    """
    edges = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    moved = 1
    while moved:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("u") != F.col("m")).alias("moved"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("moved"))
        hooked = large.drop("moved").join(least.select("u", "m"), "u").where("v <> m")
        small = hooked.select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")).unionByName(least.select("u", F.col("m").alias("v"), "moved"))
        seen = Observation()
        edges = written(small.observe(seen, F.coalesce(F.sum(F.col("moved").cast("bigint")), F.lit(0)).alias("moved")).drop("moved"), "edges")
        moved = seen.get["moved"]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def also_connected(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``roots`` of :func:`connected`, with further ``pairs``: only what they add is worked out."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    above = written(connected(known.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "roots")
    top = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(above.join(roots, "node", "left_anti").select("node", "root"))


def sifted(rows: DataFrame, key: Column, keys: DataFrame, words: int = 1 << 18) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a 64-bit hash) is not in the one column of ``keys``; an exact join follows.

    A bitmap of at most ``words`` longs goes to every task, so the rows that stay behind are not shuffled. When it fills up it
    lets more of them pass.
    """
    word, bit = F.pmod(key, F.lit(words)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(key, 48).bitwiseAND(63).cast("int"))
    own = F.col(keys.columns[0])
    marks = keys.select(F.pmod(own, F.lit(words)).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(own, 48).bitwiseAND(63).cast("int")).alias("__bit"))
    bitmap = marks.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    return rows.join(F.broadcast(bitmap), word == F.col("__word")).where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")
