"""Follower-graph measures as joins and aggregates over ``edges(src, dst)``.

Iterations run as DataFrame rounds. Each round ends in a reliable checkpoint, so plans stay short and a
lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsewake.operators.flood import distance_sums
from pulsewake.operators.ordering import number_in_order
from pulsewake.runtime import cut_lineage


def edges_from_pages(pages: DataFrame, account: str = "account", ids: str = "ids") -> DataFrame:
    """Follower pages to ``follower -> account`` edges; the same follower on two pages counts once."""
    listed = pages.select(F.explode(ids).alias("src"), F.col(account).cast("string").alias("dst"))
    return listed.select(F.col("src").cast("string"), "dst").distinct()


def merge_edges(current: DataFrame, arriving: DataFrame) -> DataFrame:
    return current.select("src", "dst").unionByName(arriving.select("src", "dst")).distinct()


def merge_vertices(versions: DataFrame, key: str, order: str, attributes: Sequence[str]) -> DataFrame:
    """One vertex per key: for each attribute the latest value that is not null."""
    return versions.groupBy(key).agg(*[
        F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes
    ])


def vertices_of(edges: DataFrame) -> DataFrame:
    """Every end point of every edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def edges_with_vertices(vertices: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Vertices joined to their outgoing edges; a vertex without any falls out."""
    return vertices.join(edges, vertices[key] == edges["src"], "inner")


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Total, in- and out-degree from one pass over the edges; parallel edges count.

    With ``vertices`` given, isolated ones appear with zeros.
    """
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )))
    if vertices is not None:
        ends = ends.unionByName(vertices.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return (
        ends.groupBy("id")
        .agg(F.sum(F.col("i") + F.col("o")).alias("degree"), F.sum("i").alias("inDegree"), F.sum("o").alias("outDegree"))
        .orderBy(F.desc("inDegree"), "id")
    )


def adjacency(edges: DataFrame, part_size: int = 100_000) -> DataFrame:
    """Unique followees per vertex as rows ``(id, part, followees)``.

    The list of a vertex is the lists of its parts 0, 1, … laid end to end, sorted throughout. Every part but the last has
    ``part_size`` followees, so no task and no row ever holds a whole hub.
    """
    placed = number_in_order(edges.select("src", "dst").distinct(), ["src"], ["dst"], position="_place")
    part = F.floor((F.col("_place") - 1) / part_size).cast("int")
    return placed.groupBy(F.col("src").alias("id"), part.alias("part")).agg(F.array_sort(F.collect_list("dst")).alias("followees"))


def pagerank(edges: DataFrame, reset: float = 0.15, rounds: int = 1, vertices: DataFrame | None = None) -> DataFrame:
    """``rounds`` synchronous steps from rank 1, then scaled so that the ranks add up to the vertex count."""
    nodes = vertices.select("id") if vertices is not None else vertices_of(edges)
    out = edges.groupBy("src").agg(F.count("*").alias("_out"))
    weighted = cut_lineage(edges.select("src", "dst").join(out, "src").select("src", "dst", (1.0 / F.col("_out")).alias("w")))
    ranks = cut_lineage(nodes.withColumn("rank", F.lit(1.0)))
    start = ranks
    for _ in range(rounds):
        sent = (
            weighted.join(ranks, weighted["src"] == ranks["id"])
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("w") * F.col("rank")).alias("s"))
        )
        step = start.select("id").join(sent, "id", "left")
        ranks = cut_lineage(step.select("id", (reset + (1 - reset) * F.coalesce("s", F.lit(0.0))).alias("rank")))
    total = ranks.agg((F.count("*") / F.sum("rank")).alias("f")).scalar()
    return ranks.select("id", (F.col("rank") * total).alias("pagerank")).orderBy(F.desc("pagerank"), "id")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple edges ``a < b``: no loops, no repeats."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )


def triangle_counts(edges: DataFrame) -> DataFrame:
    """Triangles through each vertex, vertices without any left out.

    Every edge points from its lower-degree to its higher-degree end. A vertex then has at most √(2E)
    outgoing edges, however large its degree, and that bounds the wedges a hub can produce.
    """
    simple = cut_lineage(simple_edges(edges))
    degree = simple.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    forward = F.struct("da", "a") < F.struct("db", "b")
    pointed = cut_lineage(simple.join(da, "a").join(db, "b").select(
        F.when(forward, F.struct(F.col("a").alias("u"), F.col("b").alias("v")))
        .otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"))).alias("e")
    ).select("e.u", "e.v"))
    first = pointed.select("u", F.col("v").alias("x"))
    second = pointed.select("u", F.col("v").alias("y"))
    wedges = first.join(second, "u").where(F.col("x") < F.col("y"))
    # the closing edge may point either way, so it is looked up in the undirected edge list
    closing = simple.select(F.col("a").alias("x"), F.col("b").alias("y"))
    corners = wedges.join(closing, ["x", "y"]).select(F.explode(F.array("u", "x", "y")).alias("id"))
    return corners.groupBy("id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "id")


def cut_hubs(simple: DataFrame, part_size: int) -> tuple[DataFrame, DataFrame]:
    """Simple edges ``a < b`` in both directions as ``(u, part, v)``, and ``(id, parts)`` of the hubs.

    A vertex with more than ``part_size`` neighbours is a hub: its edges are dealt to so many parts that each has
    about that many. All others have the one part 0. The table of hubs has at most a row for each ``part_size`` edges.
    """
    both = simple.select(
        F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    )
    degrees = both.groupBy("u").agg(F.count("*").alias("d")).where(F.col("d") > part_size)
    hubs = cut_lineage(degrees.select(F.col("u").alias("id"), F.ceil(F.col("d") / part_size).cast("int").alias("parts")))
    known = both.join(hubs, both["u"] == hubs["id"], "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    return known.select("u", part.alias("part"), "v"), hubs


def closeness(edges: DataFrame, max_depth: int | None = None, words: int = 64, part_size: int = 1 << 22, side: int = 1 << 17) -> DataFrame:
    """Reachable vertices ÷ sum of distances over undirected edges, 0 when nothing is reachable.

    A breadth-first flood from all vertices at once (:mod:`pulsewake.operators.flood`): the vertices heard of are bits, 64 *
    ``words`` sources of ``1024`` vertices in a row. Only bits that are new to a vertex travel on; the flood ends when there are
    none. A task has at most ``part_size`` edges between two sets of ``side`` vertices, whatever the degree of a hub.
    """
    simple = cut_lineage(simple_edges(edges))
    nodes = cut_lineage(_number_together(vertices_of(edges), simple))
    ends = nodes.select(F.col("id").alias("a"), F.col("seq").alias("x")), nodes.select(F.col("id").alias("b"), F.col("seq").alias("y"))
    numbered = simple.join(ends[0], "a").join(ends[1], "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    found = distance_sums(cut_lineage(numbered), nodes.count(), max_depth, words, part_size, side)
    sums = found.groupBy("seq").agg(F.sum("n").alias("reachable"), F.sum("s").alias("distance"))
    return nodes.join(sums, "seq").select(
        "id", "reachable", "distance",
        F.when(F.col("distance") > 0, F.col("reachable") / F.col("distance")).otherwise(F.lit(0.0)).alias("closeness"),
    ).orderBy(F.desc("closeness"), "id")


def _number_together(nodes: DataFrame, simple: DataFrame, rounds: int = 3) -> DataFrame:
    """Consecutive numbers ``seq`` in which vertices that share a near vertex of least hash lie together, so that small
    components touch few blocks of bits. Any numbering gives the same distances."""
    both = simple.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    labels = cut_lineage(nodes.select("id", F.xxhash64("id").alias("label")))
    for _ in range(rounds):
        heard = both.join(labels, F.col("u") == F.col("id")).select(F.col("v").alias("id"), "label")
        labels = cut_lineage(labels.unionByName(heard).groupBy("id").agg(F.min("label").alias("label")))
    numbered = number_in_order(labels.withColumn("own", F.xxhash64("id")), [], ["label", "own", "id"])
    return numbered.select("id", (F.col("position") - 1).alias("seq"))
