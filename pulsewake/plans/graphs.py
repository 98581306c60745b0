"""Follower-graph queries."""

from pyspark.sql import functions as F

from pulsewake.operators import graph as g
from pulsewake.operators.ordering import number_in_order
from pulsewake.plans.inputs import cte, given, table
from pulsewake.plans.registry import query

_V = cte("edges") + ", v AS (SELECT DISTINCT unnest([src, dst]) AS id FROM edges)\n"
_DEGREE = _V + """, deg AS (SELECT id, count(*) AS degree, count(*) FILTER (i) AS inDegree, count(*) FILTER (NOT i) AS outDegree
  FROM (SELECT dst AS id, true AS i FROM edges UNION ALL SELECT src, false FROM edges) GROUP BY 1)\n"""
_SIMPLE = _V + ", s AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst)\n"


def edges(spark, sf):
    return given(spark, sf, "edges").select("src", "dst")


@query("g01_graph_frames", _V + "SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM v)) AS dangling")
def g01(spark, sf):
    e, v = edges(spark, sf), g.vertices_of(edges(spark, sf))
    dangling = e.join(v.withColumnRenamed("id", "src"), "src", "left_anti").agg(F.count("*").alias("n"))
    return e.agg(F.count("*").alias("n_edges")).select(
        v.agg(F.count("*").alias("n")).scalar().alias("n_vertices"), "n_edges", dangling.scalar().alias("dangling")
    )


@query("u04_vertex_set", _V + "SELECT id FROM v")
def u04(spark, sf):
    return g.vertices_of(edges(spark, sf))


@query("g02_degrees", _DEGREE + "SELECT * FROM deg")
def g02(spark, sf):
    return g.degrees(edges(spark, sf))


_ALL_EDGES = "WITH edges AS (SELECT CAST(user_id AS VARCHAR) AS src, regexp_extract(props, '[0-9]+', 0) AS dst FROM events)"


@query("g02_degrees_with_parallel_edges", _ALL_EDGES + """ SELECT id, count(*) AS degree, count(*) FILTER (i) AS inDegree, count(*) FILTER (NOT i) AS outDegree
  FROM (SELECT dst AS id, true AS i FROM edges UNION ALL SELECT src, false FROM edges) GROUP BY 1""")
def g02_all(spark, sf):
    """Every event is an edge: parallel edges and loops count."""
    events = table(spark, sf, "events")
    return g.degrees(events.select(F.col("user_id").cast("string").alias("src"), F.get_json_object("props", "$.k").alias("dst")))


@query("j04_merged_degrees", _DEGREE + ", c AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer) SELECT id, coalesce(degree, 0) AS degree, coalesce(inDegree, 0) AS inDegree, coalesce(outDegree, 0) AS outDegree FROM (SELECT id FROM c UNION SELECT id FROM v) LEFT JOIN deg USING (id)")
def j04(spark, sf):
    """Accounts without any edge show zeros."""
    return g.degrees(edges(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id")))


@query("j03_vertices_with_edges", cte("edges", "accounts") + "SELECT twitter_handle_id AS id, twitter_handle_name AS screen_name, src, dst FROM accounts JOIN edges ON twitter_handle_id = src")
def j03(spark, sf):
    people = given(spark, sf, "accounts").select(F.col("twitter_handle_id").alias("id"), F.col("twitter_handle_name").alias("screen_name"))
    return g.edges_with_vertices(people, edges(spark, sf))


@query("a12_adjacency_lists", cte("edges") + "SELECT src AS id, 0::INT AS part, string_agg(dst, ',' ORDER BY dst) AS followees FROM edges GROUP BY 1")
def a12(spark, sf):
    return g.adjacency(edges(spark, sf)).withColumn("followees", F.array_join("followees", ","))


@query("j09_adjacency_match", cte("edges", "accounts") + "SELECT a.twitter_handle_name AS screen_name, count(*) AS followees, min(dst) AS first FROM accounts a JOIN edges ON src = twitter_handle_id GROUP BY 1")
def j09(spark, sf):
    """Vertex-edge match as a join instead of nested loops."""
    people = given(spark, sf, "accounts").select(F.col("twitter_handle_id").alias("id"), F.col("twitter_handle_name").alias("screen_name"))
    matched = g.edges_with_vertices(people, edges(spark, sf))
    return matched.groupBy("screen_name").agg(F.count("*").alias("followees"), F.min("dst").alias("first"))


_PR = _V + """, o AS (SELECT src, count(*) AS n FROM edges GROUP BY 1),
  r AS (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(1.0::DOUBLE / n), 0) AS rank FROM v LEFT JOIN edges e ON e.dst = v.id LEFT JOIN o ON o.src = e.src GROUP BY 1),
"""


@query("g03_pagerank", _PR + "f AS (SELECT count(*) / sum(rank) AS f FROM r) SELECT id, round(rank * f, 6) AS pagerank FROM r, f")
def g03(spark, sf):
    return g.pagerank(edges(spark, sf)).withColumn("pagerank", F.round("pagerank", 6))


_STEP = "r{0} AS (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(p.rank / n), 0) AS rank FROM v LEFT JOIN edges e ON e.dst = v.id LEFT JOIN o ON o.src = e.src LEFT JOIN {1} p ON p.id = e.src GROUP BY 1),\n"


@query("g03_pagerank_rounds", _PR + _STEP.format(2, "r") + _STEP.format(3, "r2") + "f AS (SELECT count(*) / sum(rank) AS f FROM r3) SELECT id, round(rank * f, 6) AS pagerank FROM r3, f")
def g03_rounds(spark, sf):
    return g.pagerank(edges(spark, sf), rounds=3).withColumn("pagerank", F.round("pagerank", 6))


_TRI = _SIMPLE + """, t AS (SELECT x.a AS u, x.b AS v, y.b AS w FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = x.a AND z.b = y.b)
  SELECT id, count(*) AS count FROM (SELECT unnest([u, v, w]) AS id FROM t) GROUP BY 1"""


@query("g04_triangles", _TRI)
def g04(spark, sf):
    return g.triangle_counts(edges(spark, sf))


_BFS = _SIMPLE + """, n AS (SELECT a AS u, b AS v FROM s UNION ALL SELECT b, a FROM s),
  d1 AS (SELECT u AS id, v AS other, 1 AS dist FROM n),
  d2 AS (SELECT DISTINCT d1.id, n.v AS other, 2 AS dist FROM d1 JOIN n ON d1.other = n.u WHERE n.v <> d1.id AND (d1.id, n.v) NOT IN (SELECT (id, other) FROM d1)),
  k2 AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2),
  d3 AS (SELECT DISTINCT d2.id, n.v AS other, 3 AS dist FROM d2 JOIN n ON d2.other = n.u WHERE n.v <> d2.id AND NOT EXISTS (SELECT 1 FROM k2 WHERE k2.id = d2.id AND k2.other = n.v)),
  k3 AS (SELECT * FROM k2 UNION ALL SELECT * FROM d3),
  d4 AS (SELECT DISTINCT d3.id, n.v AS other, 4 AS dist FROM d3 JOIN n ON d3.other = n.u WHERE n.v <> d3.id AND NOT EXISTS (SELECT 1 FROM k3 WHERE k3.id = d3.id AND k3.other = n.v)),
  k4 AS (SELECT * FROM k3 UNION ALL SELECT * FROM d4),
  d5 AS (SELECT DISTINCT d4.id, n.v AS other, 5 AS dist FROM d4 JOIN n ON d4.other = n.u WHERE n.v <> d4.id AND NOT EXISTS (SELECT 1 FROM k4 WHERE k4.id = d4.id AND k4.other = n.v)),
  k5 AS (SELECT * FROM k4 UNION ALL SELECT * FROM d5),
  d6 AS (SELECT DISTINCT d5.id, n.v AS other, 6 AS dist FROM d5 JOIN n ON d5.other = n.u WHERE n.v <> d5.id AND NOT EXISTS (SELECT 1 FROM k5 WHERE k5.id = d5.id AND k5.other = n.v)),
  k AS (SELECT * FROM k5 UNION ALL SELECT * FROM d6)
"""


@query("g05_distance_flood", _BFS + "SELECT v.id, count(k.other) AS reachable, CAST(coalesce(sum(dist), 0) AS BIGINT) AS distance FROM v LEFT JOIN k USING (id) GROUP BY 1")
def g05(spark, sf):
    return g.closeness(edges(spark, sf)).select("id", "reachable", "distance")


@query("g06_closeness", _BFS + "SELECT v.id, round(coalesce(count(k.other) / sum(dist), 0), 6) AS closeness FROM v LEFT JOIN k USING (id) GROUP BY 1")
def g06(spark, sf):
    return g.closeness(edges(spark, sf)).select("id", F.round("closeness", 6).alias("closeness"))


@query("g07_vertex_upsert", """SELECT user_id AS id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS kind, arg_max(value, event_id) FILTER (value < 50) AS small FROM events GROUP BY 1""")
def g07(spark, sf):
    versions = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        F.when(F.col("value") < 50, F.col("value")).alias("small"),
    )
    return g.merge_vertices(versions, "id", "event_id", ["kind", "small"])


@query("g08_edge_upsert", """SELECT DISTINCT CAST(user_id AS VARCHAR) AS src, regexp_extract(props, '[0-9]+', 0) AS dst FROM events WHERE event_type IN ('error', 'click')""")
def g08(spark, sf):
    follow = lambda kind: table(spark, sf, "events").where(F.col("event_type") == kind).select(
        F.col("user_id").cast("string").alias("src"), F.get_json_object("props", "$.k").alias("dst")
    )
    return g.merge_edges(follow("error"), follow("click"))


@query("o02_sort_by_in_degree", _DEGREE + "SELECT id, inDegree, row_number() OVER (ORDER BY inDegree DESC, id) AS place FROM deg")
def o02(spark, sf):
    """The whole order, with the place made visible."""
    d = g.degrees(edges(spark, sf)).withColumn("neg", -F.col("inDegree"))
    placed = number_in_order(d, [], ["neg", "id"], position="place").select("id", "inDegree", "place")
    return placed.orderBy("place")
