import random
from collections import Counter, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsewake.operators import graph as g
from pulsewake.operators import history as h
from pulsewake.plans.inputs import given, table

EDGES = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), ("e", "e"), ("f", "g")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string").persist()


def random_edges(spark, seed, n=40, m=120):
    r = random.Random(seed)
    # vertex 0 is a hub with a third of all edges
    pairs = [(str(r.randrange(n)), "0" if i % 3 == 0 else str(r.randrange(n))) for i in range(m)]
    return pairs, spark.createDataFrame(pairs, "src string, dst string")


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()), near.setdefault(b, set())
        if a != b:
            near[a].add(b), near[b].add(a)
    return near


def test_degrees_count_parallel_edges_and_isolated_vertices(spark, edges):
    vertices = spark.createDataFrame([("z",), ("a",)], "id string")
    got = {r.id: (r.degree, r.inDegree, r.outDegree) for r in g.degrees(edges, vertices).collect()}
    assert got["a"] == (4, 2, 2) and got["z"] == (0, 0, 0) and got["e"] == (2, 1, 1)
    assert sum(d for d, _, _ in got.values()) == 2 * len(EDGES)


def test_triangles_brute_force(spark, edges):
    assert {r.id: r["count"] for r in g.triangle_counts(edges).collect()} == {"a": 1, "b": 1, "c": 1}
    for seed in (1, 2):
        pairs, df = random_edges(spark, seed)
        near = neighbours(pairs)
        want = Counter()
        for a in near:
            for b in near[a]:
                for c in near[a] & near[b]:
                    if a < b < c:
                        want.update([a, b, c])
        assert {r.id: r["count"] for r in g.triangle_counts(df).collect()} == dict(want)


def test_closeness_brute_force(spark):
    pairs, df = random_edges(spark, 5, n=90, m=100)
    near = neighbours(pairs)
    want = {}
    for start in near:
        seen, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for w in near[v] - seen.keys():
                seen[w] = seen[v] + 1
                queue.append(w)
        total = sum(seen.values())
        want[start] = (len(seen) - 1, total)
    for part_size in (100_000, 2):  # with two edges a part, most vertices are hubs
        got = {r.id: (r.reachable, r.distance) for r in g.closeness(df, part_size=part_size).collect()}
        assert got == want
    lonely = g.closeness(spark.createDataFrame([("x", "x"), ("y", "z")], "src string, dst string")).collect()
    assert {r.id: r.closeness for r in lonely} == {"x": 0.0, "y": 1.0, "z": 1.0}


def test_edges_of_a_hub_lie_in_many_tasks(spark):
    """A star of 100 000 leaves: no task has more than twice the edges of the median one."""
    star = spark.range(1, 100_001).select(F.lit("hub").alias("a"), F.concat(F.lit("leaf"), F.col("id")).alias("b"))
    parted, hubs = g.cut_hubs(star, 1000)
    assert [(r.id, r.parts) for r in hubs.collect()] == [("hub", 100)]
    sizes = sorted(r["count"] for r in parted.repartition(8, "u", "part").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 8 and sum(sizes) == 200_000 and sizes[-1] <= 2 * sizes[4]
    assert parted.where("u = 'hub'").select("v").distinct().count() == 100_000
    small = spark.range(1, 300).select(F.lit("hub").alias("src"), F.concat(F.lit("leaf"), F.col("id")).alias("dst"))
    got = {r.id: (r.reachable, r.distance) for r in g.closeness(small, part_size=10).collect()}
    assert got == {"hub": (299, 299), **{f"leaf{i}": (299, 1 + 2 * 298) for i in range(1, 300)}}


def test_flood_in_small_tiles_is_the_same(spark):
    """Many tiles, parts and blocks of sources; the bits of a chunk are one row, not one row per vertex and block."""
    pairs, df = random_edges(spark, 7, n=400, m=700)
    want = {r.id: (r.reachable, r.distance) for r in g.closeness(df).collect()}
    for sizes in ({"words": 1, "side": 64, "part_size": 50}, {"words": 2, "side": 48}):
        assert {r.id: (r.reachable, r.distance) for r in g.closeness(df, **sizes).collect()} == want
    near, start = neighbours(pairs), pairs[0][0]
    seen, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in near[v] - seen.keys():
            seen[w] = seen[v] + 1
            queue.append(w)
    assert want[start] == (len(seen) - 1, sum(seen.values()))


def test_closeness_stops_at_the_depth_asked_for(spark):
    path = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    got = {r.id: r.reachable for r in g.closeness(path, max_depth=2).collect()}
    assert got["0"] == 2 and got["3"] == 4


def test_pagerank_one_round_and_scaling(spark, edges):
    got = {r.id: r.pagerank for r in g.pagerank(edges).collect()}
    assert sum(got.values()) == pytest.approx(7)
    # f has no follower, g has f's whole rank
    assert got["g"] / got["f"] == pytest.approx(1.0 / 0.15)


def test_pagerank_many_rounds(spark):
    pairs, df = random_edges(spark, 9)
    nodes = {v for p in pairs for v in p}
    out = Counter(a for a, _ in pairs)
    rank = dict.fromkeys(nodes, 1.0)
    for _ in range(4):
        step = dict.fromkeys(nodes, 0.15)
        for a, b in pairs:
            step[b] += 0.85 * rank[a] / out[a]
        rank = step
    scale = len(nodes) / sum(rank.values())
    assert {r.id: r.pagerank for r in g.pagerank(df, rounds=4).collect()} == pytest.approx({v: x * scale for v, x in rank.items()})


def test_adjacency_splits_a_hub_and_loses_nothing(spark):
    pairs = [("hub", str(i)) for i in range(500)] + [("x", "1"), ("x", "1"), ("y", "2")]
    rows = g.adjacency(spark.createDataFrame(pairs, "src string, dst string"), part_size=50).collect()
    parts = sorted((r for r in rows if r.id == "hub"), key=lambda r: r.part)
    assert [f for r in parts for f in r.followees] == sorted(str(i) for i in range(500))
    assert [(r.part, len(r.followees)) for r in parts] == [(i, 50) for i in range(10)]
    assert [(r.part, r.followees) for r in rows if r.id == "x"] == [(0, ["1"])]


def test_vertex_merge_keeps_latest_known_value(spark):
    df = spark.createDataFrame([(1, 1, "a", 5), (1, 2, None, 6), (1, 3, "c", None), (2, 1, None, None)], "id int, seq int, name string, n int")
    got = {r.id: (r["name"], r.n) for r in g.merge_vertices(df, "id", "seq", ["name", "n"]).collect()}
    assert got == {1: ("c", 6), 2: (None, None)}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert g.triangle_counts(none).count() == 0 and g.degrees(none).count() == 0 and g.pagerank(none).count() == 0
    assert g.closeness(none).count() == 0


T0 = datetime(2024, 1, 1)


def arrivals(spark, rows):
    return spark.createDataFrame([(u, T0 + timedelta(hours=x), i) for i, (u, x) in enumerate(rows, 1)], "url string, at timestamp_ntz, id bigint")


def test_versions_are_dense_and_linked(spark):
    rows = [("p", 1), ("p", 1), ("p", 60), ("q", 5), ("p", 0)]
    got = {r.id: (r.version, r.ancestor, r.descendant, r.is_current) for r in h.version_history(arrivals(spark, rows), "url", "at", "id").collect()}
    assert got == {5: (1, 0, 1, False), 1: (2, 5, 2, False), 2: (3, 1, 3, False), 3: (4, 2, 0, True), 4: (1, 0, 0, True)}


def kept_by_fold(rows, hours):
    kept = {}
    for u, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        chain = kept.setdefault(u, [])
        if not chain or x - chain[-1] >= hours:
            chain.append(x)
    return {(u, T0 + timedelta(hours=x)) for u, chain in kept.items() for x in chain}


def test_throttle_looks_at_the_last_kept_arrival(spark):
    got = h.throttle(arrivals(spark, [("p", x) for x in (0, 4, 7, 11, 14)]), "url", "at", 6).collect()
    assert {(r.url, r.at) for r in got} == kept_by_fold([("p", x) for x in (0, 7, 14)], 6)


def test_throttle_brute_force_with_a_hot_page(spark):
    r = random.Random(11)
    rows = [("hot" if i % 3 else r.choice(["x", "y", None]), r.choice([r.randrange(2000) / 8, r.randrange(40) / 4])) for i in range(600)]
    got = h.throttle(arrivals(spark, rows), "url", "at", 6).collect()
    assert len(got) == len({(x.url, x.at) for x in got})
    assert {(x.url, x.at) for x in got} == kept_by_fold(rows, 6)


def test_throttle_without_arrivals(spark):
    assert h.throttle(arrivals(spark, [("p", 1)]).where(F.lit(False)), "url", "at", 6).count() == 0


def test_edge_stand_in_has_the_pairs_of_all_events(spark):
    folder = "/root/testdata/sf0.001"
    events = table(spark, folder, "events").select(F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    want = {tuple(r) for r in events.collect()}
    got = [tuple(r) for r in given(spark, folder, "edges").collect()]
    assert set(got) == want and len(got) == len(want)
