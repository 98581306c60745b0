from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pulsewake.operators import influence as inf
from pulsewake.operators import ordering
from pulsewake.operators import windows as win

PERIOD = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
EVENTS = ["2024-01-01 06:00:00", "2024-01-01 06:20:00"]


def at(text):
    return datetime.fromisoformat("2024-01-01 " + text)


def pubs(spark, rows):
    return spark.createDataFrame(rows, "id int, agent string, ts timestamp_ntz")


def tags(df):
    return {r.id: r.golden_window for r in df.collect()}


def test_window_and_period_ends_are_inclusive_and_first_window_wins(spark):
    rows = [(1, "a", at("05:30:00")), (2, "a", at("06:00:00")), (3, "a", at("05:29:59")), (4, "a", at("05:55:00")),
            (5, "a", at("06:10:00")), (6, "a", at("06:20:01")), (7, "a", datetime(2024, 1, 2)), (8, "a", datetime(2024, 1, 2, 0, 0, 1))]
    tagged = inf.sample_with_windows(pubs(spark, rows), "ts", PERIOD, EVENTS, 30)
    # 05:55 lies in both windows and belongs to the first
    assert tags(tagged) == {1: 1, 2: 1, 3: 0, 4: 1, 5: 2, 6: 0, 7: 0}


def test_score_counts_events_not_windows_seen(spark):
    rows = [(1, "a", at("05:50:00")), (2, "a", at("12:00:00")), (3, "b", at("13:00:00")), (4, None, at("05:45:00"))]
    scores = {r.agent: r for r in inf.influence_score(pubs(spark, rows), "agent", "ts", PERIOD, EVENTS, 30).collect()}
    assert scores["a"].wtf == 0.5 * 0.5
    assert (scores["b"].total_nbr_publish, scores["b"].total_nbr_publish_in_golden_window, scores["b"].wtf) == (1, 0, 0.0)
    assert scores[None].wtf == 0.5
    assert list(scores["a"].asDict()) == ["agent", *inf.SCORE_COLUMNS]


def test_window_table_agrees_with_window_list_on_overlaps(spark):
    rows = [(i, "a", at("00:00:00") + timedelta(minutes=7 * i)) for i in range(150)] + [(999, "a", None)]
    events = ["2024-01-01 03:00:00", "2024-01-01 03:10:00", "2024-01-01 02:50:00", "2024-01-01 09:00:00"]
    p = pubs(spark, rows)
    by_list = p.select("id", F.coalesce(win.window_number(F.col("ts"), win.golden_windows(events, 45)), F.lit(0)).alias("golden_window"))
    table = spark.createDataFrame([(i, datetime.fromisoformat(e)) for i, e in enumerate(events, 1)], "window_id int, at timestamp_ntz")
    by_table = win.tag_with_windows(p, win.windows_from_events(table, "at", 45), "ts", "id")
    assert tags(by_table) == tags(by_list)


def test_cells_make_up_their_window_and_nothing_else(spark):
    base = datetime(1969, 12, 31, 23, 59, 59, 999_900)
    spans = [(0, 0), (0, 15), (3, 300), (90, 110), (99, 4_200), (100, 100 + 16**3 - 1), (5, 4), (17, 1_000), (0, None)]
    rows = [(i, base + timedelta(microseconds=a), None if b is None else base + timedelta(microseconds=b)) for i, (a, b) in enumerate(spans)]
    cells = win.dyadic_cells(spark.createDataFrame(rows, "window_id int, start timestamp_ntz, end timestamp_ntz")).collect()
    for i, (a, b) in enumerate(spans):
        own = [(c.cell << c.level, (c.cell + 1) << c.level) for c in cells if c.window_id == i]
        held = sorted(at for low, high in own for at in range(low, high))
        assert held == list(range(a - 100, -99 if b is None else b - 99))[: 0 if b is None else None]
        assert len(own) <= 2 * 7 * 5


def test_long_overlapping_windows_are_never_met_one_by_one(spark):
    n = 20_000
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    start = F.pmod(F.xxhash64("id"), F.lit(40 * 86_400_000_000))
    windows = spark.range(1, n + 1).select(F.col("id").alias("window_id"), start.alias("_s"), (start + F.pmod(F.hash("id"), F.lit(5)) * 86_400_000_000 + 7).alias("_e"))
    held = windows.orderBy("window_id").toPandas()
    table = windows.select("window_id", moment(F.col("_s")).alias("start"), moment(F.col("_e")).alias("end"))
    edges = [int(x) + d for x in [*held["_s"][:20], *held["_e"][:20]] for d in (-1, 0, 1)]
    times = edges + [86_400_000_000 * d + 12_345 for d in range(-1, 50)]
    posts = spark.createDataFrame(list(enumerate(times)), "id int, us bigint").select("id", moment(F.col("us")).alias("ts"))
    starts, ends = held["_s"].to_numpy(), held["_e"].to_numpy()
    expected = {}
    for i, at in enumerate(times):
        inside = (starts <= at) & (at <= ends)
        expected[i] = int(inside.argmax()) + 1 if inside.any() else 0
    assert tags(win.tag_with_windows(posts, table, "ts", "id")) == expected


def test_event_table_score_agrees_with_event_list_score(spark):
    rows = [(i, "abc"[i % 3], at("00:00:00") + timedelta(minutes=3 * i)) for i in range(400)]
    events = ["2024-01-01 03:00:00", "2024-01-01 03:40:00", "2024-01-01 17:00:00"]
    p = pubs(spark, rows)
    table = spark.createDataFrame([(datetime.fromisoformat(e),) for e in events], "at timestamp_ntz")
    listed = inf.influence_score(p, "agent", "ts", PERIOD, events, 30).collect()
    tabled = inf.influence_of_events(p, table, "agent", "ts", "at", PERIOD, 30).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, tabled))


def test_many_windows_take_the_two_level_form(spark):
    rows = [(i, "ab"[i % 2], at("00:00:00") + timedelta(minutes=i)) for i in range(300)]
    events = [str(at("00:00:00") + timedelta(minutes=4 * i)) for i in range(1, 70)]
    score = {r.agent: r for r in inf.influence_score(pubs(spark, rows), "agent", "ts", PERIOD, events, 2).collect()}
    # a posts on even minutes: window (4i-2 .. 4i) holds 4i-2 and 4i; b on odd ones: only 4i-1
    assert score["a"].nbr_golden_window_hit == 69 and score["b"].nbr_golden_window_hit == 69
    assert score["b"].total_nbr_publish_in_golden_window == 69
    assert score["a"].total_nbr_publish_in_golden_window == 138


def test_next_event_brute_force_with_a_hot_slot(spark):
    import random

    random.seed(7)
    posts = [(i, at("12:00:00") + timedelta(seconds=random.randrange(-4000, 4000) if i % 3 else random.randrange(-864000, 864000))) for i in range(400)]
    moments = sorted(at("12:00:00") + timedelta(seconds=random.randrange(-500000, 500000)) for _ in range(40))
    moments += [posts[0][1]]
    p = spark.createDataFrame([*posts, (-1, None)], "id int, ts timestamp_ntz")
    e = spark.createDataFrame([(m,) for m in moments], "at timestamp_ntz")
    got = {r.id: r.next_at for r in ordering.next_event(p, e, "ts", "at", slot="6 hours", rows_per_task=5).collect()}
    want = {i: min((m for m in moments if m >= t), default=None) for i, t in posts} | {-1: None}
    assert got == want


def test_crowded_hours_are_spread_by_their_size(spark):
    """A third of all posts in one hour: no task of the join gets more than its share, and no pair is lost or met twice."""
    import random

    random.seed(11)
    hot = at("12:00:00")
    posts = [(i, hot + timedelta(seconds=random.randrange(3600) if i % 3 == 0 else random.randrange(-400000, 400000))) for i in range(3000)]
    events = [(j, hot + timedelta(seconds=random.randrange(-400000, 400000))) for j in range(60)] + [(100, hot + timedelta(minutes=61)), (101, None)]
    p = spark.createDataFrame([*posts, (-1, None)], "id int, ts timestamp_ntz")
    e = spark.createDataFrame(events, "event int, at timestamp_ntz")
    busy = win.busy_hours(p, "ts", 50)
    counted = {}
    for _, t in posts:
        hour = t.replace(minute=0, second=0)
        counted[hour] = counted.get(hour, 0) + 1
    assert {r.hour: r.salts for r in busy.collect()} == {h: -(-n // 50) for h, n in counted.items() if n > 50}
    want = sorted((i, j) for i, t in posts for j, x in events if x and x - timedelta(minutes=90) <= t <= x)
    for table in (busy, None):
        got = win.pairs_within(p, e, "ts", "at", 90, salts=2, busy=table).select("id", "event").collect()
        assert sorted((r.id, r.event) for r in got) == want
    # the spread of the hour itself, as the join keys see it
    salts = {r.hour: r.salts for r in busy.collect()}[hot]
    spread = p.where(F.date_trunc("hour", "ts") == F.lit(hot).cast("timestamp_ntz")).groupBy(F.pmod(F.xxhash64("id", "ts"), F.lit(salts))).count().collect()
    assert len(spread) == salts and max(r["count"] for r in spread) < 100


def test_number_in_order_brute_force(spark):
    import random

    random.seed(3)
    # one key holds most rows, some keys are null
    rows = [(random.choice(["hot"] * 6 + ["x", None]), at("00:00:00") + timedelta(hours=random.randrange(200)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int")
    got = ordering.number_in_order(df, ["k"], ["ts", "id"], carry=["id"]).collect()
    by_key = {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        by_key.setdefault(k, []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = by_key[r.k]
        n = ids.index(r.id)
        assert (r.position, r.prev_id, r.next_id) == (n + 1, ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None)


def test_no_range_of_a_hot_key_is_large(spark):
    """One key holds a third of the rows, all in one minute; its rows still end in many cells, in order."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.lit(1).alias("t"), "id")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ordering.number_in_order(df, ["k"], ["t", "id"], carry=["id"]).collect()
        cells = df.repartitionByRange("k", "t", "id").groupBy("k", F.spark_partition_id()).count().where("k = 'hot'").collect()
        nth = ordering.nth_in_order(df, ["id"], 4321).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    hot = sorted(r.id for r in rows if r.k == "hot")
    assert [r.id for r in sorted((r for r in rows if r.k == "hot"), key=lambda r: r.position)] == hot
    assert {r.id: r.prev_id for r in rows if r.k == "hot"} == dict(zip(hot, [None, *hot[:-1]]))
    assert max(c["count"] for c in cells) < 1000
    assert [r.id for r in nth] == [4320]
