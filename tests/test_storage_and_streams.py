import gzip
import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsewake import schemas
from pulsewake.functions import urls as ur
from pulsewake.operators import articles as art
from pulsewake.operators import posts as po
from pulsewake.operators.history import version_history
from pulsewake.sources import archive, readers, sinks
from pulsewake.plans import catalogue
from pulsewake.plans.check import rows_of
from pulsewake.streaming import flows
from pulsewake.streaming.versions import VersionStore, VersionTables

T0 = datetime(2024, 1, 1)


def test_malformed_csv_rows_are_dropped(spark, tmp_path):
    good = "1,Ann,7,2021-04-01 00:00:00,d,1,2,3,2020-01-01 00:00:00,2021-04-01 00:00:00,4,hello,true"
    (tmp_path / "a.csv").write_text("\n".join([",".join(schemas.POSTS.names), good, good.replace("1,2,3", "many,2,3"), "9,short"]) + "\n")
    rows = readers.read_posts_csv(spark, str(tmp_path)).collect()
    assert [(r.tweet_id, r.followers_count, r.truncated) for r in rows] == [("1", 1, True)]


def test_article_file_pretty_printed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "authors": ["A", "B"],\n  "title": "t",\n  "language": null\n}')
    (tmp_path / "ignored.txt").write_text("{}")
    row = readers.read_articles_json(spark, str(tmp_path)).collect()
    assert [(r.authors, r.title, r.language) for r in row] == [(["A", "B"], "t", None)]


def test_post_cleanse_survives_a_batch_without_reposts(spark, tmp_path):
    post = '{"id_str":"1","created_at":"Wed May 26 07:21:12 +0000 2021","text":"x","truncated":false,"user":%s}'
    user = '{"id_str":"7","name":"Ann","created_at":"Sat May 1 7:01:02 +0000 2021","followers_count":3}'
    (tmp_path / "a.json").write_text(post % user + "\n" + post % "null")
    rows = po.cleanse_posts(readers.read_raw_posts(spark, str(tmp_path))).orderBy(F.col("twitter_handle_id").isNull()).collect()
    assert rows[0].twitter_datetime_hour == datetime(2021, 5, 26, 7) and rows[0].followers_count == 3
    assert rows[1].twitter_handle_name is None and rows[1].tweet_datetime_timestamp == datetime(2021, 5, 26, 7, 21, 12)


def record(kind, url, body, content_type="text/html", length=None):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + content_type.encode() + b"\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-target-uri: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {length or len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_archive_records_and_charsets(spark, tmp_path, zipped):
    bodies = {
        "http://a/latin": ("täglich".encode("latin-1"), "text/html; charset=ISO-8859-1"),
        "http://a/utf": ("täglich\n".encode(), "text/html"),
        "http://a/declared-inside": (b'<meta charset="latin1">' + "ä".encode("latin-1"), "text/html"),
        "http://a/unknown": ("täglich".encode(), "text/html; charset=klingon"),
        "http://a/broken": (b"\xff\xfe\xfa", "text/html"),
        "http://a/empty": (b"", "text/html"),
    }
    data = record("request", "http://a/latin", b"") + b"".join(record("response", u, b, c) for u, (b, c) in bodies.items())
    # enough filler that records straddle read buffers
    data += b"".join(record("response", f"http://f/{i}", b"x" * 997 + str(i).encode()) for i in range(400))
    name = tmp_path / ("a.warc.gz" if zipped else "a.warc")
    name.write_bytes(gzip.compress(data) if zipped else data)
    records = archive.read_archive(spark, str(tmp_path))
    assert records.count() == 1 + len(bodies) + 400 and records.where("NOT is_complete").count() == 0
    pages = {r.url: r.html for r in archive.decoded_pages(records).collect()}
    assert pages.pop("http://f/399") == "x" * 997 + "399" and len(pages) == 399 + 4
    assert pages["http://a/latin"] == "täglich" and pages["http://a/utf"] == "täglich\n" and pages["http://a/unknown"] == "täglich"
    assert pages["http://a/declared-inside"].endswith("ä")
    assert {Path(r.path).name for r in archive.list_archive_files(spark, str(tmp_path)).collect()} == {name.name}


def test_feed_items(spark, tmp_path):
    xml = "<rss><channel><item><title>A &amp; B</title><link>http://a/1</link></item><item><title>C</title><link>http://a/2</link></item></channel></rss>"
    (tmp_path / "f.xml").write_text(xml)
    want = [("http://a/1", "A & B"), ("http://a/2", "C")]
    assert sorted(map(tuple, readers.read_feed(spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, readers.feed_items(spark.createDataFrame([(xml,)], "xml string")).collect())) == want


def test_candles_in_local_time_cross_the_date(spark):
    candle = [1617206400000.0, 1.0, 2.0, 3.0, 0.5, 9.0]  # 2021-03-31 16:00 UTC
    rows = readers.candles_to_prices(spark.createDataFrame([(candle,), (candle,)], "candle array<double>")).collect()
    assert [(r.time, r.close, r.id_date) for r in rows] == [(datetime(2021, 4, 1), 2.0, 20210401)]


def test_result_is_one_file_only_when_asked(spark, tmp_path):
    for single in (True, False):
        path = str(tmp_path / str(single))
        sinks.write_result_csv(spark.range(20, numPartitions=4).orderBy("id"), path, single_file=single)
        files = list((tmp_path / str(single)).glob("part-*.csv"))
        assert (len(files) == 1) == single or not single
        assert sorted(r.id for r in spark.read.schema("id long").csv(path, header=True).collect()) == list(range(20))


def test_large_domain_gets_several_writers(spark, tmp_path):
    rows = [("big" if i % 10 else f"d{i % 7}", f"http://x/{i}") for i in range(600)]
    sinks.write_articles_by_domain(spark.createDataFrame(rows, "source_domain string, url string"), str(tmp_path / "a"), rows_per_file=100)
    assert len(list((tmp_path / "a" / "source_domain=big").glob("*.json"))) > 1
    assert len(list((tmp_path / "a" / "source_domain=d0").glob("*.json"))) == 1
    assert spark.read.json(str(tmp_path / "a")).count() == 600


def test_save_path_shares_what_the_limit_leaves(spark):
    df = spark.createDataFrame([("http://a.example.com/x/" + "n" * 400 + ".html",), ("http://a.example.com/x/short.html",)], "url string")
    template = "/data/%full_domain(5)/%max_url_file_name.%max_url_file_name"
    paths = [r.p for r in df.select(ur.save_path(template, F.col("url"), executed=T0, downloaded=F.lit(T0)).alias("p")).collect()]
    assert 257 <= len(paths[0]) <= 259 and paths[1] == "/data/a.exa/short.short"
    stamped = ur.save_path("%time_download(%Y-%m at %H)/%timestamp_execution", F.col("url"), executed=T0, downloaded=F.lit(T0).cast("timestamp_ntz"))
    assert df.select(stamped.alias("p")).first().p == "2024-01 at 00/1704067200"


def test_pages_become_articles(spark):
    html = ('<html lang="en-GB"><head><title> T </title><meta name="author" content="Ann"><meta property="og:image" content="/i.png">'
            '<meta name="date" content="2024-05-06 07:08:09"></head><body><article><h1>T</h1><p>%s</p></article></body></html>') % " ".join(["word"] * 20)
    pages = spark.createDataFrame([("http://www.e.com/a/b.html", html), ("http://other.org/x", html)], "url string, html string")
    row, = art.articles_from_pages(pages, hosts=["e.com"], download=F.lit("2024-06-01 00:00:00")).collect()
    assert (row.title, row.authors, row.language, row.image_url) == ("T", ["Ann"], "en", "http://www.e.com/i.png")
    assert row.date_publish == datetime(2024, 5, 6, 7, 8, 9) and row.filename == "b.json" and row.source_domain == "e.com"
    assert row.maintext.endswith("word") and row.localpath is None


# -- streams ------------------------------------------------------------------------------------------


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    schema = "id int, ts timestamp"
    run = lambda: flows.run_to_files(
        flows.volume_stream(flows.stream_parquet(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "ts", "1 hour", "10 minutes"),
        str(tmp_path / "out"), str(tmp_path / "state"))
    feed(spark, tmp_path / "in", [(1, T0), (2, T0 + timedelta(minutes=59)), (3, T0 + timedelta(hours=3))], schema)
    run()
    feed(spark, tmp_path / "in", [(4, T0 + timedelta(minutes=1)), (5, T0 + timedelta(hours=3, minutes=5)), (6, T0 + timedelta(hours=9))], schema)
    run()
    got = sorted((r.bucket, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(T0, 2), (T0 + timedelta(hours=3), 2)]


def test_repeated_posts_across_batches_count_once(spark, tmp_path):
    schema = "id string, ts timestamp"
    run = lambda: flows.run_to_files(
        flows.distinct_stream(flows.stream_parquet(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), "id", "ts", "1 hour"),
        str(tmp_path / "out"), str(tmp_path / "state"))
    feed(spark, tmp_path / "in", [("a", T0), ("b", T0), ("a", T0)], schema)
    run()
    feed(spark, tmp_path / "in", [("a", T0 + timedelta(minutes=5)), ("c", T0 + timedelta(minutes=5))], schema)
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def throttled(spark, tmp_path, batches, lateness):
    """Kept hours of page p and q; each batch is its own run over the same state."""
    schema = "url string, at timestamp"
    for batch in batches:
        feed(spark, tmp_path / "in", [(u, T0 + timedelta(hours=x) if x is not None else None) for u, x in batch], schema)
        stream = flows.stream_parquet(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        flows.run_to_files(flows.throttle_stream(stream, "url", "at", 6, lateness), str(tmp_path / "out"), str(tmp_path / "state"), conf=flows.KEYED_STATE)
    return sorted((r.url, (r["at"] - T0) / timedelta(hours=1)) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_throttle_state_lives_across_batches(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    batches = [[("p", 0), ("p", 4), ("q", None)], [("p", 7), ("p", 11), ("p", 11)], [("p", 14)], [(None, 100)]]
    assert throttled(spark, tmp_path, batches, "1 hour") == [("p", 0), ("p", 7), ("p", 14)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider


def test_throttle_takes_late_arrivals_in_their_place(spark, tmp_path):
    # 1 and 8 come after 5 and 12, still within the lateness; 9 comes when the watermark stands at 30
    batches = [[("p", 5), ("q", 2)], [("p", 1), ("p", 12)], [("p", 8), ("q", 3)], [("q", 50)], [("p", 9), ("p", 31)], [(None, 200)]]
    assert throttled(spark, tmp_path, batches, "20 hours") == [("p", 1), ("p", 8), ("p", 31), ("q", 2), ("q", 50)]


def test_throttle_packs_a_page_into_one_row_before_its_state():
    big = 2**60 + 1
    parts = [pa.RecordBatch.from_pydict({"url": pa.array(keys, pa.int64()), "_at": pa.array(at, pa.int64())})
             for keys, at in (([big, None, big, big], [5, 1, 3, 5]), ([big, 7], [9, 2]), ([7], [2]))]
    got = pa.Table.from_batches(flows._packed(iter(parts), rows=6)).to_pylist()
    assert [(r["url"], sorted(r["_moments"]), r["_newest"]) for r in got] == [(big, [3, 5, 9], 9), (None, [1], 1), (7, [2], 2), (7, [2], 2)]


def test_throttle_takes_an_arrival_that_is_just_as_late_as_allowed(spark, tmp_path):
    # 10 comes at a watermark of 10, in one batch with 40; 9 is behind it
    batches = [[("q", 30)], [("p", 10), ("p", 40), ("q", 9)], [(None, 200)]]
    assert throttled(spark, tmp_path, batches, "20 hours") == [("p", 10), ("p", 40), ("q", 30)]


def test_version_store_counts_a_replayed_batch_once(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "log"), "url", "at", "id")
    batch = lambda *rows: spark.createDataFrame([(u, T0 + timedelta(hours=x), i) for u, x, i in rows], "url string, at timestamp_ntz, id bigint")
    store.append(batch(("p", 1, 1), ("q", 1, 2)), 0)
    store.append(batch(("p", 3, 3)), 1)
    store.append(batch(("p", 3, 3)), 1)
    got = {r.id: (r.version, r.ancestor, r.descendant) for r in store.history().collect()}
    assert got == {1: (1, 0, 3), 3: (2, 1, 0), 2: (1, 0, 0)}
    assert {r.id for r in store.current().collect()} == {2, 3}


def test_version_tables_equal_the_history_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(5)
    # one page has a third of all arrivals, some rows have no page or no time, some come twice
    rows = [(rng.choice(["hot", f"p{rng.randrange(12)}", f"p{rng.randrange(12)}"]) if i % 17 else None, T0 + timedelta(hours=rng.randrange(40)) if i % 19 else None, i) for i in range(1, 160)]
    rows.append(rows[30])
    schema = "url string, at timestamp_ntz, id bigint"
    frame = lambda part: spark.createDataFrame(part, schema)
    tables = VersionTables(spark, str(tmp_path / "t"), "url", "at", "id", frame([]).schema, buckets=3)
    key = lambda r: (r.url or "", r.id, r.version, r.ancestor, r.descendant)
    assert tables.history().collect() == []
    cuts = [0, 60, 61, 61, 110, 160]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if number == 3:
            # a merge that fell over after its tables, before its commit: nobody sees it
            frame([("gone", T0, 999)]).withColumn("version", F.lit(1)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(str(tmp_path / f"t/current/batch={number}"))
        tables.merge(frame(rows[a:b]), number)
        want = sorted(map(key, version_history(frame(rows[:b]), "url", "at", "id").collect()))
        assert sorted(map(key, tables.history().collect())) == want
    tables.merge(frame(rows[110:160]), 4)
    tables.merge(frame(rows[60:61]), 1)
    assert sorted(map(key, tables.history().collect())) == want
    newest_rows = {r.url: (r.id, r.version) for r in version_history(frame(rows), "url", "at", "id").where("is_current").collect()}
    assert {r.url: (r.id, r.version) for r in tables.current().collect()} == newest_rows


def test_version_tables_touch_only_the_buckets_of_a_batch(spark, tmp_path):
    schema = "url string, at timestamp_ntz, id bigint"
    rows = [(f"p{i}", T0, i) for i in range(1, 60)]
    tables = VersionTables(spark, str(tmp_path), "url", "at", "id", spark.createDataFrame([], schema).schema, buckets=8)
    tables.merge(spark.createDataFrame(rows, schema), 0)
    tables.merge(spark.createDataFrame([("p7", T0 + timedelta(hours=1), 100)], schema), 1)
    assert len(list((tmp_path / "current/batch=0").glob("bucket=*"))) == 8
    assert len(list((tmp_path / "current/batch=1").glob("bucket=*"))) == 1
    assert [(r.id, r.version, r.descendant) for r in tables.archive().collect()] == [(7, 1, 100)]
    assert {(r.version, r.ancestor) for r in tables.current().where("id = 100").collect()} == {(2, 7)}
    with pytest.raises(ValueError):
        VersionTables(spark, str(tmp_path / "x"), "url", "at", "id", spark.createDataFrame([], "url string, at timestamp, id int, Version int").schema)


def test_records_end_at_their_declared_length(spark, tmp_path):
    inside = b"<p>one WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nrest</p>"
    http = lambda body, charset: b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=" + charset + b"\r\n\r\n" + body
    record = lambda url, content, version=b"1.1", length=None: (
        b"WARC/" + version + b"\r\nWARC-Type: response\r\nWARC-Target-URI: " + url + b"\r\nContent-Length: " + str(length or len(content)).encode() + b"\r\n\r\n" + content + b"\r\n\r\n")
    data = (record(b"a", http(inside, b"utf-8")) + record(b"b", http("\u201cx\u201d".encode("cp1252"), b"windows-1252"), b"1.0")
            + record(b"c", http("日本".encode("shift_jis"), b"shift_jis")) + record(b"d", http(b"\xff\xfe", b"utf-8")) + record(b"e", http(b"cut", b"utf-8"), length=5000))
    (tmp_path / "x.warc").write_bytes(data)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(record(b"f", http(b"packed", b"no-such"))))
    rows = archive.read_archive(spark, str(tmp_path))
    assert {r.url: r.html for r in archive.decoded_pages(rows).collect()} == {"a": inside.decode(), "b": "\u201cx\u201d", "c": "日本", "f": "packed"}
    assert {r.url: r.html for r in archive.decoded_pages(rows, "replace").collect()}["d"] == "\ufffd\ufffd"
    assert {r.reason: r.n for r in archive.discarded_records(rows).collect()} == {"undecodable": 1, "incomplete": 1}


@pytest.mark.parametrize("kind", ["plain", "member per record", "member per two", "one member", "padded", "cut", "noise behind", "bad sum"])
def test_pieces_of_an_archive_give_its_records(spark, tmp_path, kind):
    rng = random.Random(3)
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: u{i}\r\nContent-Length: {'x' if i % 9 == 4 else len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    parts = [record(i, b"WARC/1.0 inside\r\n" + rng.randbytes(rng.choice([0, 50, 4000, 90_000])) if i % 9 != 4 else b"lost") for i in range(60)]
    if kind == "plain":
        data, name = b"".join(parts), "a.warc"
    elif kind == "one member":
        data, name = gzip.compress(b"".join(parts)), "a.warc.gz"
    else:
        step = 2 if kind == "member per two" else 1
        members = [gzip.compress(b"".join(parts[i:i + step])) for i in range(0, len(parts), step)]
        if kind == "bad sum":
            members[40] = members[40][:-8] + b"\0\0\0\1" + members[40][-4:]
        data, name = b"".join(members), "a.warc.gz"
        data += {"padded": bytes(700_000), "noise behind": b"no member"}.get(kind, b"")
        data = data[:-5000] if kind == "cut" else data
    (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path")
    index = archive.record_ranges(files, size=100_000).collect()
    pieces = spark.createDataFrame(index, archive.RANGE_SCHEMA)
    fields = ["record", "url", "is_complete", "error", F.md5("payload").alias("payload")]
    want = sorted((tuple(r) for r in archive.records_of(files).select(*fields).collect()), key=str)
    assert sorted((tuple(r) for r in archive.records_in_ranges(pieces).select(*fields).collect()), key=str) == want
    assert len(want) >= 40 and [r[3] for r in want if r[3]] == {"cut": ["cut"], "noise behind": ["damaged"], "bad sum": ["damaged"]}.get(kind, [])
    assert len(index) == 1 if kind == "one member" else len(index) > 5
    assert all(r.length is None or r.length < 300_000 for r in index)
    # a job that was stopped goes on with the pieces that are left
    done, left = pieces.where("start = 0"), pieces.join(pieces.where("start = 0"), ["path", "start"], "left_anti")
    assert archive.records_in_ranges(done).count() + (archive.records_in_ranges(left).count() if len(index) > 1 else 0) == len(want)


def test_archives_are_read_by_many_tasks_and_decoded_once(spark, tmp_path):
    """The table of addresses is tiny, yet must not end in one task; nor may a filter on the text decode it again."""
    for number in range(12):
        body = "é".encode("latin-1") * 20
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=windows-1252\r\n\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.com/{number}\r\nContent-Length: {len(http)}\r\n\r\n"
        (tmp_path / f"{number}.warc").write_bytes(head.encode() + http + b"\r\n\r\n")
    records = archive.read_archive(spark, str(tmp_path))
    assert records.groupBy(F.spark_partition_id()).count().count() > 1
    pages = archive.decoded_pages(records)
    assert {r.html for r in pages.collect()} == {"é" * 20} and pages.count() == 12
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_ledger_counts_every_record_of_the_archives(spark, tmp_path):
    page = lambda day: ('<html><head><title>T</title><meta name="date" content="%s 07:08:09"></head><body><article><p>%s</p></article></body></html>' % (day, "word " * 20)).encode()
    http = lambda body, kind=b"text/html", status=b"200": b"HTTP/1.1 " + status + b" OK\r\nContent-Type: " + kind + b"\r\n\r\n" + body
    record = lambda url, content, length=None, kind=b"response": (
        b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: " + url + b"\r\nContent-Length: " + str(length or len(content)).encode() + b"\r\n\r\n" + content + b"\r\n\r\n")
    good, late = http(page("2015-06-01")), http(page("2019-06-01"))
    first = record(b"http://a.com/1", good) + record(b"http://a.com/2", late) + record(b"http://b.org/3", good) + record(b"http://a.com/4", http(b""))
    first += record(b"http://a.com/5", http(b"\xff\xfe" * 20)) + record(b"http://a.com/6", http(page("2015-06-01"), b"image/png")) + record(b"http://a.com/7", http(page("2015-06-01"), status=b"404"))
    first += record(b"q", b"GET / HTTP/1.1", kind=b"request") + record(b"http://a.com/8", good, "many") + record(b"http://a.com/9", good, 10**6)
    (tmp_path / "one.warc").write_bytes(first)
    # the same address once more, in a file that is cut, and one that is no archive at all behind its first bytes
    noise = b"".join(record(b"n%d" % i, random.Random(i).randbytes(3000), kind=b"metadata") for i in range(200))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record(b"http://a.com/1", good) + noise)[:300_000])
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(first)[:12] + b"\xff" * 200)
    ledger = art.page_ledger(archive.read_archive(spark, str(tmp_path)), hosts=["a.com"], first="2015-01-01 00:00:00", last="2015-12-31 00:00:00")
    rows = [(Path(r.file).name, r.url, r.status, r.reason) for r in ledger.collect()]
    a = lambda n: f"http://a.com/{n}"
    assert sorted(rows, key=str) == sorted([
        ("one.warc", a(1), "passed", None), ("one.warc", a(2), "discarded", "date"), ("one.warc", "http://b.org/3", "discarded", "host"),
        ("one.warc", a(4), "discarded", "empty"), ("one.warc", a(5), "discarded", "undecodable"), ("one.warc", a(6), "discarded", "response"),
        ("one.warc", a(7), "discarded", "response"), ("one.warc", a(8), "error", "incomplete"), ("one.warc", a(9), "error", "incomplete"),
        ("cut.warc.gz", a(1), "passed", None), ("cut.warc.gz", None, "error", "damaged"), ("bad.warc.gz", None, "error", "damaged"),
    ], key=str)
    counters = {Path(r.file).name: r for r in art.run_counters(ledger, "file", "status", "seconds").collect()}
    one = counters["one.warc"]
    assert (one.total, one.passed, one.discarded, one.failed) == (9, 1, 6, 2) and one.seconds_per_article > 0
    assert sorted(r.url for r in art.articles_from_ledger(ledger).collect()) == [a(1), a(1)]
    assert {r.url for r in archive.decoded_pages(archive.read_archive(spark, str(tmp_path))).collect()} == {a(1), a(2), "http://b.org/3", a(6), a(7)}


def test_articles_without_a_domain_are_written(spark, tmp_path):
    articles = spark.createDataFrame([("u1", None, "a"), (None, None, "b"), ("u3", "e.com", "c")], "url string, source_domain string, title string")
    sinks.write_articles_by_domain(articles, str(tmp_path / "d"))
    back = spark.read.schema("title string, source_domain string").json(str(tmp_path / "d")).collect()
    assert sorted((r.title, r.source_domain) for r in back) == [("a", None), ("b", None), ("c", "e.com")]


@pytest.mark.parametrize("name", ["t03_stream_volume", "t04_stream_throttle", "t06_stream_interval_join"])
def test_stream_queries_do_not_depend_on_batches(spark, tmp_path, name):
    rows = [(i, T0 + timedelta(minutes=11 * (i * 37 % 600)), i % 3, "purchase" if i % 2 else "view", 210.0, '{"k": 1}') for i in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    parts = [events.where(F.col("event_id") % 6 == k).coalesce(1) for k in range(6)]
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    result = con.execute(catalogue.ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    got = catalogue.QUERIES[name](spark, str(tmp_path), files_per_batch=1)
    assert rows_of(got.columns, got.collect()) == want and len(want) > 50


def test_stream_join_takes_a_table_of_crowded_hours(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=i * 20 if i % 3 else i), 1, "purchase" if i % 5 == 0 else "view", 210.0, '{"k": 1}') for i in range(600)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("t06_stream_interval_join", "j15_publications_before_events"):
        result = con.execute(catalogue.ORACLES[name])
        want = rows_of([d[0] for d in result.description], result.fetchall())
        got = catalogue.QUERIES[name](spark, str(tmp_path), rows_per_task=40)
        assert rows_of(got.columns, got.collect()) == want and len(want) > 50


@pytest.mark.parametrize("packed", [False, True])
def test_lengths_that_are_no_number_leave_the_other_records(spark, tmp_path, packed):
    record = lambda url, length, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {length}\r\n\r\n{body}\r\n\r\n".encode()
    bad = ["many", "-5", "", "1e3", "12 bytes", "9" * 30, "٣"]
    data = b"".join(record(f"bad{i}", length, "lost\r\nlines") + record(f"good{i}", 4, "kept") for i, length in enumerate(bad))
    data += record("open", 10**17, "no end")
    (tmp_path / "a.warc").write_bytes(gzip.compress(data) if packed else data)
    rows = {r.url: r for r in archive.read_archive(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 * len(bad) + 1
    for i in range(len(bad)):
        assert rows[f"good{i}"].is_complete and bytes(rows[f"good{i}"].payload) == b"kept"
        assert not rows[f"bad{i}"].is_complete and bytes(rows[f"bad{i}"].payload) == b""
    assert not rows["open"].is_complete


def test_latest_leaves_the_schema_of_the_caller(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    rows.write.parquet(f"{tmp_path}/out/batch=0")
    rows.where("k = 'a'").withColumn("n", F.lit(7)).write.parquet(f"{tmp_path}/out/batch=1")
    for _ in range(2):
        assert {tuple(r) for r in flows.latest(spark, f"{tmp_path}/out", rows.schema, ["k"]).collect()} == {("a", 7), ("b", 2)}
    assert rows.schema.names == ["k", "n"]
