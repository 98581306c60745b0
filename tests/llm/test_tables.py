"""Repeats, near-duplicates, search, archives and address filters against brute force, with odd inputs."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsewake.llm import components, near, prefixes, repeats, search, urlfilter, warc

ODD = [None, "", " ", "\n\t", "a", "word " * 300, "x" * 5000, "A b\tC\x0bd", "same text", "same text"]


def frame(spark, texts, ids=None):
    rows = [(i, t, "extra", -1, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, `group` string")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- repeats ------------------------------------------------------------------------------------------------------


def plain_repeats(texts, window):
    split, at = [spaced(t) for t in texts], collections.Counter()
    for ws in split:
        at.update(tuple(ws[a : a + window]) for a in range(len(ws) - window + 1))
    out = []
    for ws in split:
        gone = {a + k for a in range(len(ws) - window + 1) if at[tuple(ws[a : a + window])] > 1 for k in range(window)}
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), kept))
    return out


@pytest.mark.parametrize("window,gram", [(35, None), (6, None), (6, 6), (6, 1), (1, None)])
def test_repeats_against_brute_force(spark, window, gram):
    random.seed(window)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "日本"]
    passages = [" ".join(random.choice(vocabulary) for _ in range(n)) for n in (5, 34, 35, 36, 90)]
    texts = []
    for _ in range(60):
        parts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 30))) for _ in range(3)]
        texts.append("\n".join([parts[0], random.choice(passages), parts[1], random.choice(passages), parts[2]]))
    texts += [*texts[:2], texts[5] + " end", "a b " * 60, *ODD]
    docs = frame(spark, texts, [None if i % 9 == 0 else i for i in range(len(texts))])
    rows = repeats.find_repeats(docs, window=window, gram=gram).collect()
    want = plain_repeats(texts, window)
    key = lambda r: (r[0] or "", r[1:])
    got = sorted(((r.text, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in rows), key=key)
    assert got == sorted(((t, n, m, k, hashlib.sha256(k.encode()).hexdigest()) for t, (n, m, k) in zip(texts, want)), key=key)
    assert all(sum(s.end - s.begin for s in r.repeats) == r.n_removed and r.lang == "extra" for r in rows)
    cut = repeats.remove_repeats(docs, window=window)
    assert cut.columns == docs.columns
    assert sorted(r.text or "" for r in cut.collect()) == sorted((k if m else t) or "" for t, (_, m, k) in zip(texts, want))


def test_repeats_of_nothing(spark):
    assert repeats.find_repeats(frame(spark, [])).count() == 0


# -- near-duplicates ----------------------------------------------------------------------------------------------


def plain_components(texts, percent=75):
    sets = []
    for t in texts:
        ws = spaced(lower(t))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("node", [1024, 20])
def test_near_duplicates_against_brute_force(spark, node):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base, passage = ([random.choice(vocabulary) for _ in range(120)] for _ in range(2))
    texts = []
    for _ in range(70):  # a large group of near copies, some at the border
        own = list(base)
        for _ in range(random.randint(1, 8)):
            own[random.randrange(120)] = random.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [" ".join(passage + [random.choice(vocabulary) for _ in range(random.randint(20, 90))]) for _ in range(60)]
    texts += [*texts[:10], texts[80].upper(), "a b c", "A b C", "a b c d e", *ODD]
    docs = frame(spark, texts)
    rows = {r.id: r for r in near.near_duplicates(docs, node=node).collect()}
    sizes, wanted = plain_components(texts)
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == wanted
    kept = near.drop_near_duplicates(docs, node=node)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, c in enumerate(wanted) if i == c]


def test_near_duplicates_with_null_and_equal_ids(spark):
    texts = ["one two three four five six", "one two three four five six", "another text of quite other words", None, "one two three four five six", "", ""]
    docs = frame(spark, texts, [None, 7, None, None, 7, 8, 8])
    rows = near.near_duplicates(docs).collect()
    assert sorted((r.id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 2, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (8, 0, 8)]
    kept = near.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (-1, texts[2]), (7, texts[0]), (8, ""), (8, "")]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_with_text_ids_and_clashing_columns(spark):
    texts = ["one two three four five six", "one two three four five six", "another text of quite other words"]
    rows = [(f"d{i}", t, i, "x", 7, "own", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `__id` int, `__hash` string, `__doc` int, `__group` string, `row` int, tag int")
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_recall_of_deep_trees(spark):
    """Pairs at 0.75 to 0.80 among thousands of texts that share much with all others, in nodes of 16: trees of many levels."""
    random.seed(8)
    base = [f"b{i}" for i in range(60)]
    texts, pairs = [], []
    for k in range(1500):
        # equal beginnings hold 56 shingles of every text; a pair shares more
        own = base + [f"{k}x{i}" for i in range(52)]
        other = list(own)
        for i in random.sample(range(62, 110), 3):
            other[i] = f"{k}y{i}"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(own), " ".join(other)]
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    wanted = [p for p, s in zip(pairs, alike) if 0.75 <= s]
    assert len(wanted) > 1000 and sorted(alike)[len(alike) // 2] < 0.79
    found = {r.id: r.component_id for r in near.near_duplicates(frame(spark, texts), node=16).collect()}
    assert sum(found[a] == found[b] for a, b in wanted) >= 0.99 * len(wanted)
    assert all(found[a] == a for a, _ in pairs)


def test_thresholds_the_filter_is_not_made_for_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        near.near_duplicates(docs, threshold=50)


def test_similarity_at_the_threshold():
    import numpy as np

    a = np.arange(3, dtype=np.uint64)
    assert near.linked(a, np.arange(4, dtype=np.uint64), 75) and not near.linked(a, np.arange(5, dtype=np.uint64), 75)


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (301, 300), (300, 301)]
    random.shuffle(pairs)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}


# -- grouped prefix join ------------------------------------------------------------------------------------------


def some_texts(seed, n=70):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    base, passage = ([random.choice(vocabulary) for _ in range(120)] for _ in range(2))
    texts = []
    for _ in range(n):  # a large group of near copies, many at the border
        own = list(base)
        for _ in range(random.randint(1, 5)):
            own[random.randrange(120)] = random.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [" ".join(passage + [random.choice(vocabulary) for _ in range(random.randint(5, 90))]) for _ in range(60)]
    return texts + [*texts[:10], texts[80].upper(), " ".join(base[:110]), "a b c", "A b C", "a b c d e", "a b c d f", *ODD]


def test_a_group_and_a_component_are_one_candidate():
    # groups 0 to 49 are one component, 50 and 51 are single; three lists, two of them blocks of one token
    groups, at = list(range(52)), 100 << 32
    block = lambda spot: {"groups": groups, "ats": [at] * 52, "comps": [0] * 50 + [50, 51], "shorts": [0] * 52, "sizes": [50] * 50 + [1, 1], "spot": spot}
    batch = pa.RecordBatch.from_pylist([block(0), block(7), block(7)])
    rows = pa.Table.from_batches(prefixes._inside_pairs(80)(iter([batch]))).to_pylist()
    got = sorted((r["a"], r["b"], r["spot"]) + ((r["shared"],) if r["spot"] else ()) for r in rows)
    assert got == [(50, 0, 0), (50, 0, 7, 1), (50, 51, 0), (51, 0, 0), (51, 0, 7, 1)]
    assert [r["shared"] for r in rows if r["b"] == 51] == [3]


def test_postings_far_from_the_beginning_make_no_pairs():
    """Near copies with 20 tokens of their own before the common ones share too little; a pair would need 14 of the prefixes of 30."""
    rows = []
    for at in range(20, 30):
        block = [list(range(200)), [(146 << 32) + at] * 200, list(range(200)), [0] * 200, [1] * 200]
        rows.append(dict(zip(("groups", "ats", "comps", "shorts", "sizes", "spot"), [*block, 0])))
    inside, alone = (pa.RecordBatch.from_pylist(x) for x in (rows, [{k: r[k] for k in ("groups", "ats")} for r in rows]))
    across = pa.RecordBatch.from_pylist([{f"{t}_{k}": [v + 1000 * (t == "y") if k in ("groups", "comps") else v for v in r[k]] for t in "xy" for k in list(r)[:5]} | {"spot": 0} for r in rows])
    for pairs, batch in ((prefixes._inside_pairs, inside), (prefixes._across_pairs, across), (prefixes._near_pairs, alone)):
        assert sum(b.num_rows for b in pairs(80)(iter([batch]))) == 0


def test_linked_sets_share_what_is_needed_near_the_beginning():
    import numpy as np

    random.seed(8)
    linked = 0
    for _ in range(3000):
        threshold, n = random.choice((50, 60, 75, 80, 90)), random.randint(1, 40)
        x = set(random.sample(range(60), n))
        y = (x - set(random.sample(sorted(x), random.randint(0, n // 3)))) | set(random.sample(range(60), random.randint(0, 1 + n // 4)))
        if not y or 100 * len(x & y) < threshold * len(x | y):
            continue
        linked += 1
        order = [{t: (len(s) << 32) + i for i, t in enumerate(sorted(s)[: int(prefixes.prefix_size(np.int64(len(s)), threshold))])} for s in (x, y)]
        shared = sorted(order[0].keys() & order[1].keys())
        left, right = (np.array([o[t] for t in shared], dtype=np.int64) for o in order)
        assert prefixes.may_link(left, right, threshold).sum() >= prefixes.needed(np.int64(len(x)), np.int64(len(y)), threshold) >= 1
    assert linked > 500


@pytest.mark.parametrize("threshold,block,common,listed", [(80, 256, 4, 1 << 18), (80, 4, 1, 50), (60, 2, 4, 0)])
def test_prefix_join_against_brute_force(spark, monkeypatch, threshold, block, common, listed):
    monkeypatch.setattr(prefixes, "COMMON", common)
    monkeypatch.setattr(prefixes, "LISTED", listed)
    monkeypatch.setattr(prefixes, "SAMPLE", 2)
    texts = some_texts(threshold)
    rows = {r.id: r for r in prefixes.similar_documents(frame(spark, texts), threshold=threshold, block=block).collect()}
    sizes, wanted = plain_components(texts, threshold)
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == wanted


def test_prefix_join_of_groups_of_several_classes(spark):
    """Texts that differ at their ends only: equal prefixes, and members that are linked where the first of a group isn't."""
    random.seed(21)
    texts = []
    for k in range(25):
        base = [f"{k}w{i}" for i in range(random.randint(9, 30))]
        for _ in range(16):
            cut, more = random.randint(0, 2), random.randint(0, 3)
            texts.append(" ".join(base[cut : len(base) - random.randint(0, 2)] + [f"e{random.randint(0, 3)}" for _ in range(more)]))
    rows = {r.id: r for r in prefixes.similar_documents(frame(spark, texts)).collect()}
    assert [rows[i].component_id for i in range(len(texts))] == plain_components(texts, 80)[1]
    assert len({r.class_id for r in rows.values()}) > 2 * len({r.component_id for r in rows.values()})


def test_prefix_join_with_odd_ids(spark):
    texts = ["one two three four five six", "one two three four five six", "another text of quite other words", None, "one two three four five six", "", ""]
    rows = prefixes.similar_documents(frame(spark, texts, [None, 7, None, None, 7, 8, 8])).collect()
    assert sorted((r.id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 2, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (8, 0, 8)]
    assert prefixes.similar_documents(frame(spark, texts).limit(0)).count() == 0
    named = spark.createDataFrame([("b", texts[0], 1), ("a", texts[0], 2)], "doc_id string, text string, class int")
    assert {r.component_id for r in prefixes.similar_documents(named).collect()} == {"a"}


def test_prefixes_hold_a_shared_token():
    import numpy as np

    for threshold in (50, 75, 80, 90):
        for n in range(1, 60):
            p = int(prefixes.prefix_size(np.int64(n), threshold))
            # fewer than needed lie behind the prefix, for every partner that is large enough
            assert 1 <= p <= n and 100 * (n - p) < threshold * n


# -- search -------------------------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    random.seed(8)
    rows = [(i, [random.gauss(0, 0.4) for _ in range(20)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("inf")] + [0.0] * 19), (304, []), (305, [0.5, -0.5]), (None, [0.1] * 20), (20, [0.2] * 20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = search.integer_vectors(table)
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sorted((r.id, r.v) for r in vectors.collect()) == sorted(whole)
    for k, sizes in ((7, {}), (20, {"queries_in_block": 3, "candidates_in_block": 25}), (500, {})):
        want = []
        for i, q in whole:
            if i % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:k]
                want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
        got = search.top_k(vectors, vectors.where("id % 20 = 0"), k, **sizes)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert search.top_k(vectors.limit(0), vectors, 5).count() == 0
    assert search.top_k(vectors, vectors.limit(0), 5).count() == 0


def test_top_k_of_huge_components(spark):
    table = spark.createDataFrame([(0, [1e9, 2.0]), (1, [3e9, 1.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    vectors = search.integer_vectors(table).where("id < 2")
    row = search.top_k(vectors, vectors.where("id = 0"), 1).first()
    assert row.score == min(2**63 - 1, int(64e9) * int(192e9) + 128 * 64)


# -- archives -----------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    texts = ["<p>one WARC/1.0\r\nrest</p>", "same", "same", "same", None, "", "é日本" * 3000, "WARC/1.1\r\n\r\n" * 5, "\r\n\r\n"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://a.example/{i}\r\nx y", t, "extra") for i, t in enumerate(texts)], "page_id long, url string, html string, payload string")
    warc.write_archives(pages.repartition(3), str(tmp_path / "a"))
    rows = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "a")).collect()}
    assert len(rows) == len(texts)
    first = {t or "": i for i, t in enumerate(texts)}
    for i, text in enumerate(texts):
        data, row = (text or "").encode(), rows[f"<urn:page:{i}>"]
        assert row.payload_bytes == len(data) and row.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode() and row.complete
        if first[text or ""] == i:
            assert row.record_type == "response" and bytes(row.payload) == data and row.refers_to is None
        else:
            assert row.record_type == "revisit" and row.payload is None and row.refers_to == f"<urn:page:{first[text or '']}>"
        assert (row.target_uri is None) == (i == 2)
    bounded = warc.archive_records(pages, least_bytes=5).collect()
    assert {r.record_id for r in bounded if r.record_type == "revisit"} == set()
    empty = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_archive_filters_are_pushed_and_contents_skipped(spark, tmp_path):
    plain = (b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
             b"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <b>\r\nX-Long: one\r\n two\r\nContent-Type: application/http\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
             b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <c>\r\nContent-Length: 100\r\n\r\ncut off")
    (tmp_path / "x.warc").write_bytes(plain)
    rows = warc.read_warc(spark, str(tmp_path / "x.warc"))
    assert [(r.record_id, bytes(r.payload), r.complete) for r in rows.orderBy("record_id").collect()] == [("<a>", b"abcd", True), ("<b>", b"abc", True), ("<c>", b"", False)]
    some = rows.where((F.col("record_type") == "response") & F.col("record_id").isin("<b>", "<z>"))
    assert [r.record_id for r in some.collect()] == ["<b>"]
    reader = warc.WarcReader(str(tmp_path / "x.warc"), True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 3), warc.StringStartsWith(("record_id",), "<b")]))
    assert [t.attribute for t in left] == [("payload_bytes",)]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.column("record_id").to_pylist() for b in batches] == [["<b>"]]


def test_archive_files_outside_the_manifest_are_left_out(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "x")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "m"))
    done = next((tmp_path / "m").glob("*.warc.gz"))
    (tmp_path / "m" / "left-over.warc.gz").write_bytes(done.read_bytes())  # of a task that ran twice
    assert warc.read_warc(spark, str(tmp_path / "m")).count() == 1


def test_page_ids_null_and_repeated(spark):
    pages = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (3, "u", "x"), (3, "v", "x"), (None, "u", "only")], "page_id long, url string, html string")
    rows = warc.archive_records(pages).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to or "") for r in rows) == [
        ("<urn:page:1>", "revisit", "<urn:page:3>"), ("<urn:page:3>", "response", ""), ("<urn:page:3>", "response", ""),
        ("<urn:page:>", "response", ""), ("<urn:page:>", "revisit", "<urn:page:3>")]


# -- addresses ----------------------------------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_verdict(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if listed else "allow"


@pytest.mark.parametrize("filter_bytes", [8 << 20, 32])
def test_addresses_against_brute_force(spark, filter_bytes):
    urls = [None, "", "no protocol", "http://", "http://A.Example.ORG/es/x", "https://example.org/en/12?a#b", "http://org", "http://org/", "http://xorg/y", "ftp://my.com/fr/", "http://my.com/de/1",
            "http://my.com:80/de/1", "http://my.com?q=/fr/", "http://www.site.net/a/", "https://site.net/a?utm_x=1#f", "http://site.net/a?b=2&a=1", "http://site.net/a?a=1&b=2&ref=x", "http://other.net/://x", "x://y://z/p"]
    urls += [f"http://h{i}.net/p{i % 3}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "clash", "extra") for i, u in enumerate(urls)], "page_id long, url string, host string, more string")
    listed = spark.createDataFrame([("site.net/a",), ("site.net/a",), (None,), *((f"h{i}.net/p{i % 3}",) for i in range(0, 200, 7))], "address string")
    names = {r.address for r in listed.collect()}
    rows = {r.page_id: r for r in urlfilter.judge(pages, listed, RULES, filter_bytes=filter_bytes).collect()}
    assert len(rows) == len(urls)
    for i, url in enumerate(urls):
        r = rows[i]
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(url, r.canonical in names), url
        assert r.more == "extra"
    assert rows[13].canonical == rows[14].canonical == "site.net/a" and rows[13].verdict == "block"
    assert rows[15].canonical == rows[16].canonical == "site.net/a?a=1&b=2" and rows[15].verdict == "allow"
    assert urlfilter.judge(pages, listed.limit(0), RULES).where("verdict = 'block' and rule is null").count() == 0
    assert urlfilter.judge(pages.limit(0), listed, RULES).count() == 0


def test_filter_passes_few_addresses_that_are_not_listed(spark):
    listed = spark.range(5000).select(F.concat(F.lit("in"), "id").alias("listed"))
    blocks = urlfilter.blocks_for(5000)
    sieve = urlfilter.bloom_filter(listed, blocks)
    for prefix, least, most in (("in", 5000, 5000), ("out", 0, 150)):
        probe = spark.range(5000).select(F.concat(F.lit(prefix), "id").alias("a")).join(sieve, urlfilter._place(F.col("a"), blocks) == F.col("block"))
        for i in range(urlfilter.WORDS):
            probe = probe.where(F.col(f"w{i}").bitwiseAND(urlfilter._bits(F.col("a"), i)) != 0)
        assert least <= probe.count() <= most
