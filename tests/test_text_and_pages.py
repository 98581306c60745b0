import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pulsewake.functions import html as h
from pulsewake.functions import text as tx
from pulsewake.functions import times as tm
from pulsewake.functions import urls as ur
from pulsewake.operators import articles as art
from pulsewake.operators import candidates as cand
from pulsewake.operators import language as lg
from pulsewake.operators import relational as rel

# the whitespace rules as they read with look-around
STEPS = [(r"(?<=\n)( )+", ""), (r"^[ \t\n\r\f]*", ""), (r"[ \t]+(?=([ \t]))", ""), (r"[ \n]+(?=(\n))", ""), (r"[ \n]*$", "")]


def test_whitespace_rules_equal_their_look_around_form(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(" \n\t\rab") for _ in range(r.randrange(25))) for _ in range(2000)]

    def plain(text):
        for pattern, to in STEPS:
            text = re.sub(pattern, to, text)
        return text

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", tx.clean_whitespace(F.col("t")).alias("c")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def ask(spark, function, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(function(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first().v


@pytest.mark.parametrize("function,url,want", [
    (ur.full_domain, "http://www.a.b.example.com/x", "a.b.example.com"),
    (ur.full_domain, "http://wwwxexample.com/x", "example.com"),
    (ur.full_domain, "nothing", None),
    (ur.registrable_domain, "http://a.b.example.co.uk/x", "co.uk"),
    (ur.subdomain, "http://a.b.example.com/x", "a.b."),
    (ur.subdomain, "http://example.com/x", ""),
    (ur.start_url, "https://www.example.com/a/b", "http://example.com/"),
    (ur.directory_string, "http://p.example.de/articles/56f2/", "articles"),
    (ur.directory_string, "http://p.example.de/a/b/c.html", "a_b"),
    (ur.directory_string, "http://p.example.de", ""),
    (ur.file_name, "http://p.example.de/a/some-file-1.html", "some-file-1"),
    (ur.file_name, "http://p.example.de/a/v1.averylongtail", "v1.averylongtail"),
    (ur.file_name, "http://p.example.de/a/", ""),
    (ur.host, "https://User@WWW.Example.com:80/x", "www.example.com"),
    (lambda u: ur.is_followable(u), "http://e.com/a.JPEG", False),
    (lambda u: ur.is_followable(u), "http://e.com/pdf", True),
    (ur.relative_path, "./data/x", "data/x"),
    (ur.path_safe, 'a<b>:"|?*c', "a_b______c"),
    (ur.base_name, "c:\\x/y.html", "y.html"),
    (tx.language_code, "de_DE", "de"),
    (tx.language_code, "english", None),
    (lambda t: tx.md5_when_too_long(t, 40), "short", "short"),
])
def test_small_functions(spark, function, url, want):
    assert ask(spark, function, url) == want


def test_trimmed_names_have_the_asked_length(spark):
    assert len(ask(spark, lambda t: tx.md5_when_too_long(t, 50), "x" * 80)) == 50
    assert len(ask(spark, lambda t: tx.md5_when_too_long(t, 20), "x" * 80)) == 20


@pytest.mark.parametrize("link,want", [
    ("http://o.com/x", "http://o.com/x"), ("//o.com/x", "https://o.com/x"), ("/x?y", "https://e.com/x?y"), ("x.png", "https://e.com/a/x.png"),
    ("./x.png", "https://e.com/a/x.png"), ("?q", "https://e.com/a/b?q"), ("#t", "https://e.com/a/b?c#t"), ("", "https://e.com/a/b?c"),
])
def test_links_are_resolved(spark, link, want):
    assert ask(spark, ur.absolute_url, "https://e.com/a/b?c", link) == want


def test_constant_base_of_a_template():
    assert ur.constant_base("/this/is/a/pa%th/x") == "/this/is/a" and ur.constant_base("/plain") == "/plain"


PAGE = "<html{lang}><head>{head}</head><body>{body}</body></html>"


def page(head="", body="", lang=""):
    return PAGE.format(head=head, body=body, lang=lang)


def test_article_marks(spark):
    yes = page('<meta content="article" property="og:type">')
    assert ask(spark, h.og_type, yes) and ask(spark, h.meta_contains_article_keyword, yes)
    assert not ask(spark, h.og_type, page('<meta property="og:type" content="website">'))
    assert ask(spark, h.meta_contains_article_keyword, page('<meta name="k" content="an article of">'))


def test_headline_ratio(spark):
    five = "<h1>a</h1><h2><a href='http://x.e.com/1'>b</a></h2><h2><a href='/r'>c</a></h2><h3>d</h3><h6>e</h6>"
    assert ask(spark, h.linked_headline_ratio, page(body=five)) == 2 / 5
    assert ask(spark, lambda p, s: h.linked_headline_ratio(p, 5, s), page(body=five), "http://e.com") == 1 / 5
    assert ask(spark, h.linked_headline_ratio, page(body=five[: five.index("<h6>")])) is None


@pytest.mark.parametrize("head,body,url,want", [
    ('<script type="application/ld+json">{"datePublished": "2016-01-01", "dateCreated": "2016-01-02"}</script>', "", "http://e.com/2011/05/06/x", "2016-01-02"),
    ('<meta name="keywords" content="2001-01-01"><meta itemprop="dateCreated" content="2015-11-26">', "", "u", "2015-11-26"),
    ('<meta property="og:image" content="/pics/none.jpg"><meta name="DC.date.issued" content="2015-11-27">', "", "u", "2015-11-27"),
    ('<meta http-equiv="date" content="26 Nov 2015">', "", "u", "2015-11-26"),
    ("", '<time datetime="2014-02-03">x</time>', "u", "2014-02-03"),
    ("", '<time class="timestamp">2014-02-04</time>', "u", "2014-02-04"),
    ("", '<span itemprop="datePublished">2014-02-05</span>', "u", "2014-02-05"),
    ("", '<p class="x">no</p><div class="the-pubdate">soon</div><p class="date">2014-02-06</p>', "u", "2014-02-06"),
    ("", "", "http://e.com/news/2013-jul-04/x", "2013-07-04"),
    ("", "", "http://e.com/news/2013/07/04/x.html", "2013-07-04"),
    ("", "", "http://e.com/x", None),
])
def test_publish_date_order(spark, head, body, url, want):
    got = ask(spark, lambda p, u: h.publish_date(p, u).cast("date").cast("string"), page(head, body), url)
    assert got == want


@pytest.mark.parametrize("head,lang,want", [
    ("", ' lang="en-US"', "en"), ("", " xml:lang='fr'", "fr"), ('<meta name="language" content="es">', "", "es"),
    ('<meta content="de_DE" property="og:locale">', "", "de"), ("", "", None),
])
def test_language_order(spark, head, lang, want):
    assert ask(spark, h.page_language, page(head, lang=lang)) == want


def test_attributes_may_hold_the_other_quote(spark):
    assert ask(spark, lambda t: h.attribute(t, "href"), """<a href="/l'eau">""") == "/l'eau"
    assert ask(spark, lambda t: h.attribute(t, "href"), "<a data-href='x'>") is None


@pytest.mark.parametrize("condition,ratio,want", [
    ("<=0.65", 0.65, True), ("<0.65", 0.65, False), (">=0.5", 0.4, False), (">0.3", 0.4, True), ("=0.4", 0.4, True), ("0.4", 0.4, True),
    (0.4, 0.4, True), (1, 0.4, False), ("lots", 0.4, False), ("lots", None, True), ("<=0.1", None, True),
])
def test_threshold_conditions(spark, condition, ratio, want):
    df = spark.createDataFrame([(ratio,)], "r double")
    assert df.select(art.meets(F.col("r"), condition).alias("v")).first().v is want


@pytest.mark.parametrize("text,want", [
    ("a and b", False), ("a or b", True), ("a and not b", True), ("(a or b) and b", False), ("a and unknown", True), ("not unknown or b", False),
])
def test_conditions_combine(spark, text, want):
    df = spark.createDataFrame([(True, False)], "check_a boolean, check_b boolean")
    assert df.select(art.combine(text, ["a", "b"]).alias("v")).first().v is want


def test_conditions_take_only_words():
    with pytest.raises(ValueError):
        art.combine("a; drop", ["a"])


def test_quoted_condition(spark):
    assert ask(spark, lambda v: art.text_equals(v, "'x y'"), "x y") and not ask(spark, lambda v: art.text_equals(v, "x y"), "x y")


def candidates(spark, offers):
    rows = [(1, i, e, f.get("title"), f.get("description"), f.get("text"), f.get("topimage"), f.get("author"), f.get("publish_date"), f.get("language"))
            for i, (e, f) in enumerate(offers)]
    schema = "page int, ord int, extractor string, " + ", ".join(f"{f} string" for f in cand.FIELDS)
    return cand.from_rows(spark.createDataFrame(rows, schema), "page", "ord")


def chosen(spark, function, *offers):
    return candidates(spark, offers).select(function(F.col("candidates")).alias("v")).first().v


@pytest.mark.parametrize("titles,want", [
    (["bbb", "cc", None], "cc"), (["x", "long one", "long one"], "long one"), (["aa", "aa", "aa", "b", "b"], "aa"),
    (["aaa", "aaa", "bb", "bb"], "bb"), (["b", "a"], "a"), ([None], None),
])
def test_title_choice(spark, titles, want):
    assert chosen(spark, cand.choose_title, *[(f"e{i}", {"title": t}) for i, t in enumerate(titles)]) == want


def words(*parts):
    return " ".join(f"w{i}" for a, b in parts for i in range(a, b))


@pytest.mark.parametrize("texts,want", [
    ([("a", words((0, 14))), ("b", words((0, 15)))], 1),               # the first is too short
    ([("a", words((0, 14)))], None),
    ([("a", words((0, 20))), ("b", words((0, 21)))], 1),               # the longer
    ([("a", words((0, 20))), ("body", words((0, 15)))], 1),            # the preferred
    ([("a", words((0, 20))), ("b", words((20, 40)))], 1),              # disjoint, second on a tie
    ([("body", words((0, 20))), ("a", words((50, 70))), ("b", words((50, 71)))], 2),  # the best pair leaves it out
])
def test_text_choice(spark, texts, want):
    got = chosen(spark, cand.choose_text, *[(e, {"text": t}) for e, t in texts])
    assert got == (texts[want][1] if want is not None else None)


@pytest.mark.parametrize("codes,want", [
    ([("a", "en"), ("b", "de"), ("head", "fr")], "fr"), ([("a", "en"), ("b", "en"), ("head", "fr")], "en"), ([("a", "en"), ("b", "fr")], "fr"),
    ([("a", ""), ("b", None)], None),
])
def test_language_choice(spark, codes, want):
    assert chosen(spark, cand.choose_language, *[(e, {"language": c}) for e, c in codes]) == want


def test_preferred_and_first_choice(spark):
    offers = [("a", {"author": "[]", "topimage": "p.png"}), ("b", {"author": "B"}), ("head", {"topimage": "/q.png"})]
    assert chosen(spark, lambda c: cand.choose_preferred(c, "author", "head"), *offers) == "B"
    assert chosen(spark, lambda c: cand.choose_image(c, F.lit("http://e.com/x/y")), *offers) == "http://e.com/q.png"
    assert chosen(spark, lambda c: cand.choose_image(c, F.lit("http://e.com/x/y")), *offers[:2]) == "http://e.com/x/p.png"


def test_corpus_keeps_one_of_each_article_and_prefers_no_copy_for_passing(spark):
    base = dict(authors=["A"], date_download="d", date_publish="2024", description=None, filename="f", language="en", maintext="bitcoin", source_domain="s", title="t", url="1")
    rows = [base, {**base, "url": "2"}, {**base, "title": "u", "language": "de", "url": "3"}, {**base, "title": "u", "url": "4"}, {**base, "authors": ["B"], "maintext": "x", "url": "5"}]
    df = spark.createDataFrame(rows, "authors array<string>, date_download string, date_publish string, description string, filename string, language string, maintext string, source_domain string, title string, url string")
    # the first copy of "u" is German, so the article is out although a later copy would pass
    assert [r.url for r in art.build_corpus(df).collect()] == ["1"]


@pytest.mark.parametrize("text,want", [
    ("a &amp; b &lt;c&gt; &eacute;&nbsp;&#9731;&#x1F600;", "a & b <c> é\u00a0\u2603\U0001F600"), ("&amp;lt; &#38;gt;", "&lt; &gt;"),
    ("&nosuch; &#0; &#xD800; & &;", "&nosuch; &#0; &#xD800; & &;"), ("plain", "plain"), (None, None),
])
def test_character_references(spark, text, want):
    assert ask(spark, tx.unescape, text) == want


def test_attributes_without_quotes(spark):
    assert ask(spark, h.link_targets, "<a href=/u>x</a><a class=x href='b?x=1&amp;y=2'>y</a><a href = c/d >") == ["/u", "b?x=1&y=2", "c/d"]


@pytest.mark.parametrize("url,site,want", [
    ("http://example.com/a", "http://example.com", True), ("http://www.faz.net/x", "http://www.faz.net/", True), ("http://m.faz.net/x", "http://www.faz.net/", False),
    ("https://www.faz.net/x", "http://faz.net/start", True),
])
def test_pages_of_the_site_itself(spark, url, site, want):
    assert ask(spark, h.is_not_from_subdomain, url, site) is want


@pytest.mark.parametrize("text", [
    "10:27:15 AM Thursday, November 26, 2015", "2015/11/26", "November 26, 2015 11:53 am", "Nov. 26, 2015", "26 November 2015 10:00", "Nov 26, 2015 3:05 p.m.",
])
def test_written_dates_are_read(spark, text):
    assert str(ask(spark, tm.parse_wall_time, text))[:10] == "2015-11-26"


def test_searched_words_are_literal_and_reposts_are_left_out(spark):
    rows = [(1, "C++ is", None), (2, "C is", None), (3, "a.b", None), (4, "axb", None), (5, "c++", "x")]
    df = spark.createDataFrame([(i, t, "en", datetime(2024, 1, 2), r) for i, t, r in rows], "id int, text string, lang string, ts timestamp_ntz, retweeted_status string")
    assert sorted(r.id for r in rel.search_posts(df, ["c++", "a.b"], "en", "2024-01-01", "2024-01-03").collect()) == [1, 3]


def test_site_rules_as_a_long_table(spark):
    linked = "<h1>a</h1>" + "<h2><a href='http://x.e0.com/1'>b</a></h2>" * 4
    rows = [(i, f"http://www.e{i}.com", f"http://www.e{i}.com/p", page(body=linked), "c") for i in range(12)] + [(99, None, "u", page(body=linked), "c")]
    pages = spark.createDataFrame(rows, "id int, site string, url string, html string, source string")
    sites = [{"url": f"http://www.e{i}.com", "overwrite": {"og_type": False, "linked_headlines": f"<={i / 10}"}, "condition": "linked_headlines"} for i in range(1, 12)]
    sites += [{"url": f"http://www.other{i}.com", "overwrite": {"linked_headlines": i}} for i in range(500)]
    sites += [{"url": "http://www.e11.com", "overwrite": {"linked_headlines": "often"}, "condition": "linked_headlines"}]
    got = {r.id: r.is_article for r in art.classify_by_site(pages, sites).collect()}
    assert got == {i: 8 <= i <= 10 for i in [*range(12), 99]}


# -- dates by grammar, nested elements, density -------------------------------------------------------


@pytest.mark.parametrize("text,want", [
    ("26.11.2015", "2015-11-26 00:00:00"), ("11/26/2015 5:03 PM", "2015-11-26 17:03:00"), ("Thu, 26 Nov 2015 07:11:02 EST", "2015-11-26 07:11:02"),
    ("26/11/2015 07:11", "2015-11-26 07:11:00"), ("November 26th, 2015", "2015-11-26 00:00:00"), ("26-Nov-2015", "2015-11-26 00:00:00"),
    ("Nov 26 2015", "2015-11-26 00:00:00"), ("2015-11-26 07:11:02 AM", "2015-11-26 07:11:02"), ("2015-11-26T07:11:02.123+01:00", "2015-11-26 07:11:02"),
    ("20151126T071102", "2015-11-26 07:11:02"), ("201511260711", "2015-11-26 07:11:00"), ("Nov. 26, 2015 at 5 p.m.", "2015-11-26 17:00:00"),
    ("12:30 am, 1 Sept 99", "1999-09-01 00:30:00"), ("05.06.2015", "2015-05-06 00:00:00"), ("2015-26-11", "2015-11-26 00:00:00"),
    ("2015-02-30", None), ("17:03 pm 2015-11-26", None), ("call 12 34 56 now", None), ("5 pm", None), ("March 2015", None), ("31/31/2015", None),
    ("1 2 3 4", None), ("Mayor 5 2015", None), ("x" * 5000, None), ("", None), (None, None),
])
def test_dates_by_grammar(spark, text, want):
    found = ask(spark, tm.parse_wall_time, text)
    assert (None if found is None else str(found)) == want


def plain_nested(page, name):
    """Elements by a scan over the tags with a stack."""
    import re

    opaque = r"<!--.*?(?:-->|\Z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\Z)"
    open_, done = [], []
    for m in re.finditer(rf"(?is){opaque}|</?{name}\b[^>]*>", page):
        if re.match(rf"(?i)<{name}\b", m[0]):
            open_.append((m.start(), m.end()))
        elif re.match(rf"(?i)</{name}\b", m[0]) and open_:
            first = open_.pop()
            done.append((first[0], page[first[1] : m.start()]))
    done += [(a, page[b:]) for a, b in open_]
    return [t for _, t in sorted(done)]


def test_nested_elements_against_a_stack(spark):
    import random

    random.seed(4)
    parts = ["<article>", "<article class='x'>", "</article>", "</ARTICLE >", "one ", "<p>two</p>", "<!-- <article> -->", "<script>'</article>'</script>", " < ", "<articles>", "<style>a</style>", "é\n"]
    pages = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(300)]
    pages += ["<article>one <article>inner</article> two</article>", "<article><!-- </article> -->x</article>", "<!-- open <article>", "", "</article>" * 3]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", h.nested_elements(F.col("html"), "article").alias("v")).collect()
    assert {r.i: r.v for r in rows} == {i: plain_nested(p, "article") for i, p in enumerate(pages)}


def test_comments_and_scripts_hold_no_markup(spark):
    page = ("<head><!-- <title>old</title> --><title>new</title><script>var a = '<a href=\"x\">y</a><h1>no</h1>'</script></head>"
            "<body><!-- <h1>old</h1> <a href='/c'>c</a> --><h1>real</h1><a href='/r'>r</a><!-- <meta property='og:type' content='article'> --></body>")
    assert ask(spark, h.page_title, page) == "new"
    assert ask(spark, lambda c: h.first_element(c, "h1"), page) == "real"
    assert ask(spark, h.link_targets, page) == ["/r"]
    assert ask(spark, h.og_type, page) is False
    assert ask(spark, tx.strip_tags, "a <!-- <b>x</b> --> c<!-- open") == "a  c"
    assert ask(spark, h.longest_article, "<article>one <article>inner</article> two</article>") == "one inner two"


def test_main_text_without_article(spark):
    long = " ".join(f"word{i}" for i in range(45))
    page = (f"<div><ul><li><a href='/a'>Home page</a></li><li><a href='/b'>Sports news</a></li></ul></div><div><h2>Short head</h2><div>{long} <a href='/x'>one link</a></div>"
            f"<div>{long} again</div><!-- <div>{long} hidden</div> --></div><div><a href='/z'>{long}</a></div><footer>All rights reserved</footer>")
    text = ask(spark, h.dense_text, page)
    assert text.split("\n") == ["Short head", f"{long} one link", f"{long} again"]
    assert ask(spark, h.dense_text, "<p>too short</p>") is None and ask(spark, h.dense_text, "") is None and ask(spark, h.dense_text, None) is None


def test_language_of_texts_that_taught_nothing(spark):
    """Held-out accuracy: the model sees a quarter of the documents at most, the others are judged."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL AND length(text) >= 100")
    teach = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    model = lg.language_model(docs.where(teach), "doc_id", "text", "lang", texts=60)
    judged = lg.detect_language(docs.where(~teach), "doc_id", "text", model).join(docs.withColumnRenamed("lang", "truth"), "doc_id").collect()
    right = sum(r.lang == r.truth for r in judged)
    print(f"{right} of {len(judged)}")
    assert len(judged) > 500 and right >= 0.95 * len(judged)


def test_language_model_by_brute_force(spark):
    import math

    rows = [(1, "Aha, das Haus! 12", "de"), (2, "das\nDach", "de"), (3, "the house", "en"), (4, None, "en"), (5, "the moth", None), (6, "", "fr"), (7, "the hat", "en")]
    docs = spark.createDataFrame(rows, "id int, t string, l string")
    runs = lambda t: [w[i:i + 3] for w in [" " + " ".join(re.sub(r"[^a-z]+", " ", t.lower()).split()) + " "] for i in range(len(w) - 2)] if t else []
    counts = {}
    for _, t, l in rows:
        for run in runs(t) if l else []:
            counts[run, l] = counts.get((run, l), 0) + 1
    total = {}
    for (run, _), n in counts.items():
        total[run] = total.get(run, 0) + n
    common = sorted(total, key=lambda run: (-total[run], run))[:9]
    size = {l: sum(n for (run, x), n in counts.items() if x == l and run in common) for l in ("de", "en")}
    want = {(run, l): math.log((counts.get((run, l), 0) + 1) / (size[l] + 9)) for run in common for l in size if size[l]}
    model = lg.language_model(docs, "id", "t", "l", runs=9)
    assert {(r.run, r.lang): r.weight for r in model.collect()} == pytest.approx(want)
    found = {r.id: r.lang for r in lg.detect_language(docs, "id", "t", model).collect()}
    assert found[1] == "de" and found[5] == found[7] == "en" and found[4] is None and found[6] is None
    one = lg.language_model(docs, "id", "t", "l", texts=1)
    assert {r.run for r in one.where("weight > -1e9").collect()} and one.count() < lg.language_model(docs, "id", "t", "l").count()
    nothing = lg.language_model(docs.limit(0), "id", "t", "l")
    assert nothing.count() == 0 and {r.lang for r in lg.detect_language(docs, "id", "t", nothing).collect()} == {None}


def test_language_of_pages_declared_or_found(spark):
    docs = spark.createDataFrame([(1, "das Haus und der Garten", "de"), (2, "the house and the garden", "en")], "id int, t string, l string")
    model = lg.language_model(docs, "id", "t", "l")
    pages = [(1, '<html lang="fr-FR"><body>the house</body></html>'), (2, "<body><p>the house and the</p><article>der Garten und das Haus</article></body>"),
             (3, "<body>the house <script>das Haus und der Garten das Haus</script></body>"), (4, "<html></html>"), (5, None)]
    got = {r.id: r.lang for r in lg.page_language(spark.createDataFrame(pages, "id int, html string"), "id", "html", model).collect()}
    assert got == {1: "fr", 2: "de", 3: "en", 4: None, 5: None}


def test_runs_meet_the_language_model_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "der hund und die katze", "de"), (2, "the dog and the cat", "en")], "id long, t string, l string")
    judged = lg.detect_language(docs, "id", "t", lg.language_model(docs, "id", "t", "l"))
    assert {r.id: r.lang for r in judged.collect()} == {1: "de", 2: "en"}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_page_is_searched_once_for_an_attribute(spark):
    """What is looked into several times, also inside of conditions, is in the plan once."""
    df = spark.createDataFrame([("<meta name='a' content=''>", "<img src=b>")], "x string, y string")
    got = df.select(h.attribute(F.reverse(F.reverse("y")), "src").alias("a"), tx.empty_to_null(F.initcap("x")).alias("b"), h.meta_content(F.col("x"), "name", "a").alias("c"))
    assert got.first().asDict() == {"a": "b", "b": "<meta Name='a' Content=''>", "c": None}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("initcap(") == 1 and plan.count("reverse(") == 2
