"""URL, text, page-extraction, classification and candidate-merge queries."""

from datetime import datetime

from pyspark.sql import functions as F

from pulsewake.functions import html as h
from pulsewake.functions import text as tx
from pulsewake.functions import urls as ur
from pulsewake.operators import articles as art
from pulsewake.operators import candidates as cand
from pulsewake.operators import language as lg
from pulsewake.operators import relational as rel
from pulsewake.plans.inputs import cte, given, table
from pulsewake.plans.registry import query
from pulsewake.plans.storage import archive_file
from pulsewake.runtime import cut_lineage, scratch_path
from pulsewake.sources import archive, sinks


def _read(e: str) -> str:
    """The character references that the pages hold, in SQL."""
    for name, sign in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        e = f"replace({e}, '&{name};', '{sign}')"
    return e


def _bare(e: str) -> str:
    """Text without tags in SQL."""
    stripped = f"regexp_replace({e}, '<[^>]*>', '', 'g')"
    return f"trim({_read(stripped)})"


def _clean(e: str) -> str:
    """The cleaning rules in SQL."""
    return _blank(_bare(e))


def _blank(e: str) -> str:
    for pattern, to in [(r"\n +", "' || chr(10) || '"), (r"^[ \t\n\r\f]*", ""), (r"[ \t]+([ \t])", r"\1"), (r"[ \n]+\n", "' || chr(10) || '"), (r"[ \n]*\z", "")]:
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return e


_DOM = "regexp_replace(regexp_extract(url, '[^/]+\\.[^/]+', 0), '^(www.)', '')"
_REG = f"regexp_extract({_DOM}, '[^/.]+\\.[^/.]+$', 0)"
_URLS = f"""WITH u AS (SELECT page_id, url, {_DOM} AS dom, {_REG} AS reg, string_split(url, '/') AS parts FROM pages),
  w AS (SELECT *, parts[-1] AS last_, list_position(list_transform(parts, lambda p: contains(p, dom)), true) AS at_, CASE WHEN parts[-1] = '' THEN 2 ELSE 1 END AS drop_ FROM u),
  f AS (SELECT *, left(dom, length(dom) - length(reg)) AS sub, array_to_string(CASE WHEN len(parts) - drop_ > at_ THEN parts[at_ + 1 : len(parts) - drop_] ELSE [] END, '_') AS dir,
    CASE WHEN length(regexp_extract(last_, '^(\\.*[^.].*)(\\.[^.]*)$', 2)) BETWEEN 1 AND 9 THEN regexp_extract(last_, '^(\\.*[^.].*)(\\.[^.]*)$', 1) ELSE last_ END AS file FROM w)
"""


# name -> (SQL over the CTE above, function of the address)
_OF_URL = {
    "x18_full_domain": ("dom", ur.full_domain),
    "x19_registrable_domain": ("reg", ur.registrable_domain),
    "x20_subdomain": ("sub", ur.subdomain),
    "x21_start_url": ("'http://' || dom || '/'", ur.start_url),
    "x22_directory_string": ("dir", ur.directory_string),
    "x23_file_name": ("file", ur.file_name),
    "x24_host": ("lower(regexp_extract(url, '://([^/:?#]+)', 1))", ur.host),
    "x25_json_file_name": ("url_encode(url) || '.json'", ur.json_file_name),
    "x26_sha_key": ("sha256(url)", tx.sha_key),
    "x27_md5_when_too_long": (
        "CASE WHEN length(url) <= 40 THEN url ELSE left(url, 7) || '_' || md5(url) END", lambda u: tx.md5_when_too_long(u, 40)
    ),
    "x27_md5_prefix": ("left(md5(url), 12)", lambda u: tx.md5_prefix(u, 12)),
    "x29_path_safe": (
        "regexp_replace(url, '[<>:\"|?*]', '_', 'g')", lambda u: ur.relative_path(ur.path_safe(F.concat(F.lit("./"), u)))
    ),
    "f20_followable_links": (
        "NOT regexp_matches(CASE page_id % 3 WHEN 0 THEN url || '.PDF' WHEN 1 THEN url || 'x.jpeg' ELSE url END, '(?i)[.](pdf|jpe?g|css)$')",
        lambda u: ur.is_followable(F.concat(u, F.get(F.array(F.lit(".PDF"), F.lit("x.jpeg"), F.lit("")), F.col("page_id").cast("int") % 3))),
    ),
}


def _of_url(function):
    return lambda spark, sf: table(spark, sf, "pages").select("page_id", function(F.col("url")).alias("v"))


for _name, (_sql, _function) in _OF_URL.items():
    query(_name, _URLS + f"SELECT page_id, {_sql} AS v FROM f")(_of_url(_function))

_PATH = "%working_path/%time_execution(%Y)/%domain(20)/%appendmd5_full_domain(33)/%md5_subdomains(8)/%url_directory_string(60)_%appendmd5_max_url_file_name.html"


@query("x28_save_path", _URLS + """, p AS (SELECT page_id, './2024/' || left(reg, 20) || '/' || CASE WHEN length(dom) <= 33 THEN dom ELSE left(dom, 0) || '_' || md5(dom) END || '/' || left(md5(sub), 8) || '/' || left(dir, 60) || '_' AS a, file FROM f)
  SELECT page_id, regexp_replace(a || CASE WHEN length(file) <= 259 - 6 - length(a) - 5 THEN file ELSE left(file, 259 - 6 - length(a) - 5 - 33) || '_' || md5(file) END || '.html', '[<>:"|?*]', '_', 'g') AS path FROM p""")
def x28(spark, sf):
    path = ur.save_path(_PATH, F.col("url"), executed=datetime(2024, 1, 2), downloaded=F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), relative_to="/data")
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


# -- scalar text functions ----------------------------------------------------------------------------


@query("x12_cast", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS INT) AS n FROM events")
def x12(spark, sf):
    mixed = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", mixed.try_cast("int").alias("n"))


@query("x13_lower", cte("posts") + "SELECT tweet_id, lower(twitter_handle_name) AS handle FROM posts")
def x13(spark, sf):
    return given(spark, sf, "posts").select("tweet_id", F.lower("twitter_handle_name").alias("handle"))


@query("x14_null_markers", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN event_type END AS v FROM events")
def x14(spark, sf):
    k = F.col("event_id") % 5
    marked = F.when(k == 0, "").when(k == 1, "NULL").when(k == 2, "None").when(k == 3, "[]").otherwise(F.col("event_type"))
    return rel.clean_nulls(table(spark, sf, "events").select("event_id", marked.alias("v")), ["v"])


@query("x15_strip_tags", f"SELECT page_id, md5({_bare('html')}) AS v FROM pages")
def x15(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("v"))


_SPACED = "replace(replace(text, '. ', '.  ' || chr(10) || '  '), ', ', ',' || chr(9) || '  ')"


@query("x16_clean_whitespace", f"SELECT doc_id, md5({_blank(_SPACED)}) AS v FROM documents")
def x16(spark, sf):
    spaced = F.replace(F.replace("text", F.lit(". "), F.lit(".  \n  ")), F.lit(", "), F.lit(",\t  "))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.clean_whitespace(spaced)).alias("v"))


@query("x17_clean_list", f"SELECT doc_id, md5(array_to_string(list_transform(string_split({_SPACED}, '.'), lambda x: {_clean('x')}), '|')) AS v FROM documents")
def x17(spark, sf):
    spaced = F.replace(F.replace("text", F.lit(". "), F.lit(".  \n  ")), F.lit(", "), F.lit(",\t  "))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(tx.clean_list(F.split(spaced, "[.]")), "|")).alias("v"))


@query("x36_word_count", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INT) AS n FROM documents")
def x36(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n"))


@query("x39_language_code", "SELECT doc_id, lang AS code FROM documents")
def x39(spark, sf):
    k = F.col("doc_id") % 4
    tag = F.when(k == 0, F.concat("lang", F.lit("-US"))).when(k == 1, F.concat("lang", F.lit("_DE"))).when(k == 2, F.concat(F.lit("x; "), "lang")).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", tx.language_code(tag).alias("code"))


@query("x34_array_of_structs", """WITH x AS (SELECT user_id, list_sort(list_distinct(list(CAST(regexp_extract(props, '[0-9]+', 0) AS INT)))) AS ks FROM events GROUP BY 1)
  SELECT user_id, CAST(len(ks) AS INT) AS n, array_to_string(list_transform(ks, lambda k: k + 1), ',') AS bumped FROM x""")
def x34(spark, sf):
    """Nested arrays of structs: flatten, sort, distinct, and a field counted up. At most 100 values per row."""
    k = F.get_json_object("props", "$.k").cast("int")
    lists = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(k).alias("ks"))
    nested = lists.select("user_id", F.flatten(F.array(
        F.transform("ks", lambda x: F.struct(x.alias("id"), F.lit(0).alias("distance"))),
        F.transform("ks", lambda x: F.struct(x.alias("id"), F.lit(0).alias("distance"))),
    )).alias("m"))
    sorted_ = nested.select("user_id", F.array_sort(F.array_distinct("m")).alias("m"))
    return sorted_.select("user_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda s: (s["id"] + 1).cast("string")), ",").alias("bumped"))


@query("x35_element_access", "SELECT page_id, string_split(url, '/')[1] AS scheme, string_split(url, '/')[3] AS host FROM pages")
def x35(spark, sf):
    parts = F.split("url", "/")
    return table(spark, sf, "pages").select("page_id", parts[0].alias("scheme"), F.element_at(parts, 3).alias("host"))


@query("x37_charset_decode", "SELECT page_id, md5(html) AS body, true AS valid FROM pages")
def x37(spark, sf):
    """Pages encoded in several charsets, one of them unknown, and decoded again."""
    k = F.col("page_id") % 3
    latin = F.col("html").rlike(r"^[\x00-\xFF]*$")
    charset = F.when((k == 0) & latin, "iso-8859-1").when(k == 1, "utf-8").otherwise("no-such-charset")
    payload = F.when((k == 0) & latin, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    bytes_ = table(spark, sf, "pages").select("page_id", charset.alias("charset"), payload.alias("payload"))
    text = archive.decode_payload(F.col("payload"), F.col("charset"))
    return bytes_.select("page_id", F.md5(text).alias("body"), (archive.is_valid_utf8(F.col("payload")) | (F.col("charset") == "iso-8859-1")).alias("valid"))


@query("x38_json_encode", """SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '"}' AS minimal, CAST(5 AS INT) AS pretty_lines FROM events""")
def x38(spark, sf):
    row = F.struct("event_id", F.col("event_type").alias("kind"))
    pretty = F.to_json(row, {"pretty": "true"})
    return table(spark, sf, "events").select("event_id", F.to_json(row).alias("minimal"), (F.size(F.split(pretty, "\n")) + 1).alias("pretty_lines"))


# -- pages --------------------------------------------------------------------------------------------

_META = cte("rich") + ", m AS (SELECT *, regexp_extract_all(html, '(?is)<meta\\b[^>]*>') AS metas, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>') AS heads FROM rich)\n"
_RICH_DOM = _META + f", x AS (SELECT *, {_REG} AS reg, {_DOM} AS dom FROM m)\n"
_SELF = "list_filter(heads, lambda t: regexp_matches(t, 'href=[\"''][^/]*//([^\"'']*\\.|)' || replace(reg, '.', '\\.') || '[\"''/]'))"
_CHECKS = _RICH_DOM + f""", k AS (SELECT page_id, reg, dom, regexp_matches(html, '<meta [^>]*og:type') AS og_type,
   CASE WHEN len(heads) >= 5 THEN len(list_filter(heads, lambda t: contains(t, 'href'))) / len(heads) END AS linked,
   CASE WHEN len(heads) >= 5 THEN len({_SELF}) / len(heads) END AS own FROM x)
"""


def sites(spark, sf):
    """Pages with the site they belong to and a source kind."""
    return given(spark, sf, "rich").withColumns({
        "site": F.concat(F.lit("http://www."), ur.registrable_domain(F.col("url"))),
        "source": F.when(F.col("page_id") % 2 == 0, F.lit("RssCrawler")).otherwise(F.lit("RecursiveCrawler")),
    })


@query("e01_og_type", _META + "SELECT page_id, len(list_filter(metas, lambda t: contains(t, 'og:type'))) > 0 AS og_type FROM m")
def e01(spark, sf):
    return sites(spark, sf).select("page_id", h.og_type(F.col("html")).alias("og_type"))


@query("e02_meta_keyword", _META + "SELECT page_id, len(list_filter(metas, lambda t: regexp_matches(t, '= ?[\"''][^\"'']*article[^\"'']*[\"'']'))) > 0 AS v FROM m")
def e02(spark, sf):
    return sites(spark, sf).select("page_id", h.meta_contains_article_keyword(F.col("html")).alias("v"))


@query("e03_linked_headlines", _CHECKS + "SELECT page_id, round(linked, 6) AS ratio FROM k")
def e03(spark, sf):
    return sites(spark, sf).select("page_id", F.round(h.linked_headline_ratio(F.col("html")), 6).alias("ratio"))


@query("e04_self_linked_headlines", _CHECKS + "SELECT page_id, round(own, 6) AS ratio FROM k")
def e04(spark, sf):
    return sites(spark, sf).select("page_id", F.round(h.linked_headline_ratio(F.col("html"), 5, F.col("site")), 6).alias("ratio"))


@query("e05_not_from_subdomain", _CHECKS + "SELECT page_id, dom = reg AS v FROM k")
def e05(spark, sf):
    return sites(spark, sf).select("page_id", h.is_not_from_subdomain(F.col("url"), F.col("site")).alias("v"))


@query("e06_article_only_source", "SELECT page_id, page_id % 2 = 0 AS v FROM pages")
def e06(spark, sf):
    return sites(spark, sf).select("page_id", F.col("source").isin(art.ARTICLE_ONLY_SOURCES).alias("v"))


@query("e07_conditions", _CHECKS + "SELECT page_id, coalesce(linked > 0.5, true) AS above, coalesce(linked = 0.4::DOUBLE, true) AS equal, linked IS NULL AS nonsense, NOT og_type AND (coalesce(own <= 0.2, true) OR true) AS combined FROM k")
def e07(spark, sf):
    ratio = h.linked_headline_ratio(F.col("html"))
    checked = art.add_checks(sites(spark, sf), {"og_type": True, "self_linked_headlines": "<=0.2"})
    return checked.select(
        "page_id", art.meets(ratio, ">0.5").alias("above"), art.meets(ratio, "0.4").alias("equal"), art.meets(ratio, "often").alias("nonsense"),
        art.combine("not og_type and (self_linked_headlines or no_such_check)", ["og_type", "self_linked_headlines"]).alias("combined"),
    )


@query("f19_article_classifier", _CHECKS + "SELECT page_id, og_type AND (coalesce(linked <= 0.65, true) OR coalesce(own <= 0.56, true)) AS is_article FROM k")
def f19(spark, sf):
    return art.classify(sites(spark, sf)).select("page_id", "is_article")


@query("j14_site_overrides", _CHECKS + """SELECT page_id, CASE WHEN reg = 'example.com' THEN coalesce(linked <= 0.3, true) WHEN reg = 'example.net' THEN true AND (coalesce(linked <= 0.65, true) OR coalesce(own <= 0.56, true))
  ELSE og_type AND (coalesce(linked <= 0.65, true) OR coalesce(own <= 0.56, true)) END AS is_article FROM k""")
def j14(spark, sf):
    site_list = [
        {"url": "http://www.example.com", "overwrite": {"linked_headlines": "<=0.3"}, "condition": "linked_headlines"},
        {"url": "http://www.example.net", "overwrite": {"og_type": False}},
    ]
    return art.classify_by_site(sites(spark, sf), site_list).select("page_id", "is_article")


@query("e08_publish_date", """SELECT page_id, CASE WHEN page_id % 7 = 2 THEN TIMESTAMP '2016-02-03 04:05:06' WHEN page_id % 7 = 1 THEN TIMESTAMP '2015-11-26 07:11:02'
  WHEN page_id % 7 = 3 THEN TIMESTAMP '2015-11-26' WHEN page_id % 7 = 5 THEN TIMESTAMP '2015-11-24 01:05:00' WHEN page_id % 4 = 0 THEN TIMESTAMP '2017-01-02 03:04:05'
  WHEN page_id % 4 = 2 THEN TIMESTAMP '2018-05-06' WHEN page_id % 3 = 0 THEN TIMESTAMP '2019-07-01' END AS published FROM pages""")
def e08(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://a.example.com/2019/07/01/"), F.col("page_id").cast("string"))).otherwise(F.lit("http://a.example.com/x"))
    return given(spark, sf, "rich").select("page_id", h.publish_date(F.col("html"), url).alias("published"))


@query("e09_language", cte("rich") + "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(html, '<html lang=\"([a-z]+)', 1) WHEN page_id % 7 = 4 THEN 'de' END AS lang FROM rich")
def e09(spark, sf):
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<html lang="), F.lit("<html data=")))
    return given(spark, sf, "rich").select("page_id", h.page_language(html).alias("lang"))


_RUNS = "list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))"


@query("e09_language_by_content", f"""WITH t AS (SELECT doc_id, lang, text IS NOT NULL AS has_text, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
  picked AS (SELECT * FROM t WHERE lang IS NOT NULL AND has_text QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 100),
  c AS (SELECT run, lang, count(*) AS n FROM (SELECT lang, unnest({_RUNS}) AS run FROM picked) GROUP BY 1, 2),
  v AS (SELECT run FROM c GROUP BY 1 ORDER BY sum(n) DESC, run LIMIT 2000), l AS (SELECT lang, sum(n) AS total FROM c JOIN v USING (run) GROUP BY 1),
  w AS (SELECT v.run, l.lang, ln((coalesce(c.n, 0) + 1) / (l.total + (SELECT count(*) FROM v))::DOUBLE) AS weight FROM v CROSS JOIN l LEFT JOIN c ON c.run = v.run AND c.lang = l.lang),
  s AS (SELECT doc_id, w.lang, sum(weight) AS score FROM (SELECT doc_id, unnest({_RUNS}) AS run FROM t) JOIN w USING (run) GROUP BY 1, 2),
  b AS (SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
  SELECT doc_id, b.lang FROM documents LEFT JOIN b USING (doc_id)""")
def e09_content(spark, sf):
    """Every document by a model of 100 labelled texts a language."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = lg.language_model(docs, "doc_id", "text", "lang", texts=100, runs=2000)
    return lg.detect_language(docs, "doc_id", "text", model)


_TITLE = f"trim({_read(chr(39).join(['regexp_extract(html, ', '(?is)<title>(.*?)</title>', ', 1)']))})"


@query("e17_page_item", cte("rich") + f"SELECT page_id, {_TITLE} AS html_title, TIMESTAMP '2024-02-03 04:05:06' AS download_date, {_DOM} AS source_domain FROM rich")
def e17(spark, sf):
    stamp = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")
    return art.page_items(given(spark, sf, "rich"), stamp).select("page_id", "html_title", "download_date", "source_domain")


@query("w07_longest_article", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)) AS a FROM pages),
  t AS (SELECT page_id, trim(regexp_replace({_bare('a')}, '\\s+', ' ', 'g')) AS t FROM a) SELECT page_id, md5(arg_max(t, (length(t), t))) AS v FROM t GROUP BY 1
  UNION ALL SELECT page_id, NULL FROM pages WHERE NOT regexp_matches(html, '(?is)<article\\b[^>]*>(.*?)</article>')""")
def w07(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(h.longest_article(F.col("html"))).alias("v"))


_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"
_LINKS = cte("rich") + f""", h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS raw FROM rich),
  l AS (SELECT page_id, url, {_read('raw')} AS href FROM h)"""
_ABS = f"""CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-z]+:', 0) || href WHEN starts_with(href, '/') THEN {_ROOT} || href
  WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END"""


def page_links(spark, sf):
    pages = given(spark, sf, "rich")
    hrefs = pages.select("page_id", "url", F.explode(h.link_targets(F.col("html"))).alias("href"))
    return hrefs.withColumn("link", ur.absolute_url(F.col("url"), F.col("href")))


@query("x30_absolute_url", _LINKS + f"SELECT page_id, href, {_ABS} AS link FROM l")
def x30(spark, sf):
    return page_links(spark, sf).select("page_id", "href", "link")


@query("x31_link_edges", _LINKS + f"SELECT DISTINCT url AS src, {_ABS} AS dst FROM l WHERE NOT regexp_matches(href, '(?i)[.](pdf|png)$')")
def x31(spark, sf):
    return page_links(spark, sf).where(ur.is_followable(F.col("link"))).select(F.col("url").alias("src"), F.col("link").alias("dst")).distinct()


@query("x32_feed_url", cte("rich") + f"SELECT page_id, page_id % 7 = 4 AS has_feed, CASE WHEN page_id % 7 = 4 THEN {_ROOT} || '/feed.xml' END AS feed FROM rich")
def x32(spark, sf):
    return given(spark, sf, "rich").select("page_id", h.has_feed(F.col("html")).alias("has_feed"), h.feed_url(F.col("html"), F.col("url")).alias("feed"))


@query("x33_sitemap_declared", "SELECT page_id, page_id % 3 = 0 AS v FROM pages")
def x33(spark, sf):
    site = F.concat(F.lit("User-agent: *\nDisallow: /x\n"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Sitemap: "), "url")).otherwise(F.lit("")))
    return table(spark, sf, "pages").select("page_id", h.has_sitemap(site).alias("v"))


# -- candidates ---------------------------------------------------------------------------------------


@query("e10_candidates", cte("rich") + f""", c AS (
  SELECT page_id, 0 AS ord, 'head' AS extractor, {_TITLE} AS title, CASE WHEN page_id % 7 = 3 THEN 'An article about <things>' END AS description, NULL AS body,
         CASE page_id % 7 WHEN 3 THEN '/img/2015/11/26/a.jpg' WHEN 5 THEN 'http://img.example.com/b.png' END AS topimage, CASE WHEN page_id % 7 = 0 THEN 'A. Writer' END AS author FROM rich
  UNION ALL SELECT page_id, 1, 'body', regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), NULL, md5(nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '')), CASE WHEN page_id % 4 = 2 THEN 'pics/1.png' END, NULL FROM rich
  UNION ALL SELECT page_id, 2, 'paragraphs', regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), NULL,
    md5(array_to_string(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: {_bare('p')}), chr(10))), NULL, NULL FROM rich)
  SELECT page_id, CAST(ord AS INT) AS ord, extractor, title, description, body, topimage, author FROM c""")
def e10(spark, sf):
    rows = cand.to_rows(cand.extract(given(spark, sf, "rich"), ["head", "body", "paragraphs"]), "page_id")
    return rows.select("page_id", "ord", "extractor", "title", "description", F.md5("text").alias("body"), "topimage", "author")


_OPAQUE = r"<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)"
_COUNT = lambda e: f"len(list_filter(regexp_split_to_array(regexp_replace({e}, '<[^>]*>', ' ', 'g'), '\\s+'), lambda w: w <> ''))"


@query("e10_density_text", f"""WITH cut AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?is){_OPAQUE}', '', 'g'), '(?i)</?(?:{h.BLOCK_TAGS})\\b[^>]*>') AS parts FROM pages),
  blocks AS (SELECT page_id, unnest(parts) AS x, unnest(range(len(parts))) AS i FROM cut),
  counted AS (SELECT page_id, x, i, {_COUNT('x')} AS n, {_COUNT("array_to_string(regexp_extract_all(x, '(?is)<a\\b[^>]*>(.*?)(?:</a>|\\z)', 1), ' ')")} AS linked FROM blocks),
  shares AS (SELECT page_id, x, i, n, least(linked / n, 1.0) AS s FROM counted WHERE n > 0),
  near AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, coalesce(lag(s) OVER w, 0) AS s0, coalesce(lead(n) OVER w, 0) AS n1 FROM shares WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  main AS (SELECT page_id, string_agg({_clean('x')}, chr(10) ORDER BY i) AS t, count(*) AS k FROM near
           WHERE s <= 0.333333 AND CASE WHEN s0 <= 0.555556 THEN n > 16 OR n1 > 15 OR n0 > 4 ELSE n > 40 OR n1 > 17 END GROUP BY 1)
  SELECT page_id, md5(nullif(t, '')) AS v FROM pages LEFT JOIN main USING (page_id)""")
def e10_density(spark, sf):
    """Main text of every page by the density of words and links, whatever its elements are called."""
    rows = cand.to_rows(cand.extract(table(spark, sf, "pages"), ["density"]), "page_id")
    return rows.select("page_id", F.md5("text").alias("v"))


@query("e11_clean_candidates", cte("rich") + f""", r AS (SELECT page_id, regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) AS t, nullif(regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1), '') AS b FROM rich)
  SELECT page_id, {_clean('t')} AS title, md5({_clean('b')}) AS body FROM r""")
def e11(spark, sf):
    offered = cand.extract(given(spark, sf, "rich"), ["body"])
    cleaned = offered.withColumn("candidates", cand.clean_candidates(F.col("candidates")))
    return cand.to_rows(cleaned, "page_id").select("page_id", "title", F.md5("text").alias("body"))


# documents offered by five extractors that cut, agree and disagree in different ways
_OFFER_INPUT = """
  SELECT doc_id, CAST(k AS INT) AS ord, CASE k WHEN 0 THEN 'head' WHEN 1 THEN 'body' WHEN 2 THEN 'paragraphs' WHEN 3 THEN 'date' ELSE 'other' END AS extractor,
    CASE WHEN (doc_id + k) % 6 = 5 THEN NULL ELSE concat(split_part(text, chr(10), 1), CASE (doc_id * k) % 3 WHEN 0 THEN '' WHEN 1 THEN ' | news' ELSE ' - daily news' END) END AS title,
    CASE WHEN (doc_id * k) % 4 > 1 THEN NULL ELSE source END AS description,
    CASE k WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END WHEN 2 THEN replace(text, chr(10), ' ') WHEN 3 THEN concat(text, ' read more about this on the next page') ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS text,
    CASE WHEN (doc_id + k) % 3 = 0 THEN '/i/' || source || '.png' END AS topimage,
    CASE WHEN (doc_id + k) % 4 = 0 THEN '[]' WHEN (doc_id + k) % 4 = 1 THEN 'A' || CAST(k AS STRING) END AS author,
    CASE WHEN (doc_id + k) % 5 < 2 THEN '2024-01-0' || CAST(k + 1 AS STRING) END AS publish_date,
    CASE (doc_id * (k + 1)) % 5 WHEN 0 THEN 'en' WHEN 1 THEN lang WHEN 2 THEN 'de' WHEN 3 THEN '' END AS language
  FROM {documents} CROSS JOIN {ks}"""
_OFFERS = "WITH ks AS (SELECT unnest([0, 1, 2, 3, 4]) AS k), c AS (" + _OFFER_INPUT.format(documents="documents", ks="ks") + ")\n"


def offers(spark, sf):
    docs = table(spark, sf, "documents").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    text = _OFFER_INPUT.replace(" CROSS JOIN {ks}", "")
    return cand.from_rows(spark.sql(text, documents=docs), "doc_id", "ord")


@query("e12_choose_title", _OFFERS + """, n AS (SELECT doc_id, title, count(*) AS n, length(title) AS len FROM c WHERE title IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT doc_id, arg_max(title, (n, title)) AS most, max(n) AS hi, min(n) AS lo, arg_min(title, (len, title)) AS short FROM n WHERE n > 1 GROUP BY 1),
  s AS (SELECT doc_id, arg_min(title, (len, title)) AS short FROM n GROUP BY 1)
  SELECT d.doc_id, CASE WHEN p.hi <> p.lo THEN p.most WHEN p.doc_id IS NOT NULL THEN p.short ELSE s.short END AS title FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)""")
def e12(spark, sf):
    return offers(spark, sf).select("doc_id", cand.choose_title(F.col("candidates")).alias("title"))


@query("e13_choose_preferred", _OFFERS + """SELECT doc_id, coalesce(max(description) FILTER (extractor = 'head'), arg_min(description, ord) FILTER (description IS NOT NULL)) AS description,
  coalesce(max(author) FILTER (extractor = 'body' AND author <> '[]'), arg_min(author, ord) FILTER (author <> '[]')) AS author,
  'http://h.example.com' || coalesce(max(topimage) FILTER (extractor = 'paragraphs'), arg_min(topimage, ord) FILTER (topimage IS NOT NULL)) AS image FROM c GROUP BY 1""")
def e13(spark, sf):
    c = F.col("candidates")
    return offers(spark, sf).select(
        "doc_id", cand.choose_preferred(c, "description", "head").alias("description"), cand.choose_preferred(c, "author", "body").alias("author"),
        cand.choose_image(c, F.lit("http://h.example.com/a/b.html"), "paragraphs").alias("image"),
    )


@query("e14_choose_date", _OFFERS + "SELECT doc_id, coalesce(max(publish_date) FILTER (extractor = 'date'), arg_min(publish_date, ord) FILTER (publish_date IS NOT NULL)) AS published FROM c GROUP BY 1")
def e14(spark, sf):
    return offers(spark, sf).select("doc_id", cand.choose_preferred(F.col("candidates"), "publish_date", "date").alias("published"))


@query("e15_choose_text", _OFFERS + """, t AS (SELECT doc_id, ord, extractor, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM c WHERE text IS NOT NULL),
  k AS (SELECT doc_id, ord, extractor, text, list_distinct(w) AS w FROM t WHERE len(w) >= 15),
  p AS (SELECT a.doc_id, a.ord AS i, b.ord AS j, a.extractor AS ae, b.extractor AS be, a.text AS ta, b.text AS tb, len(a.w) + len(b.w) - 2 * len(list_intersect(a.w, b.w)) AS apart, len(list_intersect(a.w, b.w)) AS shared FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.ord < b.ord),
  best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN shared = 0 THEN -1e18 ELSE 1 - apart / (2 * shared) END DESC, i, j) = 1),
  one AS (SELECT doc_id, min(text) AS text FROM k GROUP BY 1 HAVING count(*) = 1)
  SELECT d.doc_id, md5(CASE WHEN b.doc_id IS NULL THEN one.text WHEN ae = 'body' THEN ta WHEN be = 'body' THEN tb WHEN length(ta) > length(tb) THEN ta ELSE tb END) AS body
  FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN one USING (doc_id)""")
def e15(spark, sf):
    return offers(spark, sf).select("doc_id", F.md5(cand.choose_text(F.col("candidates"))).alias("body"))


_VOTES = _OFFERS + """, n AS (SELECT doc_id, language, count(*) AS n FROM c WHERE language <> '' GROUP BY 1, 2),
  v AS (SELECT doc_id, arg_max(language, (n, language)) AS most, max(n) AS hi, min(n) AS lo FROM n GROUP BY 1),
  o AS (SELECT doc_id, language AS own FROM c WHERE extractor = 'head' AND language <> '')
  SELECT d.doc_id, CASE WHEN hi = lo AND own IS NOT NULL THEN own ELSE most END AS language FROM documents d LEFT JOIN v USING (doc_id) LEFT JOIN o USING (doc_id)"""


@query("e16_choose_language", _VOTES)
def e16(spark, sf):
    return offers(spark, sf).select("doc_id", cand.choose_language(F.col("candidates")).alias("language"))


@query("a19_majority_vote", "SELECT user_id, arg_max(event_type, (n, event_type)) AS kind FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def a19(spark, sf):
    """Majority over many rows: counted first, so the vote itself sees one row per value."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("kind"))


_H1 = "regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"
_ARTICLE = cte("rich") + f""", a AS (SELECT page_id, url, {_DOM} AS source_domain, {_clean(_H1)} AS title, {_clean("nullif(regexp_extract(html, '(?is)<article.[^>]*>(.*?)</article>', 1), '')").replace('article.[', 'article' + chr(92) + 'b[')} AS body,
   {_clean("array_to_string(list_transform(regexp_extract_all(html, '(?is)<p.[^>]*>(.*?)</p>', 1), lambda p: " + _bare('p') + "), chr(10))").replace('<p.[', '<p' + chr(92) + 'b[')} AS paras FROM rich)
"""


@query("c11_archive_to_articles", _ARTICLE + """, w AS (SELECT *, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS nb, len(list_filter(regexp_split_to_array(paras, '\\s+'), lambda x: x <> '')) AS np FROM a)
  SELECT url, source_domain, nullif(title, '') AS title, md5(CASE WHEN nb >= 15 THEN body WHEN np >= 15 THEN paras END) AS body FROM w
  WHERE contains(url, 'example.net') AND (page_id % 7 NOT IN (2) AND NOT (page_id % 7 NOT IN (1, 2, 3, 5) AND page_id % 4 IN (0, 2)))""")
def c11(spark, sf):
    """Archive files to articles: decode, guard, host, extract, clean, merge, date filter."""
    path = archive_file(spark, sf, given(spark, sf, "rich"))
    pages = archive.decoded_pages(archive.read_archive(spark, path)).withColumnRenamed("http_status", "status")
    usable = rel.usable_response(pages)
    articles = art.articles_from_pages(
        usable, hosts=["example.net"], first="2015-01-01 00:00:00", last="2015-12-31 00:00:00",
        download=F.lit("2024-02-03 04:05:06"),
    )
    return articles.select("url", "source_domain", "title", F.md5("maintext").alias("body"))


_ARCHIVES = ["2023/12/CC-NEWS-20231201000000-1", "2024/01/CC-NEWS-20240101000000-2", "2024/01/CC-NEWS-20240115000000-3", "2024/02/CC-NEWS-20240201000000-4"]


@query("c11_archive_job", """WITH p AS (SELECT ['2024/01/CC-NEWS-20240115000000-3', '2024/02/CC-NEWS-20240201000000-4'][page_id % 4 - 1] AS archive,
    page_id % 7 NOT IN (2) AND NOT (page_id % 7 NOT IN (1, 2, 3, 5) AND page_id % 4 IN (0, 2)) AS ok FROM pages WHERE page_id % 4 > 1)
  SELECT archive, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS discarded, CAST(0 AS BIGINT) AS failed,
    (SELECT count(*) FROM p WHERE ok) AS written FROM p GROUP BY 1""")
def c11_job(spark, sf):
    """The job from end to end: listing by date, ledger of finished archives, pages, articles, counters, one JSON per article."""
    root = scratch_path(spark, "archives")
    for number, name in enumerate(_ARCHIVES):
        archive_file(spark, sf, given(spark, sf, "rich").where(F.col("page_id") % 4 == number), f"{root}/{name}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length > 0").select("path")
    files = files.withColumn("archive", F.regexp_extract("path", r"(\d{4}/\d{2}/CC-NEWS-[^/]*)/[^/]*$", 1))
    listed = archive.archive_files(files.select("archive").distinct(), "2024-01-01 00:00:00", "2024-02-10 00:00:00", "archive")
    done = spark.createDataFrame([(_ARCHIVES[1],)], "archive string")
    todo = files.join(rel.not_yet_done(listed, done, "archive").select("archive"), "archive")
    ledger = cut_lineage(art.page_ledger(archive.records_of(todo), first="2015-01-01 00:00:00", last="2015-12-31 00:00:00"))
    sinks.write_articles_by_domain(art.articles_from_ledger(ledger, F.lit("2024-02-03 04:05:06")), f"{root}-articles")
    results = ledger.withColumn("archive", F.regexp_extract("file", r"(\d{4}/\d{2}/CC-NEWS-[^/]*)/[^/]*$", 1))
    written = spark.read.schema("url string").json(f"{root}-articles").agg(F.count("*").alias("n")).scalar()
    return art.run_counters(results, "archive", "status", "seconds").select("archive", "total", "passed", "discarded", "failed", written.alias("written"))


@query("c03_text_cleaner", f"SELECT page_id, md5({_clean('html')}) AS v FROM pages")
def c03(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean_text(F.col("html"))).alias("v"))


@query("c04_candidate_merge", _ARTICLE + """, w AS (SELECT *, len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) AS nb, len(list_filter(regexp_split_to_array(paras, '\\s+'), lambda x: x <> '')) AS np FROM a)
  SELECT w.page_id, nullif(title, '') AS title, md5(CASE WHEN nb >= 15 THEN body WHEN np >= 15 THEN paras END) AS body,
    CASE WHEN w.page_id % 7 = 3 THEN 'An article about' END AS description, CASE WHEN w.page_id % 7 = 0 THEN 'A. Writer' END AS author,
    regexp_extract(html, '<html lang="([a-z]+)', 1) AS language FROM w JOIN rich USING (page_id)""")
def c04(spark, sf):
    offered = cand.extract(given(spark, sf, "rich"), ["head", "body", "paragraphs"])
    cleaned = offered.withColumn("candidates", cand.clean_candidates(F.col("candidates")))
    return cand.merge(cleaned, "page_id").select("page_id", "title", F.md5("maintext").alias("body"), "description", "author", "language")


# -- extension points ---------------------------------------------------------------------------------


@query("d03_transform_closures", cte("articles") + "SELECT doc_id FROM articles WHERE language = 'en' AND regexp_matches(title, '(?i)the')")
def d03(spark, sf):
    """Operators with parameters chained by ``transform``."""
    return given(spark, sf, "articles").transform(rel.in_languages(["en"])).transform(rel.matches_any("(?i)the", ["title"])).select("doc_id")


@query("d05_extractor_plugin", "SELECT page_id, 'shout' AS extractor, regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) || '!' AS title FROM pages")
def d05(spark, sf):
    """An extractor of the caller's own, registered by name."""
    shout = lambda html, url: cand.candidate("shout", title=F.concat(h.first_element(html, "h1"), F.lit("!")))
    offered = cand.extract(table(spark, sf, "pages"), ["shout"], registry={"shout": shout})
    return cand.to_rows(offered, "page_id").select("page_id", "extractor", "title")


@query("d06_record_filter", cte("rich") + f"SELECT url, {_DOM} AS source_domain FROM rich WHERE page_id % 7 IN (1, 3, 5) AND contains(html, 'pics/1.png')")
def d06(spark, sf):
    """A record filter of the caller's own in front of the extraction."""
    wanted = given(spark, sf, "rich").where(F.contains("html", F.lit("pics/1.png")))
    return art.articles_from_pages(wanted, first="2015-01-01 00:00:00", last="2015-12-31 00:00:00", strict=True).select("url", "source_domain")


@query("d07_check_plugin", cte("rich") + "SELECT page_id, regexp_matches(html, '<meta [^>]*og:type') OR length(html) > 8000 AS is_article FROM rich")
def d07(spark, sf):
    """An article check of the caller's own, used by name in the condition."""
    enabled = {"og_type": True, "long_page": True}
    return art.classify(sites(spark, sf), enabled, "og_type or long_page", extra={"long_page": F.length("html") > 8000}).select("page_id", "is_article")
