"""Facts about a raw page as column expressions.

There is no HTML parser on the JVM side of Spark, so tags are read with regular expressions. The
patterns use no look-around and no back-references. Comments, scripts and styles are opaque: what looks like a tag inside
of them is none. Elements that may lie in one another are matched by their depth.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsewake.functions.let import let
from pulsewake.functions.text import clean_text, empty_to_null, language_code, strip_tags, unescape, words
from pulsewake.functions.times import parse_wall_time
from pulsewake.functions.urls import absolute_url, full_domain, registrable_domain

# Meta tags that carry a publish date, as (attribute, value in lower case).
DATE_META = [
    ("name", "pubdate"),
    ("name", "publishdate"),
    ("name", "timestamp"),
    ("name", "dc.date.issued"),
    ("property", "article:published_time"),
    ("name", "date"),
    ("property", "bt:pubdate"),
    ("name", "sailthru.date"),
    ("name", "article.published"),
    ("name", "published-date"),
    ("name", "article.created"),
    ("name", "article_date_original"),
    ("name", "cxenseparse:recs:publishtime"),
    ("name", "date_published"),
    ("itemprop", "datepublished"),
    ("itemprop", "datecreated"),
    ("http-equiv", "date"),
]

# Meta tags whose image address may carry a date.
IMAGE_META = [("property", "og:image"), ("itemprop", "image")]

# Fixed value: what counts as a date inside an address.
URL_DATE = r"([\./\-_]{0,1}(19|20)\d{2})[\./\-_]{0,1}(([0-3]{0,1}[0-9][\./\-_])|(\w{3,5}[\./\-_]))([0-3]{0,1}[0-9][\./\-]{0,1})?"

# Forms of such a date once its separators are blanks, as (shape, pattern).
URL_DATE_FORMATS = [
    (r"\d{4} \d{1,2} \d{1,2}", "yyyy M d"),
    (r"\d{4} [A-Za-z]{3} \d{1,2}", "yyyy MMM d"),
    (r"\d{4} [A-Za-z]{4,5} \d{1,2}", "yyyy MMMM d"),
    (r"\d{4} \d{1,2}", "yyyy M"),
    (r"\d{4} [A-Za-z]{3}", "yyyy MMM"),
]

# Fixed value: class names that mark a date.
DATE_CLASSES = "pubdate|timestamp|article_date|articledate|date"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute as written, quoted or not; null when the tag has none."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`][^\s"'<>`]*))"""
    value = lambda t: F.concat(*[F.regexp_extract(t, pattern, i) for i in (1, 2, 3)])
    return let(tag, lambda t: F.when(t.rlike(pattern), value(t)))


#: Spans whose content is no markup; an open one reaches to the end of the page.
OPAQUE = r"<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)"


def visible(html: Column) -> Column:
    """The page without its opaque spans."""
    return F.regexp_replace(html, f"(?is){OPAQUE}", "")


def _outside(html: Column, pattern: str) -> Column:
    """All matches that begin outside of opaque spans; ``pattern`` begins with a bracket and then a letter."""
    found = F.regexp_extract_all(html, F.lit(f"(?is){OPAQUE}|({pattern})"), F.lit(1))
    return F.filter(found, lambda m: m != "")


def tags(html: Column, name: str) -> Column:
    """All opening tags of one element."""
    return _outside(html, rf"<{name}\b[^>]*>")


def element_texts(html: Column, name: str) -> Column:
    """Inner markup of every ``<name>…</name>`` of an element that can't lie in itself."""
    whole = _outside(html, rf"<{name}\b[^>]*>.*?</{name}>")
    return F.transform(whole, lambda w: F.regexp_extract(w, rf"(?is)^<{name}\b[^>]*>(.*)</{name}>$", 1))


def first_element(html: Column, name: str) -> Column:
    return empty_to_null(F.get(element_texts(html, name), F.lit(0)))


def nested_elements(html: Column, name: str) -> Column:
    """Inner markup of every ``<name>…</name>``, also of those inside another one, in the order of their opening tags.

    The page is cut into its tags of that name, opaque spans and what lies between. A fold over the tags keeps the places of
    those that are open; a closing tag ends the last of them. Closing tags without an open one are passed over, elements
    that are not closed go on to the end of the page.
    """
    pieces = F.regexp_extract_all(html, F.lit(rf"(?is){OPAQUE}|</?{name}\b[^>]*>|<|[^<]+"), F.lit(0))
    return let(pieces, lambda found: _spans(found, name))


def _spans(pieces: Column, name: str) -> Column:
    turn = lambda x: F.when(x.rlike(rf"(?i)^<{name}\b"), 1).when(x.rlike(rf"(?i)^</{name}\b"), -1).otherwise(0)
    marks = F.filter(F.transform(pieces, lambda x, i: F.struct(turn(x).alias("turn"), i.alias("at"))), lambda m: m["turn"] != 0)
    span = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(state: Column, mark: Column) -> Column:
        opened, done = state["open"], state["done"]
        ended = F.struct(F.slice(opened, 1, F.size(opened) - 1).alias("open"), F.array_append(done, span(F.element_at(opened, -1), mark["at"])).alias("done"))
        return (F.when(mark["turn"] == 1, F.struct(F.array_append(opened, mark["at"]).alias("open"), done.alias("done")))
                .when(F.size(opened) > 0, ended).otherwise(state))

    def finish(state: Column) -> Column:
        return F.array_sort(F.concat(state["done"], F.transform(state["open"], lambda first: span(first, F.size(pieces)))))

    spans = F.aggregate(marks, start, step, finish)
    return F.transform(spans, lambda e: F.array_join(F.slice(pieces, e["first"] + 2, e["last"] - e["first"] - 1), ""))


def meta_content(html: Column, attr: str, value: str) -> Column:
    """``content`` of the first meta tag whose ``attr`` equals ``value``."""
    return content_of(tags(html, "meta"), attr, value)


def content_of(metas: Column, attr: str, value: str) -> Column:
    """:func:`meta_content` from the meta tags of a page, for those who ask for several."""
    hits = F.filter(metas, lambda t: F.lower(attribute(t, attr)) == value)
    return unescape(empty_to_null(attribute(F.get(hits, F.lit(0)), "content")))


def page_title(html: Column) -> Column:
    return F.trim(unescape(first_element(html, "title")))


# -- article checks -----------------------------------------------------------------------------------


def og_type(html: Column) -> Column:
    """A meta tag declares the page to be an article."""
    return F.exists(tags(html, "meta"), lambda t: F.coalesce((attribute(t, "property") == "og:type") & (attribute(t, "content") == "article"), F.lit(False)))


def attribute_values(tag: Column) -> Column:
    """The quoted values of a tag."""
    return F.regexp_extract_all(tag, F.lit(r"""(?s)=\s*("[^"]*"|'[^']*')"""), F.lit(1))


def meta_contains_article_keyword(html: Column) -> Column:
    """A meta tag has a value with the word in it."""
    return F.exists(tags(html, "meta"), lambda t: F.exists(attribute_values(t), lambda v: F.contains(v, F.lit("article"))))


def headlines(html: Column) -> Column:
    """Every h1 … h6 element with its markup."""
    return _outside(html, r"<h[1-6]\b[^>]*>.*?</h[1-6]>")


def linked_headline_ratio(html: Column, minimum: int = 5, site_url: Column | None = None) -> Column:
    """Share of headlines that hold a link, or a link to the site itself when ``site_url`` is given.

    Null stands for "too few headlines to judge", which passes any condition.
    """
    found = headlines(html)
    if site_url is None:
        linked = F.filter(found, lambda h: F.contains(h, F.lit("href")))
    else:
        own = registrable_domain(site_url)
        linked = F.filter(found, lambda h: F.exists(link_targets(h), lambda target: target.contains("//") & (registrable_domain(target) == own)))
    return F.when(F.size(found) >= minimum, F.size(linked) / F.size(found))


def is_not_from_subdomain(url: Column, site_url: Column) -> Column:
    """The page lies on the very domain of its site, ``www.`` or not, whatever path the site's address has."""
    return full_domain(url) == full_domain(site_url)


# -- links --------------------------------------------------------------------------------------------


def link_targets(html: Column) -> Column:
    return F.filter(F.transform(tags(html, "a"), lambda t: unescape(attribute(t, "href"))), lambda h: h.isNotNull())


def feed_url(html: Column, page_url: Column) -> Column:
    """Address of the first feed link, null when the page has none."""
    feeds = F.filter(tags(html, "link"), lambda t: F.contains(attribute(t, "type"), F.lit("application/rss+xml")))
    return absolute_url(page_url, attribute(F.get(feeds, F.lit(0)), "href"))


def has_feed(html: Column) -> Column:
    return F.exists(
        tags(html, "link"), lambda t: F.contains(F.coalesce(attribute(t, "type"), F.lit("")), F.lit("application/rss+xml"))
    )


def has_sitemap(robots: Column) -> Column:
    return F.contains(robots, F.lit("Sitemap:"))


# -- language -----------------------------------------------------------------------------------------


def page_language(html: Column) -> Column:
    """html@lang, xml:lang, meta language, og:locale; the first that is there, as a two-letter code."""
    root = F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0)
    return language_code(
        F.coalesce(
            let(root, lambda t: F.coalesce(attribute(t, "lang"), attribute(t, "xml:lang"))),
            meta_content(html, "name", "language"),
            meta_content(html, "property", "og:locale"),
        )
    )


# -- publish date -------------------------------------------------------------------------------------


def date_in_url(url: Column) -> Column:
    """Date written into an address; a missing day counts as the first of the month."""
    found = F.regexp_extract(url, URL_DATE, 0)
    plain = F.initcap(F.trim(F.regexp_replace(found, r"[./_-]+", " ")))

    def read(t: Column) -> Column:
        tries = [F.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(form))) for shape, form in URL_DATE_FORMATS]
        return F.coalesce(*tries).cast("timestamp_ntz")

    return let(plain, read)


def date_in_json(html: Column) -> Column:
    """Linked-data block: ``dateCreated`` overrides ``datePublished``."""
    block = F.regexp_extract(
        html, r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>""", 1
    )
    return parse_wall_time(let(block, lambda b: F.coalesce(F.get_json_object(b, "$.dateCreated"), F.get_json_object(b, "$.datePublished"))))


def _is_meta(tag: Column, choices: list[tuple[str, str]]) -> Column:
    by_attribute: dict[str, list[str]] = {}
    for attr, value in choices:
        by_attribute.setdefault(attr, []).append(value)
    checks = [F.coalesce(F.lower(attribute(tag, a)).isin(v), F.lit(False)) for a, v in by_attribute.items()]
    hit = checks[0]
    for check in checks[1:]:
        hit = hit | check
    return hit


def date_in_meta(html: Column) -> Column:
    """The first meta tag, in document order, that is known to carry a date decides."""

    def candidate(tag: Column) -> Column:
        content = F.trim(attribute(tag, "content"))
        image_date = date_in_url(content)
        return (
            F.when(_is_meta(tag, DATE_META), content)
            .when(_is_meta(tag, IMAGE_META), F.date_format(image_date, "yyyy-MM-dd HH:mm:ss"))
        )

    found = F.filter(F.transform(tags(html, "meta"), candidate), lambda c: c.isNotNull())
    return parse_wall_time(F.get(found, F.lit(0)))


def date_in_tags(html: Column) -> Column:
    """``<time>``, then a dated span, then the first element of a date class that can be read."""
    times = _outside(html, r"<time\b[^>]*>[^<]*")

    def time_value(tag: Column) -> Column:
        first_class = F.lower(F.regexp_extract(attribute(tag, "class"), r"^\s*(\S+)", 1))
        text = F.regexp_extract(tag, ">([^<]*)$", 1)
        return F.coalesce(empty_to_null(attribute(tag, "datetime")), F.when(first_class == "timestamp", text))

    decided = F.get(F.filter(F.transform(times, time_value), lambda v: v.isNotNull()), F.lit(0))
    spans = _outside(html, r"<span\b[^>]*>[^<]*")
    dated = F.get(F.filter(spans, lambda t: attribute(t, "itemprop") == "datePublished"), F.lit(0))
    span_value = F.coalesce(attribute(dated, "content"), F.regexp_extract(dated, ">([^<]*)$", 1))
    marked = F.regexp_extract_all(
        html, F.lit(rf"""(?is)<(?:span|p|div)\b[^>]*class\s*=\s*["'][^"']*(?:{DATE_CLASSES})[^"']*["'][^>]*>([^<]*)"""), F.lit(1)
    )
    readable = F.get(F.filter(F.transform(marked, parse_wall_time), lambda d: d.isNotNull()), F.lit(0))
    return (
        F.when(decided.isNotNull(), parse_wall_time(decided))
        .when(dated.isNotNull(), parse_wall_time(span_value))
        .otherwise(readable)
    )


def publish_date(html: Column, url: Column) -> Column:
    """Linked data, then meta tags, then markup, then the address."""
    return F.coalesce(date_in_json(html), date_in_meta(html), date_in_tags(html), date_in_url(url))


# -- text ---------------------------------------------------------------------------------------------


def longest_article(html: Column) -> Column:
    """Text of the longest ``<article>``, blanks collapsed; the first in text order on a tie."""
    texts = F.transform(
        nested_elements(html, "article"), lambda a: F.trim(F.regexp_replace(unescape(F.regexp_replace(visible(a), "<[^>]*>", "")), r"\s+", " "))
    )
    best = F.array_max(F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return best["t"]


def paragraph_text(html: Column) -> Column:
    """Text of all paragraphs, one per line."""
    return F.array_join(F.transform(element_texts(html, "p"), strip_tags), "\n")


# -- text by density ----------------------------------------------------------------------------------

# Fixed value: elements that end one block of text and begin another.
BLOCK_TAGS = ("address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|"
              "option|p|pre|section|select|table|tbody|td|textarea|tfoot|th|thead|title|tr|ul")


def text_blocks(html: Column) -> Column:
    """What lies between block elements, as ``markup``, number of ``words`` and share of them that is ``linked``; blocks without
    words are left out."""
    cut = F.split(visible(html), rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>")
    bare = lambda x: F.size(words(F.regexp_replace(x, "<[^>]*>", " ")))
    links = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"(?is)<a\b[^>]*>(.*?)(?:</a>|\z)"), F.lit(1)), " ")
    counted = F.transform(cut, lambda x: F.struct(x.alias("markup"), bare(x).alias("words"), bare(links(x)).alias("linked")))
    some = F.filter(counted, lambda b: b["words"] > 0)
    return F.transform(some, lambda b: F.struct(b["markup"].alias("markup"), b["words"].alias("words"), F.least(b["linked"] / b["words"], F.lit(1.0)).alias("linked")))


def is_main_text(block: Column, before: Column, after: Column) -> Column:
    """Decision tree of Kohlschuetter, Fankhauser and Nejdl (2010) over a block and its neighbours: words and share of links."""
    n = lambda b: F.coalesce(b["words"], F.lit(0))
    linked = lambda b: F.coalesce(b["linked"], F.lit(0.0))
    after_text = (n(block) > 16) | (n(after) > 15) | (n(before) > 4)
    after_links = (n(block) > 40) | (n(after) > 17)
    return (linked(block) <= 0.333333) & F.when(linked(before) <= 0.555556, after_text).otherwise(after_links)


def dense_text(html: Column) -> Column:
    """Text of the blocks that are main text, one per line; null when there is none. It needs no ``<article>``."""

    def chosen(blocks: Column) -> Column:
        judged = F.transform(blocks, lambda b, i: F.struct(b["markup"].alias("markup"), is_main_text(b, F.get(blocks, i - 1), F.get(blocks, i + 1)).alias("main")))
        return F.array_join(F.transform(F.filter(judged, lambda b: b["main"]), lambda b: clean_text(b["markup"])), "\n")

    return empty_to_null(let(text_blocks(html), chosen))
