"""Merging the candidates that several extractors offer for one page.

A page has as many candidates as there are extractors, a handful, so they travel as one array column
and the merge is a narrow projection: no shuffle, no self join. ``from_rows`` builds that column when the
candidates come as a long table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewake.functions import html as h
from pulsewake.functions.let import let
from pulsewake.functions.text import clean_text, empty_to_null, normalise_null, words
from pulsewake.functions.urls import absolute_url

FIELDS = ["title", "description", "text", "topimage", "author", "publish_date", "language"]

# Fixed value: texts with fewer words are not article texts.
MIN_WORDS = 15


def candidate(extractor: str, **values: Column) -> Column:
    """What one extractor offers; fields it does not know are null."""
    missing = F.lit(None).cast("string")
    return F.struct(F.lit(extractor).alias("extractor"), *[values.get(f, missing).alias(f) for f in FIELDS])


def head_extractor(html: Column, url: Column) -> Column:
    """What the page head says about the article."""
    return let(h.tags(html, "meta"), lambda metas: candidate(
        "head",
        title=h.page_title(html),
        description=F.coalesce(h.content_of(metas, "name", "description"), h.content_of(metas, "property", "og:description")),
        topimage=h.content_of(metas, "property", "og:image"),
        author=h.content_of(metas, "name", "author"),
        language=h.page_language(html),
    ))


def body_extractor(html: Column, url: Column) -> Column:
    """What the article element holds."""
    image = F.get(F.filter(F.transform(h.tags(html, "img"), lambda t: h.attribute(t, "src")), lambda s: s.isNotNull()), F.lit(0))
    return candidate(
        "body",
        title=h.first_element(html, "h1"),
        text=empty_to_null(F.get(h.nested_elements(html, "article"), F.lit(0))),
        topimage=image,
        language=h.page_language(html),
    )


def paragraph_extractor(html: Column, url: Column) -> Column:
    return candidate("paragraphs", title=h.first_element(html, "h1"), text=h.paragraph_text(html))


def date_extractor(html: Column, url: Column) -> Column:
    return candidate("date", publish_date=h.publish_date(html, url).cast("string"))


def density_extractor(html: Column, url: Column) -> Column:
    """The main text of any page, by words and links of its blocks."""
    return candidate("density", title=F.coalesce(h.first_element(html, "h1"), h.page_title(html)), text=h.dense_text(html), language=h.page_language(html))


EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {
    "head": head_extractor,
    "body": body_extractor,
    "paragraphs": paragraph_extractor,
    "date": date_extractor,
    "density": density_extractor,
}


def extract(pages: DataFrame, extractors: Sequence[str] = ("head", "body", "paragraphs", "date"),
            html: str = "html", url: str = "url", registry: dict | None = None) -> DataFrame:
    """Add the ``candidates`` array; ``registry`` adds or replaces extractors by name."""
    known = {**EXTRACTORS, **(registry or {})}
    return pages.withColumn("candidates", F.array(*[known[e](F.col(html), F.col(url)) for e in extractors]))


def from_rows(rows: DataFrame, page: str, order: str) -> DataFrame:
    """Long candidate table to one array per page; its size is the number of extractors."""
    fields = F.struct(F.col(order), "extractor", *FIELDS)
    grouped = rows.groupBy(page).agg(F.array_sort(F.collect_list(fields)).alias("c"))
    return grouped.select(page, F.transform("c", lambda c: F.struct(*[c[f].alias(f) for f in ("extractor", *FIELDS)])).alias("candidates"))


def to_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per candidate."""
    return pages.select(*keep, F.posexplode("candidates").alias("ord", "c")).select(*keep, "ord", "c.*")


def clean_candidates(candidates: Column) -> Column:
    """Tags and blanks out of the text fields; missing fields stay missing."""
    cleaned = {"title", "description", "text", "author", "topimage", "publish_date"}
    return F.transform(candidates, lambda c: F.struct(
        c["extractor"].alias("extractor"), *[(clean_text(c[f]) if f in cleaned else c[f]).alias(f) for f in FIELDS]
    ))


def _offered(candidates: Column, field: str) -> Column:
    return F.filter(candidates, lambda c: c[field].isNotNull())


def _rated(values: Column) -> Column:
    """Each distinct value with the number of times it was offered and its length."""
    return F.transform(F.array_distinct(values), lambda v: F.struct(
        F.size(F.filter(values, lambda x: x == v)).alias("n"), F.length(v).alias("length"), v.alias("v")
    ))


def _by(rated: Column, first: str) -> Column:
    return F.transform(rated, lambda r: F.struct(r[first].alias("by"), r["v"].alias("v")))


def choose_title(candidates: Column) -> Column:
    """Titles offered more than once win, by number of equal pairs; then the shortest; ties by text order."""

    def choose(rated: Column) -> Column:
        paired = F.filter(rated, lambda r: r["n"] > 1)
        most, least = F.array_max(_by(paired, "n")), F.array_min(_by(paired, "n"))
        return (
            F.when(most["by"] != least["by"], most["v"])
            .when(F.size(paired) > 0, F.array_min(_by(paired, "length"))["v"])
            .otherwise(F.array_min(_by(rated, "length"))["v"])
        )

    titles = F.transform(_offered(candidates, "title"), lambda c: c["title"])
    return let(let(titles, _rated), choose)


def choose_text(candidates: Column, preferred: str = "body") -> Column:
    """The pair of texts with the most similar word sets decides.

    Score of a pair: ``1 - |A△B| / (2·|A∩B|)``, minus infinity for disjoint texts. The preferred
    extractor wins when it is in the best pair, else the longer text, the second on a tie.
    """
    split = F.transform(_offered(candidates, "text"), lambda c: F.struct(
        c["extractor"].alias("extractor"), c["text"].alias("text"), words(c["text"]).alias("words")
    ))
    long_enough = F.transform(F.filter(split, lambda c: F.size(c["words"]) >= MIN_WORDS), lambda c: F.struct(
        c["extractor"].alias("extractor"), c["text"].alias("text"), F.array_distinct(c["words"]).alias("words")
    ))

    def score(a: Column, b: Column) -> Column:
        apart = lambda shared: F.size(a["words"]) + F.size(b["words"]) - 2 * shared
        return let(
            F.size(F.array_intersect(a["words"], b["words"])),
            lambda shared: F.when(shared == 0, F.lit(float("-inf"))).otherwise(1 - apart(shared) / (2 * shared)),
        )

    def choose(texts: Column) -> Column:
        pairs = F.flatten(F.transform(texts, lambda a, i: F.transform(
            F.slice(texts, i + 2, F.greatest(F.size(texts) - i - 1, F.lit(0))),
            lambda b, j: F.struct(score(a, b).alias("score"), (-i).alias("i"), (-j).alias("j")),
        )))

        def decide(best: Column) -> Column:
            a = F.get(texts, -best["i"])
            b = F.get(texts, 1 - best["i"] - best["j"])
            own = F.get(F.filter(texts, lambda c: c["extractor"] == preferred), F.lit(0))
            return (
                F.when((a["extractor"] == preferred) | (b["extractor"] == preferred), own["text"])
                .when(F.length(a["text"]) > F.length(b["text"]), a["text"])
                .otherwise(b["text"])
            )

        return F.when(F.size(texts) < 2, F.get(texts, F.lit(0))["text"]).otherwise(let(F.array_max(pairs), decide))

    return let(long_enough, choose)


def choose_language(candidates: Column, preferred: str = "head") -> Column:
    """Majority vote; when all are equally frequent the preferred extractor decides, else the greatest code."""

    def choose(offered: Column) -> Column:
        votes = _by(_rated(F.transform(offered, lambda c: c["language"])), "n")
        most, least = F.array_max(votes), F.array_min(votes)
        # the last candidate of the preferred extractor counts
        own = F.try_element_at(F.filter(offered, lambda c: c["extractor"] == preferred), F.lit(-1))["language"]
        return F.when((most["by"] == least["by"]) & own.isNotNull(), own).otherwise(most["v"])

    offered = F.filter(candidates, lambda c: c["language"].isNotNull() & (c["language"] != ""))
    return let(F.transform(offered, lambda c: F.struct(c["extractor"].alias("extractor"), c["language"].alias("language"))), choose)


def choose_preferred(candidates: Column, field: str, preferred: str) -> Column:
    """The preferred extractor's value, else the first one offered."""
    offered = F.filter(candidates, lambda c: normalise_null(c[field]).isNotNull() if field == "author" else c[field].isNotNull())
    own = F.filter(offered, lambda c: c["extractor"] == preferred)
    return F.coalesce(F.get(own, F.lit(0))[field], F.get(offered, F.lit(0))[field])


def choose_image(candidates: Column, page_url: Column, preferred: str = "head") -> Column:
    return absolute_url(page_url, choose_preferred(candidates, "topimage", preferred))


def merge(pages: DataFrame, *keep: str, url: str = "url") -> DataFrame:
    """Candidates to one article per page."""
    c = F.col("candidates")
    return pages.select(
        *keep,
        choose_title(c).alias("title"),
        choose_preferred(c, "description", "head").alias("description"),
        choose_text(c).alias("maintext"),
        choose_image(c, F.col(url)).alias("image_url"),
        choose_preferred(c, "author", "head").alias("author"),
        choose_preferred(c, "publish_date", "date").alias("date_publish"),
        choose_language(c).alias("language"),
    )
