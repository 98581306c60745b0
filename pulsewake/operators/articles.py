"""Corpus building, article-page classification, and the archive-to-article chain."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pulsewake import schemas
from pulsewake.functions import html as h
from pulsewake.functions.text import clean_text, normalise_null
from pulsewake.functions.times import parse_wall_time
from pulsewake.functions.urls import file_name, full_domain
from pulsewake.operators import candidates as cand
from pulsewake.operators import relational as rel
from pulsewake.sources import archive

# Columns that make two articles the same, with and without the authors.
ARTICLE_KEYS = ["authors", "date_publish", "title", "description", "source_domain"]
ARTICLE_KEYS_WITHOUT_AUTHORS = ["date_publish", "title", "description", "source_domain"]

# What articles must mention.
KEYWORDS = "(?i)bitcoin|btc|blockchain|cryptocurrenc(y|ies)|crypto|satoshi"

# Article checks that are on by default and how they combine.
DEFAULT_CHECKS = {"og_type": True, "linked_headlines": "<=0.65", "self_linked_headlines": "<=0.56"}
DEFAULT_CONDITION = "og_type and (linked_headlines or self_linked_headlines)"

# Source kinds that only deliver articles.
ARTICLE_ONLY_SOURCES = ["RssCrawler", "GdeltCrawler", "SitemapCrawler"]


def distinct_articles(df: DataFrame, keys: Sequence[str] = ARTICLE_KEYS, order: Sequence[str] = ("url",)) -> DataFrame:
    return rel.keep_first(df, keys, order)


def build_corpus(df: DataFrame, languages: Sequence[str] = ("en",), keywords: str = KEYWORDS) -> DataFrame:
    """Distinct articles of the wanted languages that mention a keyword, ten columns.

    Of several copies the one with the first address counts, whether or not it passes the filters, so
    the distinct must see every article. It sees no text, though: the first pass reads the key columns
    only and shuffles a digest and an address per article; the second tests the texts, once, and looks
    up the few rows that pass among the first ones.
    """
    keyed = lambda rows: rows.withColumn("_key", F.md5(F.to_json(F.struct(*ARTICLE_KEYS))))
    firsts = keyed(df).groupBy("_key").agg(F.min("url").alias("url"))
    passing = keyed(df.transform(rel.in_languages(languages)).transform(rel.matches_any(keywords)))
    first = firsts.select(F.col("_key").alias("_first_key"), F.col("url").alias("_first_url"))
    same = (F.col("_key") == F.col("_first_key")) & F.col("url").eqNullSafe(F.col("_first_url"))
    kept = passing.select("_key", *schemas.CORPUS_COLUMNS).join(first, same, "left_semi")
    # the same article may be stored twice under one address, and its text may be missing
    return rel.keep_first(kept.withColumn("_text", F.coalesce("maintext", F.lit(""))), ["_key"], ["_text"]).transform(rel.corpus_columns)


def corpus_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Articles before and after the filters."""
    return before.agg(F.count("*").alias("before")).select(
        "before", after.agg(F.count("*").alias("after")).scalar().alias("after")
    )


# -- classification -----------------------------------------------------------------------------------


def default_checks(html: Column, url: Column, site: Column, source: Column, minimum: int = 5) -> dict[str, Column]:
    """All known checks by name. Booleans pass as they are, ratios are compared with a condition."""
    return {
        "og_type": h.og_type(html),
        "meta_contains_article_keyword": h.meta_contains_article_keyword(html),
        "linked_headlines": h.linked_headline_ratio(html, minimum),
        "self_linked_headlines": h.linked_headline_ratio(html, minimum, site),
        "is_not_from_subdomain": h.is_not_from_subdomain(url, site),
        "crawler_contains_only_article_alikes": source.isin(ARTICLE_ONLY_SOURCES),
    }


_BOOLEAN_CHECKS = {
    "og_type", "meta_contains_article_keyword", "is_not_from_subdomain", "crawler_contains_only_article_alikes",
}


def meets(ratio: Column, condition: object) -> Column:
    """Compare a ratio with ``'<=0.65'``, ``'>1'``, ``'=0'``, ``'0.5'`` or a number.

    A null ratio means "not enough to judge" and passes. A condition that does not fit is false.
    """
    if isinstance(condition, bool):
        return F.coalesce(ratio == float(condition), F.lit(True))
    match = re.fullmatch(r"(<=|>=|<|>|=|)\s*([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)", str(condition).strip())
    if not match:
        return ratio.isNull()
    sign, number = match.group(1), float(match.group(2))
    test = {
        "<=": ratio <= number, ">=": ratio >= number, "<": ratio < number, ">": ratio > number,
        "=": ratio == number, "": ratio == number,
    }[sign]
    return F.coalesce(test, F.lit(True))


def text_equals(value: Column, condition: str) -> Column:
    """A quoted condition is compared as text."""
    quoted = re.fullmatch(r"""(['"])(.*)\1""", condition)
    return value == quoted.group(2) if quoted else F.lit(False)


def combine(condition: str, enabled: Sequence[str], prefix: str = "check_") -> Column:
    """``and``/``or``/``not`` and parentheses over check columns; names that are not enabled count as true.

    Only words, blanks and parentheses pass, so the text can be handed to Spark's expression reader once
    every name has become a column name or ``TRUE``.
    """
    if re.sub(r"[\w()\s]", "", condition):
        raise ValueError(f"only names, and, or, not and parentheses are allowed: {condition}")

    def term(match: re.Match) -> str:
        word = match.group(0)
        if word in ("and", "or", "not"):
            return word.upper()
        return f"coalesce(`{prefix}{word}`, FALSE)" if word in enabled else "TRUE"

    return F.expr(re.sub(r"\w+", term, condition))


def add_checks(pages: DataFrame, enabled: Mapping[str, object], html: str = "html", url: str = "url",
               site: str = "site", source: str = "source", extra: Mapping[str, Column] | None = None,
               prefix: str = "check_") -> DataFrame:
    """One boolean column per enabled check. ``extra`` registers further checks by name."""
    known = {**default_checks(F.col(html), F.col(url), F.col(site), F.col(source)), **(extra or {})}
    columns = {}
    for name, wanted in enabled.items():
        passes_as_is = name in _BOOLEAN_CHECKS or name in (extra or {})
        columns[prefix + name] = known[name] if passes_as_is else meets(known[name], wanted)
    return pages.withColumns(columns)


def classify(pages: DataFrame, enabled: Mapping[str, object] = DEFAULT_CHECKS, condition: str = DEFAULT_CONDITION,
             **columns) -> DataFrame:
    """Add ``is_article``."""
    checked = add_checks(pages, enabled, **columns)
    names = [f"check_{n}" for n in enabled]
    return checked.withColumn("is_article", combine(condition, list(enabled))).drop(*names)


def _setting(wanted: object) -> tuple[str, float]:
    """A condition as sign and number; ``?`` where it has another form, which only a null ratio passes."""
    if isinstance(wanted, bool):
        return "=", float(wanted)
    match = re.fullmatch(r"(<=|>=|<|>|=|)\s*([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)", str(wanted).strip())
    return (match.group(1) or "=", float(match.group(2))) if match else ("?", 0.0)


def _passes(ratio: Column, setting: Column) -> Column:
    """:func:`meets` with the condition in a column."""
    sign, number = setting["sign"], setting["number"]
    test = (
        F.when(sign == "<=", ratio <= number).when(sign == ">=", ratio >= number).when(sign == "<", ratio < number)
        .when(sign == ">", ratio > number).when(sign == "=", ratio == number).otherwise(F.lit(False))
    )
    return ratio.isNull() | F.coalesce(test, F.lit(False))


def classify_by_site(pages: DataFrame, sites: Sequence[Mapping], enabled: Mapping[str, object] = DEFAULT_CHECKS,
                     condition: str = DEFAULT_CONDITION, html: str = "html", url: str = "url", site: str = "site", source: str = "source",
                     extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per-site overrides on top of the defaults.

    ``sites`` is the written site list: ``{"url": …, "overwrite": {check: condition or False}, "condition": …}``; of several
    entries for a site the last counts. The list becomes a table that is joined on the site, each check is computed once,
    and only distinct condition texts are in the plan, so the list may be long.
    """
    known = {**default_checks(F.col(html), F.col(url), F.col(site), F.col(source)), **(extra or {})}
    texts: dict[str, int] = {condition: 0}

    def rule(entry: Mapping) -> tuple[int, dict[str, tuple[str, float]]]:
        merged = {n: w for n, w in {**enabled, **entry.get("overwrite", {})}.items() if w is not False}
        return texts.setdefault(entry.get("condition", condition), len(texts)), {n: _setting(w) for n, w in merged.items()}

    rows = {entry["url"]: rule(entry) for entry in sites}
    kind = "_site string, _rule struct<text: int, checks: map<string, struct<sign: string, number: double>>>"
    rules = pages.sparkSession.createDataFrame([*rows.items()], kind)
    usual = F.from_json(F.lit(json.dumps({"text": 0, "checks": {n: dict(zip(("sign", "number"), v)) for n, v in rule({})[1].items()}})),
                        kind.partition("_rule ")[2])
    joined = pages.join(rules, F.col(site) == F.col("_site"), "left").withColumn("_rule", F.coalesce("_rule", usual))
    used = {n for _, checks in [*rows.values(), rule({})] for n in checks}
    columns = {}
    for name in sorted(used):
        setting = F.try_element_at("_rule.checks", F.lit(name))
        as_is = name in _BOOLEAN_CHECKS or name in (extra or {})
        passed = F.coalesce(known[name], F.lit(False)) if as_is else _passes(known[name], setting)
        columns[f"check_{name}"] = F.when(setting.isNull(), F.lit(True)).otherwise(passed)
    decided = F.lit(None).cast("boolean")
    for text, number in texts.items():
        decided = F.when(F.col("_rule.text") == number, combine(text, sorted(used))).otherwise(decided)
    return joined.withColumns(columns).withColumn("is_article", decided).select(*pages.columns, "is_article")


# -- items and articles -------------------------------------------------------------------------------


def page_items(pages: DataFrame, download: Column, url: str = "url", html: str = "html") -> DataFrame:
    """Page title, download stamp and domain, with text null markers removed."""
    return pages.withColumns({
        "html_title": normalise_null(h.page_title(F.col(html))),
        "download_date": download,
        "source_domain": full_domain(F.col(url)),
    })


def articles_from_pages(pages: DataFrame, *, hosts: Sequence[str] | None = None, first: str | None = None,
                        last: str | None = None, strict: bool = False, download: Column | None = None,
                        extractors: Sequence[str] = ("head", "body", "paragraphs", "date")) -> DataFrame:
    """Pages to articles: cheap filters first, then extraction, cleaning, merge, date filter, record form."""
    wanted = pages.transform(rel.from_hosts(hosts)) if hosts else pages
    stamp = F.current_timestamp() if download is None else download
    # the date decides whether a page is kept, so it is found first, once (a generator is not repeated by
    # the filter above it), and only kept pages go through the rest of the extraction
    found = F.explode(F.array(clean_text(h.publish_date(F.col("html"), F.col("url")).cast("string"))))
    items = page_items(wanted, stamp).withColumn("date_found", found)
    return _articles(rel.published_between(items, "date_found", first, last, strict), extractors)


def page_ledger(records: DataFrame, *, hosts: Sequence[str] | None = None, first: str | None = None, last: str | None = None,
                strict: bool = False, errors: str = "strict") -> DataFrame:
    """What becomes of every record of the archives: ``(file, record, url, seconds, status, reason, html, date_found)``.

    One row per response record and one more per damaged file. ``status`` is ``error`` (``reason`` damaged, incomplete), ``discarded``
    (empty, undecodable, response, host, date: the first that applies) or ``passed``, where the reason is null; only
    then is there an ``html``. Nothing is left out, so the counters of a file add up to its records, and an address that lies in
    two files counts in both. Write it down (:func:`pulsewake.runtime.cut_lineage`): the counters and :func:`articles_from_ledger`
    both start from it, so archives are read and decoded once.
    """
    pages = archive.page_records(records, errors)
    html, url = F.col("html"), F.col("url")
    usable = F.coalesce(rel.is_usable_response(F.col("http_status"), html, F.col("content_type")), F.lit(False))
    reason = F.when(F.col("fault").isNotNull(), F.col("fault")).when(~usable, "response")
    if hosts:
        reason = reason.when(~F.coalesce(rel.is_from_hosts(url, hosts), F.lit(False)), "host")
    judged = pages.select("file", "record", "url", "seconds", html, reason.alias("reason"))
    # only pages without a fault are searched for a date, once
    found = F.when(F.col("reason").isNull(), clean_text(h.publish_date(html, url).cast("string")))
    dated = judged.withColumn("date_found", F.explode(F.array(found)))
    inside = rel.is_published_between(parse_wall_time(F.col("date_found")), first, last, strict)
    dated = dated.withColumn("reason", F.coalesce("reason", F.when(~inside, "date")))
    status = F.when(F.col("reason").isNull(), "passed").when(F.col("reason").isin("damaged", "incomplete"), "error").otherwise("discarded")
    passed = F.when(F.col("reason").isNull(), html).alias("html")
    return dated.select("file", "record", "url", "seconds", status.alias("status"), "reason", passed, "date_found")


def articles_from_ledger(ledger: DataFrame, download: Column | None = None,
                         extractors: Sequence[str] = ("head", "body", "paragraphs", "date")) -> DataFrame:
    """The articles of the pages that passed."""
    stamp = F.current_timestamp() if download is None else download
    return _articles(page_items(ledger.where("status = 'passed'"), stamp), extractors)


def _articles(kept: DataFrame, extractors: Sequence[str]) -> DataFrame:
    """Pages with their items and ``date_found`` to articles."""
    registry = {"date": lambda html, url: cand.candidate("date", publish_date=F.col("date_found"))}
    offered = cand.extract(kept, extractors, registry=registry).withColumn("candidates", cand.clean_candidates(F.col("candidates")))
    dated = cand.merge(offered, "url", "download_date", "html_title", "source_domain")
    missing = F.lit(None).cast("string")
    as_items = dated.select(
        F.when(F.col("author").isNotNull(), F.array("author")).alias("article_author"),
        F.col("download_date").cast("string").alias("download_date"),
        F.col("download_date").cast("string").alias("modified_date"),
        F.col("date_publish").alias("article_publish_date"),
        F.col("description").alias("article_description"),
        F.concat(file_name(F.col("url")), F.lit(".json")).alias("filename"),
        F.col("image_url").alias("article_image"),
        F.col("language").alias("article_language"),
        missing.alias("local_path"),
        F.col("title").alias("article_title"),
        F.col("html_title"),
        missing.alias("rss_title"),
        F.col("source_domain"),
        F.col("maintext").alias("article_text"),
        F.col("url"),
    )
    return rel.items_to_articles(as_items)


def run_counters(results: DataFrame, file: str, status: str, seconds: str) -> DataFrame:
    """Per archive file: total, passed, discarded, failed and seconds per article."""
    return results.groupBy(file).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(status) == "passed").alias("passed"),
        F.count_if(F.col(status) == "discarded").alias("discarded"),
        F.count_if(F.col(status) == "error").alias("failed"),
        (F.sum(seconds) / F.count("*")).alias("seconds_per_article"),
    )


def remaining_hours(files: DataFrame, hours: str, done: str) -> DataFrame:
    """Mean hours per finished file times the files that are left."""
    return files.agg(
        F.count("*").alias("files"),
        F.avg(F.when(F.col(done), F.col(hours))).alias("hours_per_file"),
        (F.avg(F.when(F.col(done), F.col(hours))) * F.count_if(~F.col(done))).alias("hours_left"),
    )
