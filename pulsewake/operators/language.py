"""Language of a text by its content: naive Bayes over runs of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsewake.functions import html as h
from pulsewake.functions.text import strip_tags
from pulsewake.runtime import cut_lineage


def letter_runs(text: Column) -> Column:
    """Every three characters in a row of the lower-cased words with a blank around each; all but letters is a blank."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit("(?=(.{3}))"), F.lit(1))


def language_model(labelled: DataFrame, row_id: str, text: str, lang: str, texts: int = 1000, runs: int = 3000) -> DataFrame:
    """``(run, lang, weight)``: logarithm of the share of a run among those of a language, one added to each count.

    Fitted on at most ``texts`` labelled texts of each language, those with the lowest md5 of their ``row_id``, and on the ``runs``
    most frequent runs in them (ties: the lesser run). So it has at most ``runs`` rows a language, however large the table.
    Rows without a label or a text teach nothing. It is written down.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # which rows are taken is decided on their ids, texts stay where they are
    by_mark = Window.partitionBy("_lang").orderBy("_mark", "_row")
    marked = known.select(F.col(row_id).alias("_row"), F.col(lang).alias("_lang"), F.md5(F.col(row_id).cast("string")).alias("_mark"))
    picked = marked.distinct().withColumn("_place", F.row_number().over(by_mark)).where(F.col("_place") <= texts)
    taken = known.join(picked, (F.col(row_id) == F.col("_row")) & (F.col(lang) == F.col("_lang")), "left_semi")
    counts = cut_lineage(
        taken.select(F.col(lang).alias("lang"), F.explode(letter_runs(F.col(text))).alias("run")).groupBy("run", "lang").agg(F.count("*").alias("n"))
    )
    common = counts.groupBy("run").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "run").limit(runs).select("run")
    used = cut_lineage(counts.join(common, "run"))
    size = used.agg(F.count_distinct("run")).scalar()
    totals = used.groupBy("lang").agg(F.sum("n").alias("total"))
    # a run that a language does not have counts as met once: every run is stated for every language
    stated = used.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    languages = totals.agg(F.collect_list(F.struct("lang", "total"))).scalar()
    rows = stated.select("run", "by_lang", F.explode(languages).alias("l"))
    met = F.coalesce(F.try_element_at("by_lang", F.col("l.lang")), F.lit(0))
    return cut_lineage(rows.select("run", F.col("l.lang").alias("lang"), F.ln((met + 1) / (F.col("l.total") + size)).alias("weight")))


def detect_language(texts: DataFrame, row_id: str, text: str, model: DataFrame) -> DataFrame:
    """``(row_id, lang)``: the likeliest language, the first in order on a tie; null for a text without any run of the model.

    Runs are looked up in the model and the scores of a text added up in the task that has it, so only a row per text is
    shuffled. The model is sent to every task: it is bounded, but a written table has no size that the planner would know, and all
    runs would be shuffled and sorted to meet it. Texts of one id are judged together.
    """
    languages = sorted(r.lang for r in model.select("lang").distinct().collect())
    if not languages:
        return texts.select(row_id, F.lit(None).cast("string").alias("lang")).distinct()
    wide = model.groupBy("run").agg(*[F.max(F.when(F.col("lang") == name, F.col("weight"))).alias(f"w{i}") for i, name in enumerate(languages)])
    runs = texts.select(row_id, F.explode_outer(letter_runs(F.col(text))).alias("run"))
    sums = [F.sum(f"w{i}").alias(f"w{i}") for i in range(len(languages))]
    scored = runs.join(F.broadcast(cut_lineage(wide)), "run", "left").groupBy(row_id).agg(*sums)
    ranked = F.array(*[F.struct(F.col(f"w{i}").alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("lang")) for i, name in enumerate(languages)])
    best = F.array_max(ranked)
    return scored.select(row_id, F.when(best["score"].isNotNull(), best["lang"]).alias("lang"))


def page_language(pages: DataFrame, row_id: str, html: str, model: DataFrame) -> DataFrame:
    """``(row_id, lang)`` of every page: what it declares, else the language of its longest article, else that of all its text."""
    declared = pages.select(row_id, h.page_language(F.col(html)).alias("declared"), F.col(html).alias("_html"))
    page = F.col("_html")
    silent = declared.where("declared IS NULL").select(row_id, F.coalesce(F.nullif(h.longest_article(page), F.lit("")), strip_tags(h.visible(page))).alias("_text"))
    found = detect_language(silent, row_id, "_text", model).select(F.col(row_id).alias("_row"), F.col("lang").alias("_found"))
    joined = declared.join(found, F.col(row_id) == F.col("_row"), "left")
    return joined.select(row_id, F.coalesce("declared", "_found").alias("lang"))
