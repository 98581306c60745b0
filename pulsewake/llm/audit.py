"""What each filter of a corpus removes, alone and after the others.

Every filter is a failure condition. Conditions on a text by itself are bits of one narrow pass. "Identical to the text of a
smaller id" is an existential self-join: a left semi join of the rows on hash, exact text and smaller id. Its ids are united
with those of the other failures, and from there on only counts of bit combinations are left: at most
``2 ** filters`` per part, whatever the size of the corpus. All orders of the filters are read off these counts.

The right side of the self-join has one row per hash and text, its least id, combined before the shuffle, so no group of
copies is paired with itself. Texts move only if their hash may occur again: a bitmap of at most ``FILTER_WORDS`` longs, which
is broadcast, keeps the others where they are; when it gets full it lets more of them pass. A hash with more rows than a 4096th
of the corpus is dealt over as many salts as it needs. There are at most 4096 such hashes, so their list is broadcast.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 10_000
HOT_SHARE = 4096
FILTER_WORDS = 1 << 18


def words(text: Column) -> Column:
    """Maximal runs of characters other than blank and the controls 9 to 13."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Failure conditions by filter, each of a text and its words
CONDITIONS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, ws: F.size(ws) < 200,
    "B": lambda text, ws: 100 * F.size(F.array_distinct(ws)) < 50 * F.size(ws),
    "C": lambda text, ws: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
    "D": lambda text, ws: text.rlike(r"[#$%&*|]"),
}
REPEATED = "E"


def _keyed(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return own.withColumn("h", F.xxhash64("text"))


def _repeats(rows: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has as well."""
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    share = F.greatest(F.lit(HOT_ROWS), F.ceil(rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() / HOT_SHARE))
    salted = counts.withColumn("salts", F.ceil(F.col("n") / share))
    hot = salted.where("salts > 1").select("h", "salts")  # fewer than HOT_SHARE rows
    word, bit = F.pmod("h", F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright("h", 48).bitwiseAND(63).cast("int"))
    bitmap = counts.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))  # at most FILTER_WORDS rows
    likely = rows.join(F.broadcast(bitmap), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).drop("word", "bits")
    dealt = likely.join(F.broadcast(hot), "h", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))).drop("salts")
    spread = salted.select("h", "salts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    again = dealt.join(spread, ["h", "salt"])
    least = again.groupBy("h", "text").agg(F.min("id").alias("least"), F.first("salts").alias("salts"))
    least = least.select("h", F.col("text").alias("same"), "least", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    a, b = again.alias("a"), least.alias("b")
    found = (F.col("a.h") == F.col("b.h")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.text") == F.col("b.same")) & (F.col("b.least") < F.col("a.id"))
    return a.join(b, found, "left_semi").select("id", "part", "h")


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source",
             conditions: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """One row per distinct document: ``id``, ``part``, ``mask`` (a bit per failed filter, the repeat's is the highest) and ``n``,
    the number of its rows.

    Null texts are empty, null parts the empty string. A null id has no smaller one and is none. Rows with equal id and
    text are one document that counts ``n`` times; they don't make each other repeats. An empty table gives none.
    """
    conditions = CONDITIONS if conditions is None else conditions
    rows = _keyed(docs, doc_id, text, part)
    split = rows.withColumn("words", words(F.col("text")))
    bits = [F.when(c(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, c in enumerate(conditions.values())]
    mask = bits[0] if bits else F.lit(0)
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    own = split.select("id", "part", "h", mask.alias("mask"), F.lit(1).cast("bigint").alias("n"))
    repeated = _repeats(rows).select("id", "part", "h", F.lit(1 << len(bits)).alias("mask"), F.lit(0).cast("bigint").alias("n"))
    return own.unionByName(repeated).groupBy("id", "part", "h").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n")).drop("h")


def combinations(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of each ``mask`` in each ``part``: ``n`` rows, and of these ``good`` and ``toxic`` ones.

    A document is good (toxic) if any of its labels says so; null ids have no label.
    """
    says = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    known = labels.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = failed.join(known.where("good = 1 OR toxic = 1"), "id", "left")
    among = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), among("good"), among("toxic"))


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """Every order of the ``filters`` (their letters by bit) applied to the counts of :func:`combinations`, step by step.

    One row per ``part``, ``filter_order`` and ``step`` from 1: documents ``kept`` after it, ``removed`` by it, ``redundant`` (fail
    its filter but went before), ``unique_fails`` (fail nothing else), ``good_lost`` and ``toxic_lost`` among the removed, and
    ``shapley``: what its filter removes, summed over all orders. Parts without documents have no rows.
    """
    bit = {letter: 1 << i for i, letter in enumerate(filters)}
    steps = [{"filter_order": "".join(order), "step": i + 1, "gone": sum(bit[x] for x in order[:i]), "own": bit[x]}
             for order in itertools.permutations(filters) for i, x in enumerate(order)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,gone:int,own:int>>")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("combos"))  # at most 2 ** filters
    rows = parts.select("part", "combos", F.inline(listed))
    orders = math.factorial(len(filters))
    gone, own = F.col("gone"), F.col("own")

    def total(value: str, where: Callable[[Column], Column], times: Callable[[Column], Column] = lambda x: F.lit(1)) -> Column:
        chosen = F.filter("combos", lambda x: where(x["mask"]))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda acc, x: acc + x[value] * times(x["mask"]))

    fails = lambda m: m.bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(gone) == 0)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(gone.bitwiseOR(own)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(gone) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in as many orders as any other
        total("n", fails, lambda m: (orders / F.bit_count(m)).cast("bigint")).alias("shapley"),
    )
