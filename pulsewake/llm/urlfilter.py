"""Allowing and blocking addresses: rules first, then a list of canonical addresses.

The list may be long. A blocked Bloom filter of it, whose size is bounded whatever the list's, goes to all tasks and passes
the few addresses that may be listed; only these are shuffled to an exact join with the list, which removes the filter's
false hits. A longer list makes the filter less selective, never wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed address, and the most bytes it may have
BITS_EACH = 16
FILTER_BYTES = 8 << 20
WORDS = 8  # of 32 bits in a block: an address sets one bit in each word of its block
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling of an address: host without ``www.``, path without a slash at the end, parameters in order.

    Protocol, fragment, and the parameters ``ref`` and ``utm_...`` are left out. Null for null and for what has no ``://``.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~p.startswith("ref=")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    plain = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/\z", ""), tail)
    return F.when(F.contains(url, F.lit("://")), plain)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, beginning of the path) that fits, as a struct of verdict and text; null if none.

    A rule fits its host and all hosts below it.
    """
    fits = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
               F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def _place(address: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(blocks)).cast("int")


def _bits(address: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.pmod(F.hash(address, F.lit(word)), F.lit(32)).cast("int"))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """A row for each filled block of the filter: ``block`` and its words."""
    return listed.groupBy(_place(F.col("listed"), blocks).alias("block")).agg(*[F.bit_or(_bits(F.col("listed"), i)).alias(f"w{i}") for i in range(WORDS)])


def blocks_for(addresses: int, filter_bytes: int = FILTER_BYTES) -> int:
    """Number of blocks: as many as the list asks for, up to the bound."""
    block_bytes = WORDS * 4
    return max(1, min(filter_bytes // block_bytes, addresses * BITS_EACH // (8 * block_bytes) + 1))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``canonical``, ``rule`` and ``verdict`` (allow or block).

    ``listed`` has one column of canonical addresses; repeats and nulls there count for nothing. A rule decides before the
    list; without one, listed addresses are blocked and all others allowed. A null address, or one without ``://``, has
    empty host and path and is allowed. Columns of ``pages`` with these names are replaced; repeated rows are judged
    alike; empty tables work.
    """
    made = ("host", "path", "canonical", "rule", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]
    address = F.col(f"`{url}`").cast("string")
    rows = pages.select(*kept, host_of(address).alias("host"), path_of(address).alias("path"), canonical(address).alias("canonical"))
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    names = listed.select(F.col(listed.columns[0]).alias("listed")).where("listed is not null").distinct()
    blocks = blocks_for(names.count(), filter_bytes)
    # at most `blocks` rows of 9 numbers: the filter's bound is the broadcast's
    sieve = F.broadcast(bloom_filter(names, blocks).withColumnsRenamed({"block": "__block", **{f"w{i}": f"__w{i}" for i in range(WORDS)}}))
    tested = rows.join(sieve, _place(F.col("canonical"), blocks) == F.col("__block"), "left")
    may = F.col("__rule").isNull() & F.col("canonical").isNotNull() & F.col("__block").isNotNull()
    for i in range(WORDS):
        may = may & (F.col(f"__w{i}").bitwiseAND(_bits(F.col("canonical"), i)) != 0)
    may = F.coalesce(may, F.lit(False))
    marked = tested.select(*rows.columns, may.alias("__may"))
    through = marked.where("__may").join(names, F.col("canonical") == F.col("listed"), "left")
    through = through.select(*rows.columns, F.col("listed").isNotNull().alias("__listed"))
    both = marked.where("not __may").select(*rows.columns, F.lit(False).alias("__listed")).unionByName(through)
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__listed"), "block").otherwise("allow"))
    return both.select(*kept, "host", "path", "canonical", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))


def repeated_addresses(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical addresses that more than one row has."""
    return pages.select(canonical(F.col(f"`{url}`").cast("string")).alias("listed")).where("listed is not null").groupBy("listed").count().where("count > 1").select("listed")
