"""Text cleaning and small string functions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from pulsewake.functions.let import let

# Texts that stand for "no value".
NULL_MARKERS = ["", "NULL", "None", "[]"]

# The five whitespace rules, in the order in which they apply (pattern, replacement).
WHITESPACE_RULES = [
    (r"\n +", "\n"),
    (r"^[ \t\n\r\f]*", ""),
    (r"[ \t]+([ \t])", "$1"),
    (r"[ \n]+\n", "\n"),
    (r"[ \n]*\z", ""),
]


def normalise_null(text: Column) -> Column:
    return F.when(~text.isin(NULL_MARKERS), text)


def empty_to_null(text: Column) -> Column:
    return let(text, lambda t: F.nullif(t, F.lit("")))


def unescape(text: Column) -> Column:
    """Character references (``&lt;``, ``&eacute;``, ``&#9731;``, ``&#x2603;``) as the characters they stand for.

    Unknown ones stay. The ampersand's own come last, so what they make is not read again.
    """
    pairs = "\x01".join(f"{name}\x02{chr(code)}" for name, code in name2codepoint.items() if name != "amp")
    named = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))  # one literal: a map of 252 keys is a slow plan

    def character(reference: Column) -> Column:
        hexadecimal = F.regexp_extract(reference, "^#[xX]([0-9a-fA-F]{1,6})$", 1)
        decimal = F.regexp_extract(reference, "^#([0-9]{1,7})$", 1)
        code = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.try_element_at(named, reference))

    def replaced(whole: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(whole, F.lit("&(#?[0-9a-zA-Z]{2,31});"), F.lit(1)))
        known = F.filter(F.transform(found, lambda r: F.struct(F.concat(F.lit("&"), r, F.lit(";")).alias("from"), character(r).alias("to"))), lambda p: p["to"].isNotNull())
        plain = F.aggregate(known, whole, lambda done, pair: F.replace(done, pair["from"], pair["to"]))
        return F.regexp_replace(plain, "&(amp|#38|#[xX]26);", "&")

    return let(text, lambda whole: F.when(F.contains(whole, F.lit("&")), replaced(whole)).otherwise(whole))


def strip_tags(text: Column) -> Column:
    """Comments and everything between ``<`` and ``>`` go, character references are read; outer blanks are trimmed."""
    return F.trim(unescape(F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)|<[^>]*>", "")))


def clean_whitespace(text: Column) -> Column:
    for pattern, replacement in WHITESPACE_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_text(text: Column) -> Column:
    return clean_whitespace(strip_tags(text))


def clean_list(texts: Column) -> Column:
    return F.transform(texts, clean_text)


def words(text: Column) -> Column:
    """Words between blanks; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def language_code(tag: Column) -> Column:
    """First two-letter token: ``en-US`` and ``en_US`` give ``en``; null when there is none."""
    return empty_to_null(F.regexp_extract(tag, r"\b([a-zA-Z]{2})(?:[-_]|\b)", 1))


def is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def symmetric_difference(left: Column, right: Column) -> Column:
    return F.concat(F.array_except(left, right), F.array_except(right, left))


def md5_prefix(text: Column, size: int) -> Column:
    return F.substring(F.md5(text), 1, size)


def md5_when_too_long(text: Column, size: Column | int) -> Column:
    """Text cut to ``size`` characters; a cut text ends in ``_`` and its own digest."""
    size = F.lit(size) if isinstance(size, int) else size
    digest = F.md5(text)
    return (
        F.when(F.length(text) <= size, text)
        .when(size > 32, F.concat(F.left(text, size - 33), F.lit("_"), digest))
        .otherwise(F.left(digest, size))
    )


def sha_key(text: Column) -> Column:
    return F.sha2(text, 256)
