"""Benchmark decontamination with suffix arrays over the training texts.

The documents of a task are taken in shards of a few megabytes. Each shard gets a suffix array over its words, and every
suffix of every benchmark text is looked up in it by binary search: the range of suffixes that begin with the same words
holds all places of a match. Nothing but the benchmark moves between machines: a document lies in one shard, so its own
task finds all its matches. The benchmark is indexed in blocks of bounded size, but each worker holds all of them in one pass over
the documents, so it has to fit into memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.words import ALNUM, Block, block_of, blocks, list_column

WINDOW = 10
ITEM_BLOCK_BYTES = 16 << 20

RESULT = "n_words bigint, n_hit bigint, hit_items array<string>, longest_match bigint, hit_spans array<struct<begin:int,end:int>>"


class Queries:
    """The suffixes of a block of benchmark texts.

    Words are numbered by the benchmark's own vocabulary, from 1; every other word and every end of a text is 0, which
    matches nothing.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        block = block_of([text.encode("utf-8") for _, text in items], ALNUM, lower=True)
        self.vocabulary = np.unique(block.words)
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per_key = 63 // self.bits
        self.ids = [i for i, _ in items]
        self.window = window
        codes, self.text_of, place = laid_out(block, self.vocabulary)
        lengths = np.repeat(block.counts, block.counts + 1)
        begin = np.repeat(block.starts[:-1] + np.arange(len(items)), block.counts + 1)
        inside = np.arange(len(codes)) - begin
        # a window begins here: of `window` words, or of the whole text if that is shorter
        self.depth = np.minimum(lengths, window)
        self.at = np.flatnonzero((codes > 0) & (inside + self.depth <= lengths))
        self.rest = (lengths - inside)[self.at]
        self.codes = np.concatenate((codes, np.zeros(self.per_key + int(lengths.max(initial=0)) + 1, dtype=np.int64)))
        self.depth = self.depth[self.at]
        self.longest = int(block.counts.max(initial=0))
        self.keys = packed(self.codes, self.bits, self.per_key)


def laid_out(block: Block, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts with a 0 behind each text, the text of each number, the place of each word."""
    n = len(block.counts)
    text_of = np.repeat(np.arange(n), block.counts + 1)
    place = np.arange(len(block.words)) + np.repeat(np.arange(n), block.counts)
    codes = np.zeros(len(text_of), dtype=np.int64)
    if len(vocabulary):
        found = np.minimum(np.searchsorted(vocabulary, block.words), len(vocabulary) - 1)
        codes[place] = np.where(vocabulary[found] == block.words, found + 1, 0)
    return codes, text_of, place


def packed(codes: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """The next ``per_key`` numbers from each place on in one integer that sorts as they do."""
    n = len(codes) - per_key + 1
    out = np.zeros(n, dtype=np.int64)
    for j in range(per_key):
        out <<= bits
        out |= codes[j : j + n]
    return out


def suffix_array(keys: np.ndarray, codes: np.ndarray, per_key: int, depth: int) -> np.ndarray:
    """Places with a known word, in the order of the words that follow, up to ``depth`` words.

    The first sort goes by the packed words; ties are ranked on by doubling, each round with the ranks of the suffixes
    that lie as many words further on as are already in order.
    """
    places = np.flatnonzero(codes[: len(keys)] > 0)
    order = np.argsort(keys[places])
    suffixes = places[order]
    if per_key >= depth or not len(suffixes):
        return suffixes
    sorted_keys = keys[suffixes]
    heads = np.empty(len(suffixes), dtype=bool)
    heads[0] = True
    heads[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.zeros(len(codes) + 2 * depth + per_key, dtype=np.int64)
    slots = np.arange(len(suffixes))
    rank[suffixes] = np.maximum.accumulate(np.where(heads, slots, 0)) + 1
    covered = per_key
    while covered < depth:
        alone = heads & np.append(heads[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        own = suffixes[tied]
        key = (rank[own] << 31) | rank[own + covered]
        order = np.argsort(key)
        key, own = key[order], own[order]
        suffixes[tied] = own
        first = np.empty(len(tied), dtype=bool)
        first[0] = True
        first[1:] = key[1:] != key[:-1]
        heads[tied] = first
        rank[own] = np.maximum.accumulate(np.where(first, tied, 0)) + 1
        covered *= 2
    return suffixes


def search(keys: np.ndarray, suffixes: np.ndarray, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of the benchmark the range of the suffix array that begins with its window."""
    bits, per = queries.bits, queries.per_key
    low = np.zeros(len(queries.at), dtype=np.int64)
    high = np.full(len(queries.at), len(suffixes), dtype=np.int64)
    for step in range(0, queries.window, per):
        alive = np.flatnonzero((low < high) & (queries.depth > step))
        if not len(alive):
            break
        shift = bits * (per - np.minimum(queries.depth[alive] - step, per))
        wanted = queries.keys[queries.at[alive] + step] >> shift
        begin, end = low[alive], high[alive]
        for right in (False, True):
            a, b = begin.copy(), end.copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                middle = (a + b) >> 1
                there = keys[suffixes[np.minimum(middle, len(suffixes) - 1)] + step] >> shift
                go = (there <= wanted) if right else (there < wanted)
                a = np.where(open_ & go, middle + 1, a)
                b = np.where(open_ & ~go, middle, b)
            (high if right else low)[alive] = a
    return low, high


def shard_matches(block: Block, queries: Queries) -> dict[str, np.ndarray | list]:
    """Hits of one shard: words covered, items and spans of each text."""
    codes, text_of, place = laid_out(block, queries.vocabulary)
    n = len(block.counts)
    depth = max(queries.window, queries.per_key)
    padded = np.concatenate((codes, np.zeros(depth + 2 * queries.per_key, dtype=np.int64)))
    keys = packed(padded, queries.bits, queries.per_key)
    suffixes = suffix_array(keys, padded, queries.per_key, queries.window)
    low, high = search(keys, suffixes, queries)
    count = high - low
    hit = np.flatnonzero(count > 0)
    none = {"n_hit": np.zeros(n, np.int64), "items": np.zeros(0, np.int64), "item_counts": np.zeros(n, np.int64),
            "longest": np.zeros(n, np.int64), "spans": np.zeros((0, 2), np.int64), "span_counts": np.zeros(n, np.int64)}
    if not len(hit):
        return none
    count = count[hit]
    query = np.repeat(hit, count)
    inside = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
    at = suffixes[low[query] + inside]
    # words covered: +1 where a match begins, -1 behind its end
    edge = np.zeros(len(codes) + queries.window + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + queries.depth[query], -1)
    covered = np.cumsum(edge)[: len(codes)] > 0
    none["n_hit"] = np.bincount(text_of[covered], minlength=n)
    # spans as word numbers of their own text
    begin_of = block.starts[:-1] + np.arange(n)
    change = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    none["span_counts"] = np.bincount(text_of[begins], minlength=n)
    none["spans"] = np.stack((begins, ends), axis=1) - begin_of[text_of[begins]][:, None]
    # items of each text
    text, item = text_of[at], queries.text_of[queries.at[query]]
    pairs = np.unique(text * np.int64(len(queries.ids)) + item)
    none["items"] = pairs % len(queries.ids)
    none["item_counts"] = np.bincount(pairs // len(queries.ids), minlength=n)
    # longest: windows that follow each other in the text and in the item are one match
    source = queries.at[query]
    order = np.lexsort((at, source - at))
    a, d, w = at[order], (source - at)[order], queries.depth[query][order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    np.maximum.at(none["longest"], text_of[a], np.arange(len(a)) - head + w)
    return none


def _blocks_of_items(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in blocks of about ``limit`` bytes, each collected by itself."""
    known = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // limit + 1
    for k in range(n):
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield [(r.id, r.text) for r in rows]


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, item_block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """Where documents repeat windows of benchmark texts word for word.

    Words are runs of letters and digits, A-Z in lower case. A window is ``window`` consecutive words of an item, or all
    words of a shorter one. Every row keeps its columns and gets ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``hit_items`` (ids of items with occurring windows as strings, each once, sorted), ``longest_match`` (words of
    the longest verbatim match with one item, 0 without any) and ``hit_spans`` (hit word ranges, end exclusive). Columns
    of ``docs`` with these names are replaced.

    Null or empty texts have no words; items without words have no windows; an item without id marks words but is in
    no list. Items that share an id count once, repeated rows are judged alike, empty tables on either side work.
    """
    made = [part.split()[0] for part in RESULT.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema), RESULT])
    size, place = len(kept), kept.index(text)
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in _blocks_of_items(items, item_id, item_text, item_block_bytes)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Queries(block.value, window) for block in sent]
        for batch in batches:
            for block in blocks(batch.column(place), ALNUM, lower=True):
                rows = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(size)), *_columns(block, own)], names=[*kept, *made])

    return plain.mapInArrow(work, schema)


def _columns(block: Block, own: list[Queries]) -> list[pa.Array]:
    n = len(block.counts)
    found = [shard_matches(block, q) for q in own]
    spans, span_counts = _merged([f["spans"] for f in found], [f["span_counts"] for f in found], n)
    owner = np.repeat(np.arange(n), span_counts)
    n_hit = np.bincount(owner, weights=spans[:, 1] - spans[:, 0], minlength=n).astype(np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    for f, q in zip(found, own):
        for row, item in zip(np.repeat(np.arange(n), f["item_counts"]).tolist(), f["items"].tolist()):
            if q.ids[item] is not None:
                items[row].append(q.ids[item])
    longest = np.max([f["longest"] for f in found], axis=0) if found else np.zeros(n, np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0], pa.int32()), pa.array(spans[:, 1], pa.int32())], names=["begin", "end"])
    ends = np.concatenate(([0], np.cumsum(span_counts))).astype(np.int32)
    return [
        pa.array(block.counts, pa.int64()), pa.array(n_hit, pa.int64()),
        pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
        pa.array(longest, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs),
    ]


def _merged(spans: list[np.ndarray], counts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of the spans of several blocks of items, per text."""
    if len(spans) == 1:
        return spans[0], counts[0]
    if not spans:
        return np.zeros((0, 2), np.int64), np.zeros(n, np.int64)
    owner = np.concatenate([np.repeat(np.arange(n), c) for c in counts])
    both = np.concatenate(spans)
    order = np.lexsort((both[:, 0], owner))
    owner, both = owner[order], both[order]
    # ends never fall behind within a text; a large step between texts keeps them apart
    step = int(both.max(initial=0)) + 2
    begin, end = both[:, 0] + owner * step, np.maximum.accumulate(both[:, 1] + owner * step)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    who = owner[first] if len(first) else owner
    out = np.stack((begin[first] - who * step, end[last] - who * step), axis=1) if len(first) else np.zeros((0, 2), np.int64)
    return out, np.bincount(who, minlength=n)


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the item list in place of lists."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest_match",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents without a hit word, in their own columns. Options as in :func:`find_matches`."""
    found = find_matches(docs.withColumns({"__" + c: F.col(f"`{c}`") for c in docs.columns}), items, "__" + text, **options)
    return found.where("n_hit = 0").select(*[F.col(f"`__{c}`").alias(c) for c in docs.columns])
