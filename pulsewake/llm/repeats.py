"""Passages that occur more than once, found by seed and extension.

Seeds are winnowed anchors: of every window of words the run of ``gram`` words with the least fingerprint. Equal
windows have equal anchors, so documents are joined on the anchors that occur more than once, and only around those a
match is extended to both sides: every window that hangs on a repeated anchor gets a fingerprint of all its words, and
the windows found twice are laid together to maximal repeats. All joins and counts are on fingerprints, so a passage
in a third of all documents is counted before the shuffle and never paired with itself.

A document is known by its id and a hash of its text, so ids may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.words import SPACED, Block, blocks, list_column, runs, second

WINDOW = 35
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(better, values: np.ndarray, span: int, fill: np.uint64) -> np.ndarray:
    """``better`` of every ``span`` values from each place on, by doubling; behind the end lies ``fill``."""
    out = np.concatenate((values, np.full(span, fill, dtype=values.dtype)))
    width = 1
    while width * 2 <= span:
        out[:-width] = better(out[:-width], out[width:])
        width *= 2
    if width < span:
        rest = span - width
        out[:-rest] = better(out[:-rest], out[rest:])
    return out[: len(values)]


def _anchors(block: Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: the gram that begins there, the least gram of the window that begins there, whether there is one."""
    n, left = len(block.words), block.left()
    grams = np.full(n, _MOST, dtype=np.uint64)
    if n >= gram:
        found = runs(block.words, gram)
        grams[: len(found)] = found
    grams[left < gram] = _MOST
    least = _sliding(np.minimum, grams, window - gram + 1, _MOST)
    return grams, least, (left >= window) & (least != _MOST)


def _numbered(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row in the block and word number in the text of words of a block."""
    row = np.searchsorted(block.starts, at, side="right") - 1
    return row, at - block.starts[row]


def _spread(block: Block, lists: pa.ListArray) -> np.ndarray:
    """The words of a block that a list of word numbers per row names."""
    rows = lists.slice(block.first, block.last - block.first)
    counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.flatten().to_numpy(zero_copy_only=False) + np.repeat(block.starts[:-1], counts)


def _located(batch: pa.RecordBatch, key: str, block: Block, at: np.ndarray) -> list[pa.Array]:
    row, word = _numbered(block, at)
    take = pa.array(row + block.first)
    return [batch.column(key).take(take), batch.column("__tag").take(take), pa.array(word, pa.int32())]


def _seeds(window: int, gram: int, key: str, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text), SPACED, lower=False):
                grams, least, valid = _anchors(block, window, gram)
                span = window - gram + 1
                used = np.concatenate((np.zeros(span - 1, np.uint64), np.where(valid, least, np.uint64(0))))
                best = _sliding(np.maximum, used, span, np.uint64(0))[: len(grams)]
                at = np.flatnonzero((best == grams) & (grams != _MOST) & (best != 0))
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), *_located(batch, key, block, at)], names=["gram", "id", "tag", "word"])

    return work


def _windows(window: int, gram: int, key: str, text: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text), SPACED, lower=False):
                grams, least, valid = _anchors(block, window, gram)
                seeds = _spread(block, batch.column("__words"))
                hit = np.full(len(grams), _MOST, dtype=np.uint64)
                hit[seeds] = grams[seeds]
                at = np.flatnonzero(valid & (_sliding(np.minimum, hit, window - gram + 1, _MOST) == least))
                one = runs(block.words, window)[at] if len(at) else np.zeros(0, np.uint64)
                two = runs(second(block.words), window)[at] if len(at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), *_located(batch, key, block, at)],
                    names=["one", "two", "id", "tag", "word"])

    return work


def _kept(window: int, size: int, text: int, with_text: bool, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text), SPACED, lower=False):
                n, rows = len(block.counts), batch.slice(block.first, block.last - block.first)
                edge = np.zeros(len(block.words) + window + 1, dtype=np.int64)
                whole = rows.column(size + 1).fill_null(False).to_numpy(zero_copy_only=False) & (block.counts >= window)
                begins = _spread(block, batch.column(size))
                np.add.at(edge, begins, 1)
                np.add.at(edge, begins + window, -1)
                gone = (np.cumsum(edge)[: len(block.words)] > 0) | np.repeat(whole, block.counts)
                removed = np.concatenate(([0], np.cumsum(gone)))[block.starts]
                # maximal repeats: runs of words to be removed, cut at the ends of texts
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                heads = block.starts[:-1][block.counts > 0]
                first[heads] = gone[heads]
                last = gone.copy()
                last[:-1] &= ~gone[1:]
                last[heads[1:] - 1] = gone[heads[1:] - 1]
                row, begin = _numbered(block, np.flatnonzero(first))
                end = _numbered(block, np.flatnonzero(last))[1] + 1
                spans = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["begin", "end"])
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
                texts = _joined(block, ~gone)
                columns = [pa.array(block.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), spans),
                           pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:
                    columns.append(pa.array([bytes(t) for t in texts], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(size)), *columns], names=names)

    return work


def _joined(block: Block, keep: np.ndarray) -> list[memoryview]:
    """The kept words of each text, joined by one blank."""
    begins, ends = block.begins[keep], block.ends[keep]
    data = np.frombuffer(block.buffer, dtype=np.uint8).copy()
    data[ends] = 0x20
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[begins] += 1
    edge[ends + 1] -= 1
    data = memoryview(data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes())
    sizes = np.concatenate(([0], np.cumsum(ends - begins + 1)))
    at = sizes[np.concatenate(([0], np.cumsum(keep)))[block.starts]].tolist()
    return [data[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, gram: int | None = None,
                 with_text: bool = True) -> DataFrame:
    """Words inside any run of ``window`` words that also begins at another place, in the same text or another.

    Words are runs of bytes other than blank and the control characters 9 to 13. Rows keep their columns and get
    ``n_words``, ``n_removed`` (words so covered), ``repeats`` (maximal ranges of such words, end exclusive),
    ``kept_sha256`` of the other words joined by one blank, and these as ``kept_text`` (left out with ``with_text=False``).
    Columns of ``docs`` with these names are replaced.

    All places count, those in repeated rows and rows with null or equal ids as well: a text given twice is removed
    whole if it has a window. Null or empty texts have no words, texts shorter than a window lose nothing, overlapping
    matches inside one text count, and an empty table gives an empty one. ``gram`` is the length of the anchors, at most
    ``window``; it changes the cost, not the result.
    """
    gram = gram or max(1, window // 3)
    if not 1 <= gram <= window:
        raise ValueError("an anchor must fit into the window")
    made = {"n_words": "bigint", "n_removed": "bigint", "repeats": "array<struct<begin:int,end:int>>", "kept_sha256": "string"}
    made |= {"kept_text": "string"} if with_text else {}
    kept = [c for c in docs.columns if c.lower() not in (*made, "kept_text")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    if dict(docs.dtypes)[doc_id] == "bigint":
        key, whole = doc_id, docs
    else:
        key, whole = "__id", docs.withColumn("__id", F.col(f"`{doc_id}`").cast("bigint"))
    # ids that name one row each need no help; then the tag is a constant that takes no room in the shuffles
    ids = whole.groupBy(F.col(f"`{key}`").alias("id")).count()
    helped = not ids.where("count > 1 or id is null").isEmpty()
    whole = whole.withColumn("__tag", F.hash(f"`{text}`") if helped else F.lit(0))
    keyed = whole.select(F.col(f"`{key}`"), "__tag", F.col(f"`{text}`"))
    # all of a text that is there twice is repeated; one copy of it stands for the others below
    prints = keyed.select(F.col(f"`{key}`").alias("id"), F.col("__tag").alias("tag"), F.xxhash64(f"`{text}`").alias("print"), F.hash(f"`{text}`").alias("more"))
    texts = prints.groupBy("print", "more", "tag").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    copied = prints.join(texts.where("copies > 1"), ["print", "more", "tag"], "left_semi").select("id", "tag", F.lit(-1).alias("word"))
    seeds = keyed.mapInArrow(_seeds(window, gram, key, text), "gram bigint, id bigint, tag int, word int")
    shared = seeds.groupBy("gram").count().where("count > 1").select("gram")
    hits = seeds.join(shared, "gram", "left_semi").groupBy("id", "tag").agg(F.collect_set("word").alias("words"))
    first = texts.select("first", F.col("tag").alias("__tag"))
    hits = hits.join(first, hits["id"].eqNullSafe(first["first"]) & (hits["tag"] == first["__tag"]), "left_semi")
    # with all columns, so that this join and the last one take the same rows from one shuffle
    near = _attach(whole, key, hits, "inner")
    found = near.mapInArrow(_windows(window, gram, key, text), "one bigint, two int, id bigint, tag int, word int")
    again = found.groupBy("one", "two").count().where("count > 1").select("one", "two")
    begins = found.join(again, ["one", "two"], "left_semi").select("id", "tag", "word").unionByName(copied)
    begins = begins.groupBy("id", "tag").agg(F.collect_set(F.when(F.col("word") >= 0, F.col("word"))).alias("words"), (F.min("word") < 0).alias("whole"))
    both = _attach(whole, key, begins, "left").select(*[F.col(f"`{c}`") for c in kept], "__words", "__whole")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {k}" for c, k in made.items())])
    return both.mapInArrow(_kept(window, len(kept), kept.index(text), with_text, [*kept, *made]), schema)


def _attach(whole: DataFrame, key: str, lists: DataFrame, how: str) -> DataFrame:
    other = lists.select(*[F.col(c).alias("__list_" + c) for c in lists.columns])
    both = whole.join(other, whole[f"`{key}`"].eqNullSafe(other["__list_id"]) & (whole["__tag"] == other["__list_tag"]), how)
    return both.withColumnsRenamed({"__list_words": "__words", "__list_whole": "__whole"})


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated words; texts that lose none stay as they are, and no row is dropped."""
    held = docs.select(*[F.col(f"`{c}`").alias("_own_" + c) for c in docs.columns])
    found = find_repeats(held, "_own_" + text, "_own_" + doc_id, window)
    return found.select(*[(F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"`_own_{c}`")) if c == text else F.col(f"`_own_{c}`")).alias(c)
                          for c in docs.columns])
