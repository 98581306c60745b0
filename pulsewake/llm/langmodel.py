"""Language-model scores by stupid backoff, every document under the counts of all others.

The counts are a relation by hash of the n-gram, cut into buckets of hash space; the n-grams of the texts are exploded and
joined to it by the same hash. To keep rows few, n-grams travel packed: texts are dealt into blocks, a block sends each
bucket one sorted list of its distinct n-grams with their local counts, the bucket adds up what all blocks sent and
answers each with the totals, and the block sums the logarithms of each document. A frequent n-gram is one entry for
each block, however many documents have it, and hash values spread evenly, so no bucket gets hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.words import SPACED, Block, block_of, blocks, mix, runs, text_bytes

BACKOFF = 0.4
ORDER = 2
UNSEEN = 0.5  # what a word counts that no other document has
BLOCK_BYTES = 8 << 20
BUCKET_WORDS = 1 << 20


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of equal weight, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _unpack(packed: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _entries(block: Block, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``order``, fingerprints of the n-grams that stay in a text, and their last words."""
    words = mix(block.words)
    inside = np.arange(len(words)) - np.repeat(block.starts[:-1], block.counts)
    out = [(words, np.arange(len(words)))]
    for n in range(2, order + 1):
        last = np.flatnonzero(inside >= n - 1)
        out.append((mix(runs(words, n)[last - n + 1] + np.uint64(n)) if len(last) else words[:0], last))
    return out


def _sent(bits: int, order: int):
    """A block's distinct n-grams and their counts, one row for each bucket that has any."""
    def work(table: pa.Table) -> pa.Table:
        block = block_of(text_bytes(table.column("text")), SPACED, lower=True)
        entries, counts = np.unique(np.concatenate([prints for prints, _ in _entries(block, order)]), return_counts=True)
        bucket = (entries >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(entries), np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        parts = [p for p in zip(np.split(entries, cuts), np.split(counts, cuts), np.split(bucket, cuts)) if len(p[0])]
        number = table.column("block")[0].as_py()
        return pa.table({
            "block": pa.array([number] * len(parts), pa.int64()), "bucket": pa.array([int(b[0]) for _, _, b in parts], pa.int64()),
            "entries": pa.array([_pack(np.diff(e, prepend=np.uint64(0))) for e, _, _ in parts], pa.binary()),
            "counts": pa.array([_pack(c.astype(np.uint32)) for _, c, _ in parts], pa.binary())})

    return work


def _answered(table: pa.Table) -> pa.Table:
    """The totals of a bucket, for each block in the order it asked."""
    asked = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("entries")]
    counts = [_unpack(x.as_py(), np.uint32) for x in table.column("counts")]
    known, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(known)).astype(np.uint64)[place]
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "totals": pa.array([_pack(t) for t in np.split(totals, cuts)], pa.binary())})


def log_scores(block: Block, totals: np.ndarray, n_all: int, backoff: float = BACKOFF, order: int = ORDER) -> np.ndarray:
    """The sum of the logarithms for each text; ``totals`` of the sorted distinct entries of the block."""
    n = len(block.counts)
    grams = _entries(block, order)
    entries = np.unique(np.concatenate([prints for prints, _ in grams]))
    text_of = np.repeat(np.arange(n), block.counts)

    def others(prints: np.ndarray, texts: np.ndarray) -> np.ndarray:
        place = np.searchsorted(entries, prints)
        _, back, own = np.unique(texts * np.int64(max(1, len(entries))) + place, return_inverse=True, return_counts=True)
        return totals[place] - own[back]

    context = others(grams[0][0], text_of)
    rest = np.maximum(n_all - block.counts, 1).astype(float)[text_of]
    score = np.log(np.maximum(context, UNSEEN) / rest)
    # what each length finds takes the place of what the shorter ones found
    for prints, last in grams[1:]:
        own = np.zeros(len(score), dtype=np.int64)
        own[last] = others(prints, text_of[last])
        score[last] += np.log(backoff)
        at = np.flatnonzero(own > 0)
        score[at] = np.log(own[at] / context[at - 1])
        context = own
    return np.bincount(text_of, weights=score, minlength=n).astype(float)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(0), SPACED, lower=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(block.offsets[-1])]), pa.array([len(block.words)])], names=["bytes", "words"])


def backoff_scores(docs: DataFrame, text: str = "text", backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS,
                   order: int = ORDER) -> DataFrame:
    """``docs`` with ``n_words``, ``log_score`` (sum of natural logarithms) and ``score`` (their mean).

    Words are runs of bytes other than blank and controls 9 to 13, A-Z in lower case. With the counts of all other rows, a
    word scores the share of its n-gram of ``order`` words among the occurrences of the words before it; if no other row has the
    n-gram, ``backoff`` times its score by the next shorter one, down to its own share of all words. The first words of a text
    begin with the longest n-gram that fits. A word no other row has counts as half an occurrence.

    Null texts and texts without words have 0 words, a null score and log_score 0. Repeated rows are other rows to each
    other. An empty table gives an empty one. Columns of ``docs`` with these names are replaced. Rows are dealt into blocks
    by their place in the input, so ``docs`` should come from files or a checkpoint.
    """
    made = {"n_words": "bigint", "log_score": "double", "score": "double"}
    kept = [c for c in docs.columns if c.lower() not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    sizes = docs.select(F.col(f"`{text}`")).mapInArrow(_measured, "bytes bigint, words bigint").agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    if order < 1:
        raise ValueError("order is at least 1")
    n_bytes, n_words = sizes["bytes"] or 0, sizes["words"] or 0
    n_blocks = n_bytes // block_bytes + 1
    bits = max(0, (order * n_words // bucket_words).bit_length())
    dealt = docs.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))
    sent = dealt.groupBy("__block").applyInArrow(_renamed(_sent(bits, order), text), "block bigint, bucket bigint, entries binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(_answered, "block bigint, bucket bigint, totals binary")

    def summed(rows: pa.Table, lists: pa.Table) -> pa.Table:
        block = block_of(text_bytes(rows.column(text)), SPACED, lower=True)
        by_bucket = np.argsort(lists.column("bucket").to_numpy())
        totals = [_unpack(lists.column("totals")[int(i)].as_py(), np.uint64).astype(np.int64) for i in by_bucket]
        sums = log_scores(block, np.concatenate(totals) if totals else np.zeros(0, np.int64), n_words, backoff, order)
        own = rows.select(kept)
        own = own.append_column("n_words", pa.array(block.counts, pa.int64())).append_column("log_score", pa.array(sums))
        with np.errstate(invalid="ignore", divide="ignore"):
            return own.append_column("score", pa.array(sums / block.counts, mask=block.counts == 0))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {k}" for c, k in made.items())])
    return dealt.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(summed, schema)


def _renamed(work, text: str):
    def call(table: pa.Table) -> pa.Table:
        return work(pa.table({"text": table.column(text), "block": table.column("__block")}))

    return call
