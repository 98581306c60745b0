"""Words of many texts at once, as numpy arrays inside one Arrow batch.

A batch is cut into blocks of a few megabytes. In a block the texts lie one after the other, each followed by a
blank, so one pass over the bytes finds the words of all of them. A word is known by a 64-bit fingerprint, a run of
words by a fingerprint of fingerprints. Nulls read as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_LONG_WORD = 64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*separators: tuple[int, int]) -> np.ndarray:
    """Table that is true for bytes of words: all but the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: ``[^\x20\x09-\x0D]``
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, for text in lower case
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over the whole number."""
    x = x ^ (x >> np.uint64(32))
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: the bytes, and the words as begin, end and fingerprint."""

    first: int
    last: int
    buffer: bytes
    offsets: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    starts: np.ndarray  # index of each text's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.starts[1:], self.counts) - np.arange(len(self.words))


def fingerprints(buffer: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte ranges; ``buffer`` goes on for 8 bytes behind the last one."""
    lengths = ends - begins
    eights = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    x = eights[begins] & _MASKS[np.minimum(lengths, 8)]
    out = mix(x + lengths.astype(np.uint64) * _A)
    more = np.flatnonzero(lengths > 8)
    step = 8
    while len(more) and step < _LONG_WORD:
        x = eights[begins[more] + step] & _MASKS[np.minimum(lengths[more] - step, 8)]
        out[more] = mix(out[more] * _A + x)
        step += 8
        more = more[lengths[more] > step]
    for i in more:
        digest = hashlib.blake2b(buffer[begins[i] : ends[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of every ``k`` consecutive words, made of runs of 1, 2, 4, ... words."""
    out, covered, run, width = None, 0, words, 1
    while k:
        if k & 1:
            out = run if out is None else _join(out, run[covered:])
            covered += width
        k >>= 1
        if k:
            run = _join(run, run[width:])
            width *= 2
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    x = a[:n] * _A
    x ^= b[:n]
    x ^= x >> np.uint64(31)
    x *= _B
    x ^= x >> np.uint64(30)
    return x


def second(words: np.ndarray) -> np.ndarray:
    """Other fingerprints of the same words, for runs that must not collide."""
    return mix(words ^ _C)


def text_bytes(column: pa.Array) -> list[bytes | memoryview]:
    """The UTF-8 bytes of a string column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    at = at.tolist()
    return [view[a:b] for a, b in zip(at[:-1], at[1:])]


def blocks(column: pa.Array, table: np.ndarray, lower: bool, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of about ``size`` bytes and find their words. A text is never cut."""
    texts = text_bytes(column)
    first = 0
    while first < len(texts):
        last, total = first, 0
        while last < len(texts) and (last == first or total + len(texts[last]) <= size):
            total += len(texts[last])
            last += 1
        yield block_of(texts[first:last], table, lower, first)
        first = last


def block_of(texts: list, table: np.ndarray, lower: bool, first: int = 0) -> Block:
    buffer = b" ".join(texts) + b" " * 9
    if lower:
        buffer = _LOWER[np.frombuffer(buffer, dtype=np.uint8)].tobytes()
    inside = table[np.frombuffer(buffer, dtype=np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    begins, ends = edges[::2], edges[1::2]
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    starts = np.searchsorted(begins, offsets)
    return Block(first, first + len(texts), buffer, offsets, begins, ends, fingerprints(buffer, begins, ends), starts)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list per row from values laid end to end."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))
