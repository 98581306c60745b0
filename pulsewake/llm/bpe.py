"""Byte-level BPE in linear time: longest matches with backtracking.

The merges of byte-pair encoding give exactly one sequence of tokens in which any two neighbours are what the merges
would leave side by side. So a piece is encoded from left to right with the longest token at each place; a token is
taken if it may follow the one before it, else the next shorter one is tried, and if none fits the token before is
given up. A bit per place remembers dead ends, which bounds the work by the length of the piece.

Two tables make this fast, both filled as they are needed: the next shorter token of a token, and whether two tokens may
stand side by side. The longest tokens come from an Aho-Corasick automaton over the vocabulary, whose bytes are mapped to
the characters of the same numbers (Latin-1), as the automaton works on strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_PIECES = 200_000  # of each of two generations
CACHED_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes, blank, rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Codec:
    """Encoder and decoder for one vocabulary; every single byte must be a token of it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()

    # -- tables -------------------------------------------------------------------------------------------------

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            whole = self.tokens[token]
            parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(parts) > 2:
                made = [(self.ranks.get(self.tokens[a] + self.tokens[b], token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, at = min(made)
                if rank >= token:
                    break
                parts[at : at + 2] = [rank]
            # with more than two parts no merge leads to the token: it only stands for a whole piece
            self.halves[token] = None if len(parts) == 1 else tuple(parts) if len(parts) == 2 else (-1, -1)
        return self.halves[token]

    def _reachable(self, token: int) -> bool:
        return self._halves(token) != (-1, -1)

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a shorter beginning of this one, -1 for a single byte."""
        if token not in self.shorter:
            whole, found = self.tokens[token], -1
            for n in range(len(whole) - 1, 0, -1):
                rank = self.ranks.get(whole[:n])
                if rank is not None and self._reachable(rank):
                    found = rank
                    break
            self.shorter[token] = found
        return self.shorter[token]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges leave these two side by side.

        Undo the merges of both from the last to the first. If at any time the parts that meet would themselves have been
        merged before the merge undone last, the two can't stand together.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, bound, fits = left, right, 1 << 62, True
        while True:
            merged = self.ranks.get(self.tokens[a] + self.tokens[b])
            if merged is not None and merged < bound:
                fits = False
                break
            parts_a, parts_b = self._halves(a), self._halves(b)
            if parts_a is None and parts_b is None:
                break
            if parts_b is None or (parts_a is not None and a > b):
                bound, a = a, parts_a[1]
            else:  # of two equal merges the left one comes first, so the right one is undone first
                bound, b = b + 1, parts_b[0]
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        self.fits[left, right] = fits
        return fits

    # -- encoding -----------------------------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        reach = [0] * size
        for end, (n, rank) in self.automaton.iter(piece.decode("latin-1")):
            begin = end - n + 1
            if n > reach[begin] and self._reachable(rank):
                reach[begin], longest[begin] = n, rank
        open_ends = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + len(self.tokens[token])
                if open_ends[end] and (not out or self._fit(out[-1], token)):
                    break
                token = self._next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                open_ends[at] = 0
                if not out:
                    raise ValueError("no sequence of tokens makes this piece")
                token = out.pop()
                at -= len(self.tokens[token])
        return out

    def _packed(self, piece: str) -> bytes:
        """A piece that is not among the young ones. When these are full the older half goes; what is asked for stays young."""
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= CACHED_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit numbers."""
        known, packed = self.pieces.get, self._packed
        return np.frombuffer(b"".join([known(p) or packed(p) for p in self.pattern.findall(text)]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode whole texts, decode the ids again, and give both.

    Each row keeps its columns and gets ``n_tokens``, ``token_ids`` (left out with ``keep_ids=False``), ``ids_sha256`` of
    the ids as little-endian unsigned 32-bit numbers, and ``decoded_sha256`` of the decoded bytes. A null text counts
    as empty: no tokens. Columns of ``docs`` with one of these names are replaced. Rows are independent: no shuffle,
    repeated rows give repeated results, an empty table gives none. ``path`` must be readable on every executor.
    """
    made = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    if not keep_ids:
        del made["token_ids"]
    kept = [c for c in docs.columns if c.lower() not in made]
    if text not in kept:
        raise ValueError("the text column can't have the name of a result")
    place = kept.index(text)
    size = len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_out, ids_sha, bytes_sha = [], [], [], []
            for value in batch.column(place):
                ids = own.encode(value.as_py() or "")
                counts.append(len(ids))
                if keep_ids:
                    ids_out.append(ids.astype(np.int32))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                bytes_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [pa.array(counts, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            columns += [pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(size)), *columns], names=[*batch.schema.names[:size], *made])

    kinds = {"n_tokens": "bigint", "token_ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema), *(f"{c} {kinds[c]}" for c in made)])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(work, schema)
