"""Repair of conversations: the cheapest edits that bring turns into order, by a run-length dynamic program.

The rows of a conversation, in order, are symbols: the initial of the role with the fault of the row. A repaired conversation
is empty, or an optional system turn and then pairs of user and assistant. Four states say what may come next, so one row
is a 4 x 4 matrix of least costs (min-plus), inserts before it included. Equal neighbours collapse into a run; a run of n rows
is advanced by the binary powers of its matrix, which are made once and kept. Costs to go run from the back; then the choices
are unrolled from the front, at each place the least letter that keeps the least cost.

A conversation may hold a third of all rows. Its rows are dealt by sampled ranges of conversation and order and cut into
segments of at most a few thousand; a segment is condensed to its runs and one matrix. Only these matrices are followed along
a conversation. Each segment is then unrolled by itself, for each state that may enter it. The texts move once, to be
streamed in order through the digest of the repaired conversation: a chained hash can't be had in parts, but no task
holds more of a conversation than its edit letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsewake.llm.components import written

SEGMENT = 4096
INF = 1 << 50
STATES = range(4)  # nothing yet, after the system, after a user, after an assistant
AFTER = (2, 2, 3, 2)  # where the turn goes that a state asks for: a user, but an assistant after a user
TO_END = (0, 6, 3, 0)  # inserts that a state needs at the end
CLASSES = "sua"
FOLLOWS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by class of initial: where a kept row leads
LEGAL = {(0, 1), (1, 2), (2, 1)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
GONE = 8  # symbol of a row that must be deleted; the others are 2 * class + truncated

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# -- the program --------------------------------------------------------------------------------------------------


def compose(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


UNIT: Matrix = tuple(tuple(0 if i == j else INF for j in STATES) for i in STATES)


def _inserts() -> Matrix:
    out = []
    for q in STATES:
        row, at = [INF] * 4, q
        for n in range(4):
            row[at] = min(row[at], INSERT * n)
            at = AFTER[at]
        out.append(tuple(row))
    return tuple(out)


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: letter, cost, next state; in the order of letters, inserts apart."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        kind, extra = symbol // 2, TRUNCATED * (symbol % 2)
        if state in FOLLOWS[kind]:
            out.append(("K", extra, FOLLOWS[kind][state]))
        out.append(("R", REROLE + extra, AFTER[state]))
    return out


@lru_cache(None)
def power(symbol: int, k: int) -> Matrix:
    """Least costs over ``2 ** k`` rows of the symbol."""
    if k:
        half = power(symbol, k - 1)
        return compose(half, half)
    row = []
    for q in STATES:
        to = [INF] * 4
        for _, cost, then in choices(symbol, q):
            to[then] = min(to[then], cost)
        row.append(tuple(to))
    return compose(_inserts(), tuple(row))


def over_run(symbol: int, n: int, v: Vector) -> Vector:
    """Costs to go before a run, from those behind it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = apply(power(symbol, k), v)
    return v


@lru_cache(1 << 14)
def run_matrix(symbol: int, n: int) -> Matrix:
    out = UNIT
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = compose(out, power(symbol, k))
    return out


def condense(runs: tuple[tuple[int, int], ...]) -> Matrix:
    out = UNIT
    for symbol, n in runs:
        out = compose(out, run_matrix(symbol, n))
    return out


def _unroll_run(symbol: int, n: int, state: int, v: Vector, out: list[str]) -> int:
    if n > 32:
        k = (n - 1).bit_length() - 1
        state = _unroll_run(symbol, n - (1 << k), state, apply(power(symbol, k), v), out)
        return _unroll_run(symbol, 1 << k, state, v, out)
    costs = [v]
    for _ in range(n):
        costs.append(apply(power(symbol, 0), costs[-1]))
    for left in range(n, 0, -1):
        here, behind = costs[left], costs[left - 1]
        while True:
            letters = [(x, then) for x, cost, then in choices(symbol, state) if cost + behind[then] == here[state]]
            if here[AFTER[state]] + INSERT == here[state] and (not letters or letters[0][0] > "I"):
                out.append("I")
                state = AFTER[state]
                continue
            out.append(letters[0][0])
            state = letters[0][1]
            break
    return state


@lru_cache(1 << 14)
def unroll(runs: tuple[tuple[int, int], ...], state: int, ends: Vector) -> tuple[str, int]:
    """Letters of the cheapest edits of the runs, the least of equal ones, and the state behind; ``ends`` are the costs to
    go behind the last run."""
    behind = [ends]
    for symbol, n in reversed(runs):
        behind.append(over_run(symbol, n, behind[-1]))
    out: list[str] = []
    for (symbol, n), v in zip(runs, reversed(behind[:-1])):
        state = _unroll_run(symbol, n, state, v, out)
    return "".join(out), state


# -- segments -----------------------------------------------------------------------------------------------------

_SEGMENT = [("seg", pa.int64()), ("codes", pa.binary()), ("digests", pa.binary()),
            ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())]
_SEGMENT_SQL = "seg bigint, codes binary, digests binary, low bigint, high bigint, turns bigint"


def _segments(size: int):
    """Sorted rows ``conv, turn, code, digest`` to segments of one conversation, numbered in the order of the sort."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [n]))
            begins = np.concatenate([np.arange(a, b, size) for a, b in zip(cuts[:-1], cuts[1:])])
            ends = np.concatenate((begins[1:], [n]))
            turn = batch.column(1)
            timed = ~turn.is_null().to_numpy(zero_copy_only=False)
            turns = turn.fill_null(0).to_numpy()
            codes = batch.column(2).to_numpy().astype(np.uint8).tobytes()
            digests = b"".join(batch.column(3).to_pylist())
            own = []
            for a, b in zip(begins.tolist(), ends.tolist()):
                known = turns[a:b][timed[a:b]]
                low, high = (int(known[0]), int(known[-1])) if len(known) else (None, None)
                own.append((number, codes[a:b], digests[16 * a : 16 * b], low, high, len(np.unique(known))))
                number += 1
            columns = [pa.array(c, k) for c, (_, k) in zip(zip(*own), _SEGMENT)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(begins)), *columns], names=["conv", *(x for x, _ in _SEGMENT)])

    return work


def _parts(codes: bytes, digests: bytes) -> list[bytes]:
    """The digests of rows that are not blank; of a blank one None."""
    return [None if c & 4 else digests[16 * i : 16 * i + 16] for i, c in enumerate(codes)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [sorted({d for d in _parts(c, ds) if d is not None}) for c, ds in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        counts = np.array([len(x) for x in own], dtype=np.int64)
        at = pa.array(np.repeat(np.arange(len(own)), counts))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([d for x in own for d in x], pa.binary())], names=["conv", "seg", "digest"])


def _condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the digests that they hold first (``own``) to counts of faults, runs and matrix."""
    for batch in batches:
        out = []
        for codes, digests, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            new, symbols, blank, double, cut, illegal = set(own or ()), [], 0, 0, 0, 0
            before = None
            for code, digest in zip(codes, _parts(codes, digests)):
                kind = code & 3
                if digest is None:
                    blank += 1
                    symbols.append(GONE)
                elif digest not in new:
                    double += 1
                    symbols.append(GONE)
                else:
                    new.discard(digest)
                    cut += code >> 3 & 1
                    symbols.append(2 * kind + (code >> 3 & 1))
                illegal += before is not None and (before, kind) not in LEGAL
                before = kind
            runs = run_lengths(symbols)
            flat = [x for run in runs for x in run]
            out.append((blank, double, cut, illegal, codes[0] & 3, codes[-1] & 3, flat, [x for row in condense(runs) for x in row]))
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns],
                                         names=["conv", "seg", "blank", "duplicate", "truncated", "illegal", "head", "tail", "runs", "matrix"])


def run_lengths(symbols: list[int]) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return tuple((s, n) for s, n in out)


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of whole conversations, last ones first, to the costs to go behind each; ``first`` marks the first one."""
    pending: tuple | None = None
    conv, v = None, TO_END
    for batch in batches:
        out = []
        for c, seg, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            same = pending is not None and c == conv
            if pending is not None:
                out.append((*pending, not same))
            if not same:
                conv, v = c, TO_END
            pending = (seg, list(v))
            v = apply(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), v)
        yield _behind(out)
    if pending is not None:
        yield _behind([(*pending, True)])


def _behind(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.bool_()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
    return pa.RecordBatch.from_arrays(columns, names=["seg", "ends", "first"])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``seg, runs, ends, first`` to the letters and the state behind, for each state that may come in, and the least cost."""
    for batch in batches:
        out = []
        for flat, ends, first in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            runs = tuple(zip(flat[::2], flat[1::2]))
            least = min(ends)
            found = [unroll(runs, q, tuple(x - least for x in ends)) for q in ((0,) if first else STATES)]
            cost = apply(condense(runs), tuple(ends))[0] if first else 0
            out.append(([x for x, _ in found], [q for _, q in found], cost))
        kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["seg", "audits", "exits", "cost"])


# -- whole conversations ------------------------------------------------------------------------------------------


class _Conversation:
    """Follows one conversation: first its segments, then its rows."""

    def __init__(self, conv):
        self.conv = conv
        self.low = self.high = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.state, self.letters = 0, []
        self.audit: str | None = None
        self.at, self.place, self.role_state = 0, 0, 0
        self.digest = hashlib.sha256()

    def segment(self, x: dict) -> None:
        if x["low"] is not None:
            self.turns += x["turns"] - (self.high == x["low"])
            self.low = x["low"] if self.low is None else self.low
            self.high = x["high"]
        for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
            setattr(self, c, getattr(self, c) + x[c])
        self.illegal += self.tail is not None and (self.tail, x["head"]) not in LEGAL
        self.tail = x["tail"]
        self.letters.append(x["audits"][self.state])
        self.state = x["exits"][self.state]

    def _emit(self, edit: str, turn, role: str, text: str) -> tuple:
        self.digest.update((("\n" if self.place else "") + role + ":" + text).encode("utf-8"))
        self.place += 1
        return self.conv, self.place, edit, turn, role, text

    def _asked(self) -> str:
        role = "assistant" if self.role_state == 2 else "user"
        self.role_state = AFTER[self.role_state]
        return role

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._emit("I", None, self._asked(), "")

    def row(self, turn, role: str, text: str) -> Iterator[tuple]:
        if self.audit is None:
            self.close()
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.role_state = FOLLOWS[kind_of(role)][self.role_state]
            yield self._emit("K", turn, role, text)
        elif edit == "R":
            yield self._emit("R", turn, self._asked(), text)

    def close(self) -> None:
        self.audit = "".join(self.letters) + "I" * (TO_END[self.state] // INSERT)
        self.letters = []

    def end(self) -> Iterator[tuple]:
        if self.audit is None:
            self.close()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.digest.hexdigest())


def kind_of(role: str) -> int:
    at = CLASSES.find(role[:1])
    return at if role and at >= 0 else 3


_SEGMENT_FIELDS = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "head", "tail", "audits", "exits"]


def _followed(turns: bool, schema: pa.Schema):
    """Rows sorted by conversation and kind: 0 begins one, 1 is a segment, 2 a row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []

        def finish() -> None:
            left = list(now.end())
            out.extend(left if turns else [now.summary()])

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            conv, kind, segment, turn, role, text = (batch.column(i) for i in range(6))
            for i, k in enumerate(kind.to_pylist()):
                if k == 0:
                    if now is not None:
                        finish()
                    now = _Conversation(conv[i].as_py())
                elif k == 1:
                    now.segment(segment[i].as_py())
                else:
                    for x in now.row(turn[i].as_py(), role[i].as_py(), text[i].as_py()):
                        if turns:
                            out.append(x)
                if len(out) >= 4096:
                    yield made()
                    out.clear()
        if now is not None:
            finish()
        yield made()

    return work


def _prepared(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    own = rows.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
                      F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    # the digest stands for role and text: equal ones are repeats, and it settles the order of equal turns
    return own.withColumn("digest", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))))


def _analysed(own: DataFrame, size: int) -> DataFrame:
    """One row per segment, with its letters by state coming in."""
    conv = own.schema["conv"].dataType.simpleString()
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    kind = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(CLASSES)], F.lit(3))
    code = kind + F.when(blank, 4).otherwise(0) + F.when(cut, 8).otherwise(0)
    keys = own.select("conv", "turn", "role", "digest", code.cast("int").alias("code"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = written(dealt.select("conv", "turn", "code", "digest").mapInArrow(_segments(size), f"conv {conv}, {_SEGMENT_SQL}"), "segments")
    seen = segments.select("conv", "seg", "codes", "digests").mapInArrow(_distinct, f"conv {conv}, seg bigint, digest binary")
    first = seen.groupBy("conv", "digest").agg(F.min("seg").alias("seg")).groupBy("seg").agg(F.collect_list("digest").alias("own"))  # at most ``size``
    joined = segments.join(first, "seg", "left").select("conv", "seg", "codes", "digests", "own")
    faults = joined.mapInArrow(_condensed, f"conv {conv}, seg bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                               "head int, tail int, runs array<int>, matrix array<bigint>")
    faults = written(faults.join(segments.select("seg", "low", "high", "turns"), "seg"), "condensed")
    along = faults.select("conv", "seg", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    behind = along.mapInArrow(_costs_behind, "seg bigint, ends array<bigint>, first boolean")
    letters = faults.select("seg", "runs").join(behind, "seg").mapInArrow(_unrolled, "seg bigint, audits array<string>, exits array<int>, cost bigint")
    return faults.drop("runs", "matrix").join(letters, "seg")


def _follow(rows: DataFrame, names: tuple[str, str, str, str], turns: bool, size: int, ids: DataFrame | None = None) -> DataFrame:
    own = _prepared(rows, *names)
    segments = _analysed(own, size).select("conv", F.lit(1).alias("kind"), "seg", F.struct(*_SEGMENT_FIELDS).alias("segment"))
    every = own.select("conv") if ids is None else own.select("conv").unionByName(ids.select(F.col(f"`{names[0]}`").alias("conv")))
    begins = every.distinct().withColumn("kind", F.lit(0))
    texts = own.withColumn("kind", F.lit(2))
    union = segments.unionByName(begins, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    order = ["conv", "kind", "seg", F.col("turn").asc_nulls_first(), "role", "digest"]
    sorted_rows = union.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "segment", "turn", "role", "text")
    spark_schema = f"conv {own.schema['conv'].dataType.simpleString()}, " + (
        "place bigint, edit string, turn bigint, role string, text string" if turns else
        "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")
    schema = to_arrow_schema(StructType.fromDDL(spark_schema))
    return sorted_rows.mapInArrow(_followed(turns, schema), spark_schema).withColumnRenamed("conv", names[0])


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in, by a checksum of conversation and turn: a row in twenty is dropped, emptied, without
    its stops, given twice, or said by the user. Nulls count as one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def audit(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", ids: DataFrame | None = None,
          segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: faults, least cost, the letters of its edits and the digest of its repaired turns.

    ``gaps`` are turns missing between the least and the largest one. Of each row the first fault counts: ``blank`` (nothing but
    blanks), ``duplicate`` (role and text seen before), ``truncated`` (doesn't end in ``.``, ``!`` or ``?``). ``illegal`` counts neighbours that
    aren't system-user, user-assistant or assistant-user by their initials. Edits are K(eep), R(erole), D(elete) and
    I(nsert); blank rows and duplicates must go. Of equally cheap ones the least by letters is taken. ``repaired_sha256`` is of
    the repaired turns as ``role:text``, joined by newlines.

    Rows are taken by turn, nulls first, equal turns by role and digest of the text. Null roles and texts are one blank; a
    null id is a conversation like any other; rows that are repeated are duplicates. Conversations in ``ids`` (a column named like ``conv_id``)
    but without rows get zeros, an empty ``audit`` and the digest of nothing; an empty table gives an empty one. Other columns
    are not read.
    """
    return _follow(rows, (conv_id, turn, role, text), False, segment, ids)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The turns of the repaired conversations: ``place`` from 1, ``edit`` (K, R, I), the ``turn`` they come from, ``role``, ``text``.

    Odd rows are taken as in :func:`audit`; a conversation whose repair is empty has no turns.
    """
    return _follow(rows, (conv_id, turn, role, text), True, segment)
