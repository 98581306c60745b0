"""A breadth-first flood from all vertices at once, as a matrix of bits in tiles.

Row ``x`` of the matrix has a bit for every source that vertex ``x`` has heard of. A row of the state table holds the bits
of ``chunk`` vertices for one block of ``64 * words`` sources, packed. A task takes the edges of one part of one tile, a
square of ``side`` vertices, and the fresh bits of one block of sources of its two sides; so its memory is bounded by the
tile, and nothing is ever sent for a single edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsewake.runtime import cut_lineage

STATE = "chunk int, block int, seen binary, fresh binary, n binary, s binary"
STATE_ARROW = pa.schema([("chunk", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("seen", "fresh", "n", "s")]])
NEWS = "chunk int, block int, heard binary"
NEWS_ARROW = pa.schema([("chunk", pa.int32()), ("block", pa.int32()), ("heard", pa.binary())])


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type, *shape: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=int(np.prod(shape)) * 8, codec="zstd")
    return np.frombuffer(raw, kind).reshape(shape)


def _start(vertices: int, chunk: int, words: int):
    """Every vertex has heard of itself."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = _pack(np.zeros(chunk, np.int64))
        for batch in batches:
            for number in batch.column(0).to_pylist():
                x = np.arange(number * chunk, min((number + 1) * chunk, vertices))
                blocks = x // (64 * words)
                for block in range(blocks[0], blocks[-1] + 1):
                    own = x[blocks == block]
                    bits = np.zeros((chunk, words), np.uint64)
                    bits[own % chunk, own // 64 % words] = np.uint64(1) << (own % 64).astype(np.uint64)
                    row = [number, block, _pack(bits), _pack(bits), nothing, nothing]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, STATE_ARROW, strict=True)], schema=STATE_ARROW)

    return start


def _merged(known: np.ndarray, at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each target the union of the rows ``at[start:start + count]``."""
    heard = np.zeros((len(starts), known.shape[1]), known.dtype)
    for i in np.flatnonzero(counts > 256):
        end = starts[i] + counts[i]
        for begin in range(starts[i], end, 4096):
            heard[i] |= np.bitwise_or.reduce(known[at[begin:min(begin + 4096, end)]], axis=0)
    # targets with few neighbours together: the first neighbour of each, then the second of those that have one, …
    few = np.flatnonzero(counts <= 256)
    few = few[np.argsort(-counts[few], kind="stable")]
    for begin in range(0, len(few), 8192):
        some = few[begin:begin + 8192]
        part = known[at[starts[some]]]
        for k in range(1, counts[some[0]]):
            more = np.count_nonzero(counts[some] > k)
            part[:more] |= known[at[starts[some[:more]] + k]]
        heard[some] = part
    return heard


def _spread(side: int, chunk: int, words: int):
    """What the vertices of a tile hear over one part of its edges, both ways, from one block of sources."""
    per = side // chunk

    def spread(key: tuple, fresh: pa.Table, edges: pa.Table) -> pa.Table:
        left, right, _, block = (k.as_py() for k in key)
        place, rows, taken = np.full(2 * side, -1, np.int32), [], 0
        for number, data in zip(fresh["chunk"].to_pylist(), fresh["fresh"].to_pylist(), strict=True):
            bits = _unpack(data, np.uint64, chunk, words)
            lit = np.flatnonzero(bits.any(axis=1))
            base = number % per * chunk + (0 if number // per == left else side)
            place[base + lit] = np.arange(taken, taken + len(lit))
            rows.append(bits[lit])
            taken += len(lit)
        out = {"chunk": [], "block": [], "heard": []}
        if rows and edges.num_rows:
            pairs = np.concatenate([part.flatten().to_numpy() for part in edges["pairs"].chunks])
            x, y = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32) + (0 if left == right else side)
            to, at = np.concatenate([y, x]), place[np.concatenate([x, y])]
            to, at = to[at >= 0], at[at >= 0]
            if not len(to):
                return pa.table(out, schema=NEWS_ARROW)
            order = np.argsort(to, kind="stable")
            at = at[order]
            targets, starts, counts = np.unique(to[order], return_index=True, return_counts=True)
            heard = _merged(np.concatenate(rows), at, starts, counts)
            locals_, begins = np.unique(targets // chunk, return_index=True)
            for local, begin, end in zip(locals_.tolist(), begins, [*begins[1:], len(targets)], strict=True):
                bits = np.zeros((chunk, words), np.uint64)
                bits[targets[begin:end] % chunk] = heard[begin:end]
                out["chunk"].append(left * per + local if local < per else right * per + local - per)
                out["block"].append(block)
                out["heard"].append(_pack(bits))
        return pa.table(out, schema=NEWS_ARROW)

    return spread


def _merge(depth: int, chunk: int, words: int):
    """State and news of one chunk and block; only bits that are new stay fresh."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        seen, heard = np.zeros((chunk, words), np.uint64), np.zeros((chunk, words), np.uint64)
        n, s = np.zeros(chunk, np.int64), np.zeros(chunk, np.int64)
        for news, old, count, total in zip(*(rows[c].to_pylist() for c in ("heard", "seen", "n", "s")), strict=True):
            if news is not None:
                heard |= _unpack(news, np.uint64, chunk, words)
            else:
                seen |= _unpack(old, np.uint64, chunk, words)
                n, s = _unpack(count, np.int64, chunk), _unpack(total, np.int64, chunk)
        fresh = heard & ~seen
        new = np.bitwise_count(fresh).sum(axis=1, dtype=np.int64)
        data = [_pack(seen | heard), _pack(fresh) if new.any() else None, _pack(n + new), _pack(s + depth * new)]
        return pa.table([pa.array([v], f.type) for v, f in zip([*(k.as_py() for k in key), *data], STATE_ARROW, strict=True)], schema=STATE_ARROW)

    return merge


def _sums(chunk: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, s in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                x = np.arange(number * chunk, (number + 1) * chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), pa.array(_unpack(n, np.int64, chunk)), pa.array(_unpack(s, np.int64, chunk))], names=["seq", "n", "s"])

    return sums


def distance_sums(edges: DataFrame, vertices: int, max_depth: int | None, words: int, part_size: int, side: int) -> DataFrame:
    """``(seq, n, s)`` for vertices 0 … ``vertices - 1`` under undirected simple edges ``(x, y)``, ``x < y``: how many others
    are reached, and the sum of their distances. A vertex may have several rows, to be added up, and numbers beyond the last
    vertex occur with zeros.

    A tile with more than ``part_size`` edges, so also one with a hub, is dealt to several tasks.
    """
    spark = edges.sparkSession
    # the work of a task follows the bits of its rows, not their packed size, so the number of tasks is fixed
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = min(1024, side)
    square = lambda v: F.floor(F.col(v) / side).cast("int")
    placed = edges.select(
        F.struct(square("x").alias("left"), square("y").alias("right")).alias("tile"),
        (F.shiftleft(F.col("x") % side, 32) + F.col("y") % side).alias("pair"),
    )
    # at most a row for each part_size edges and one for each tile
    sizes = cut_lineage(placed.groupBy("tile").agg(F.ceil(F.count("*") / part_size).cast("int").alias("parts")))
    parts_of = sizes.agg(F.map_from_entries(F.collect_list(F.struct("tile", "parts")))).scalar()
    parts = F.element_at(parts_of, F.col("tile"))
    per_part = max(1, part_size >> 16)
    dealt = placed.withColumn("slice", F.pmod(F.xxhash64("pair"), parts * per_part).cast("int"))
    dealt = dealt.groupBy("tile", "slice").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    packed = cut_lineage(dealt.select("tile.left", "tile.right", F.floor(F.col("slice") / per_part).cast("int").alias("part"), "pairs"))
    ends = sizes.select(F.explode(F.array_distinct(F.array("tile.left", "tile.right"))).alias("at"), "tile", "parts")
    ends = ends.select("at", "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tiles_of = cut_lineage(ends.groupBy("at").agg(F.collect_list(F.struct("tile.left", "tile.right", "part")).alias("tiles")))
    tiles_of = tiles_of.agg(F.map_from_entries(F.collect_list(F.struct("at", "tiles")))).scalar()
    state = cut_lineage(spark.range(-(-vertices // chunk)).mapInArrow(_start(vertices, chunk, words), STATE))
    cell = ["left", "right", "part", "block"]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = state.where("fresh IS NOT NULL")
        at = F.floor(F.col("chunk") * F.lit(chunk) / side).cast("int")
        sent = fresh.select("chunk", "block", "fresh", F.explode(F.try_element_at(tiles_of, at)).alias("t")).select("t.*", "block", "chunk", "fresh")
        lively = fresh.agg(F.collect_set("block")).scalar()
        over = packed.select("left", "right", "part", F.explode(lively).alias("block"), "pairs")
        news = sent.repartition(tasks, *cell).groupBy(*cell).cogroup(over.repartition(tasks, *cell).groupBy(*cell)).applyInArrow(_spread(side, chunk, words), NEWS)
        both = state.drop("fresh").unionByName(news, allowMissingColumns=True)
        state = cut_lineage(both.repartition(tasks, "chunk", "block").groupBy("chunk", "block").applyInArrow(_merge(depth, chunk, words), STATE))
        if state.where("fresh IS NOT NULL").isEmpty():
            break
    return state.select("chunk", "n", "s").mapInArrow(_sums(chunk), "seq bigint, n bigint, s bigint")
