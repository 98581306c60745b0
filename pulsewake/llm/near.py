"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its shingles. Documents with equal sets are one class from the start. Every class gets a
signature of minwise tokens; a tree sends it down paths of chosen tokens: at the root and at each further node one or
two places of the signature are selected, the same for all classes there, and classes with equal tokens at a place go
on together. A node that is small enough is compared exhaustively; large nodes branch again. Independent trees make
it likely that a pair that parts in one tree meets in another. A pair at the threshold keeps 0.75 paths a place, and half of
the nodes select two places, so below each common root its paths grow by 1.125 a level and never run out with a chance of 0.44,
however deep the tree gets. The number of trees follows from that and the recall aimed at.

Comparing goes from cheap to exact. In a node, signatures rule out what can't be similar (a true pair fails that with
a chance of 1e-8) and cut the node into groups; equal groups of several trees are one; in a group links are confirmed on
full sets, and pairs already connected are left out, so n copies of a text cost n comparisons.

Large nodes go down four levels at once; each class is compared in the first node of a path that is small enough. A node
of near copies never gets small by branching. There every class is compared with a pivot and the neighbours in its
block. Nodes whose classes are all connected by then are finished; where few classes are not, they are compared with
all the others, block by block; the rest branches on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.components import also_connected, connected, plain_id, sifted, written
from pulsewake.llm.words import SPACED, Block, blocks, mix, runs, second

SHINGLE = 5
THRESHOLD = 75
TARGET = 0.999  # recall of pairs at the threshold in trees of any depth
PLACES = 96
NODE = 1024
LEVELS = 4
_RANDOM = np.random.default_rng(20240117)
_MULTIPLIERS = _RANDOM.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, PLACES, dtype=np.uint64)


# -- sets and signatures ------------------------------------------------------------------------------------------


def shingle_sets(block: Block, size: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles."""
    words, starts, out = block.words, block.starts.tolist(), []
    grams = runs(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix(runs(words[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def _signed(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), SPACED, lower=True):
                sets = shingle_sets(block, size)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                full = counts > 0
                n = int(full.sum())
                tokens = np.zeros((n, PLACES), dtype=np.int32)
                digests = np.zeros((2, n), dtype=np.int64)
                if n:
                    flat = np.concatenate(sets)
                    begins = (np.cumsum(counts) - counts)[full]
                    for k in range(PLACES):
                        values = flat ^ _MASKS[k]
                        values *= _MULTIPLIERS[k]
                        tokens[:, k] = (np.minimum.reduceat(values, begins) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    digests[0] = np.add.reduceat(mix(flat), begins).view(np.int64)
                    digests[1] = np.add.reduceat(second(flat), begins).view(np.int64)
                index = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PLACES), pa.array(tokens.reshape(-1)))
                rows = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(counts), pa.array(digests[0]).take(index), pa.array(digests[1]).take(index), lists.take(index)],
                    names=["id", "tag", "n", "d1", "d2", "tokens"])

    return work


def _sets(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), SPACED, lower=True):
                rows = batch.slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in shingle_sets(block, size)], pa.binary())], names=["class", "hashes"])

    return work


# -- comparing ----------------------------------------------------------------------------------------------------


def _reached(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Connected groups of two and more out of ``n``: ``near`` gives those of the places asked for that are linked with one.

    Each place is compared with those that no group holds yet, so the members of a group aren't compared once they are in it.
    """
    left, out = np.arange(n), []
    while len(left) > 1:
        group, left, at = [int(left[0])], left[1:], 0
        while at < len(group) and len(left):
            found = near(group[at], left)
            group += left[found].tolist()
            left = left[~found]
            at += 1
        if len(group) > 1:
            out.append(np.array(sorted(group)))
    return out


def alike_groups(tokens: np.ndarray, sizes: np.ndarray, threshold: int) -> list[np.ndarray]:
    """Members of a node that may be linked, in connected groups of two and more."""
    least = PLACES // 2

    def near(i: int, others: np.ndarray) -> np.ndarray:
        may = 100 * np.minimum(sizes[i], sizes[others]) >= threshold * np.maximum(sizes[i], sizes[others])
        at = np.flatnonzero(may)
        may[at] = (tokens[others[at]] == tokens[i]).sum(axis=1) >= least
        return may

    return _reached(len(sizes), near)


def _grouped(threshold: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, tokens = (batch.column(i).flatten() for i in range(3))
            tokens = tokens.flatten().to_numpy(zero_copy_only=False).reshape(-1, PLACES)
            ids, sizes = ids.to_numpy(), sizes.to_numpy()
            at = np.concatenate(([0], np.cumsum(batch.column(0).value_lengths().to_numpy()))).tolist()
            out = [np.unique(ids[a:b][g]) for a, b in zip(at[:-1], at[1:]) for g in alike_groups(tokens[a:b], sizes[a:b], threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g in out if len(g) > 1], pa.list_(pa.int64()))], names=["members"])

    return work


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether the shared part of two sorted sets is ``threshold`` per cent of their union, or more."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < threshold * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def confirmed(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """What the full sets connect, as links of every member to the first of its component.

    One set is compared with many at once: its tokens are looked up in lists of the sets that hold each token.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sets)), sizes)
    listed, index = None, None

    def near(i: int, others: np.ndarray) -> np.ndarray:
        nonlocal listed, index
        if listed is None or 2 * len(others) < len(listed):  # lists of those that are left
            listed = others
            inside = np.zeros(len(sets), dtype=bool)
            inside[others] = True
            entries = np.flatnonzero(inside[owner])
            entries = entries[np.argsort(token[entries], kind="stable")]
            starts = np.searchsorted(token[entries], np.arange(token.max() + 2))
            index = owner[entries], starts
        owners, starts = index
        own = token[begins[i] : begins[i] + sizes[i]]
        counts = starts[own + 1] - starts[own]
        places = np.repeat(starts[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(owners[places], minlength=len(sets))[others]
        return 100 * both >= threshold * (sizes[i] + sizes[others] - both)

    return [(int(g[0]), int(j)) for g in _reached(len(sets), near) for j in g[1:]]


def _confirmed(threshold: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for ids, hashes in zip(batch.column(0), batch.column(1)):
                ids = ids.values.to_numpy()
                sets = [np.frombuffer(h.as_buffer(), dtype=np.uint64) for h in hashes.values]
                for a, b in confirmed(sets, threshold):
                    left.append(ids[a])
                    right.append(ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return work


def _paths(levels: int):
    """The nodes below large ones, ``levels`` deep: one place of the signature for each node, for half of them two."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            tokens = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, PLACES)
            row = np.arange(len(node))
            for level in range(1, levels + 1):
                parent, parent_row, nodes, rows = node, row, [], []
                for k in (0, 1):
                    taken = np.flatnonzero(mix(parent + np.uint64(3)) & np.uint64(1)) if k else np.arange(len(parent))
                    seed = mix(parent[taken] + np.uint64(k + 1))
                    token = tokens[parent_row[taken], (seed % np.uint64(PLACES)).astype(np.int64)].view(np.uint32).astype(np.uint64)
                    nodes.append(mix(seed ^ mix(token)))
                    rows.append(taken)
                taken = np.concatenate(rows)
                node, row = np.concatenate(nodes), parent_row[taken]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), level, np.int32)), pa.array(parent[taken].view(np.int64)), pa.array(node.view(np.int64)), batch.column(1).take(pa.array(row))],
                    names=["level", "parent", "node", "class"])

    return work


# -- the join -----------------------------------------------------------------------------------------------------


class _Join:
    """Classes, the sets of those that may be linked, and the links confirmed so far."""

    def __init__(self, keyed: DataFrame, classes: DataFrame, size: int, threshold: int, node: int):
        self.keyed, self.classes, self.size, self.threshold, self.node = keyed, classes, size, threshold, node
        self.sets: DataFrame | None = None
        self.roots: DataFrame | None = None

    def compare(self, cells: DataFrame, stuck: DataFrame | None) -> None:
        """``node``, ``class``: confirm the links within each node; nodes are small."""
        tokens = cells.join(self.classes.select("class", "n", "tokens"), "class")
        lists = tokens.groupBy("node").agg(*[F.collect_list(c).alias(c) for c in ("class", "n", "tokens")]).drop("node")
        groups = written(lists.mapInArrow(_grouped(self.threshold), "members array<bigint>").distinct()
                         .withColumn("group", F.monotonically_increasing_id()), "groups")
        members = groups.select("group", F.explode("members").alias("class"))
        if self.sets is None:
            wanted = members.select("class")
            self.sets = self._full_sets((wanted if stuck is None else wanted.unionByName(stuck.select("class"))).distinct())
        full = members.join(self.sets, "class").groupBy("group").agg(F.collect_list("class").alias("class"), F.collect_list("hashes").alias("hashes")).drop("group")
        found = written(full.mapInArrow(_confirmed(self.threshold), "a bigint, b bigint"), "links")
        self.roots = written(connected(found) if self.roots is None else also_connected(self.roots, found), "roots")

    def _full_sets(self, wanted: DataFrame) -> DataFrame:
        of = written(self.classes.join(wanted, "class", "left_semi").select("class", F.col("id").alias("__id"), F.col("tag").alias("__tag")), "wanted")
        own = sifted(self.keyed, F.xxhash64("id", "tag"), of.select(F.xxhash64("__id", "__tag")))
        texts = own.join(of, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag"))).select("class", "text")
        return written(texts.mapInArrow(_sets(self.size), "class bigint, hashes binary").groupBy("class").agg(F.first("hashes").alias("hashes")), "sets")

    def descend(self, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Follow the paths below large nodes: the first small node of every path, and what is still large at the end."""
        rows = large.select("node", "class").join(self.classes.select("class", "tokens"), "class").select("node", "class", "tokens")
        paths = written(rows.mapInArrow(_paths(LEVELS), "level int, parent bigint, node bigint, class bigint"), "paths")
        sizes = written(paths.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        big = sizes.where(F.col("size") > self.node)
        below = paths.where("level = 1").unionByName(paths.where("level > 1").join(big.select(F.col("node").alias("parent")), "parent", "left_semi").select(paths.columns))
        small = below.join(sizes.where(F.col("size") <= self.node), "node").select("node", "class")
        stuck = written(below.where(F.col("level") == LEVELS).join(big, "node").select("node", "class", "size"), "stuck")
        return small, stuck

    def blocks(self, stuck: DataFrame) -> DataFrame:
        """Large nodes cut into blocks by chance, the same pivot in all blocks of a node."""
        number = F.ceil(F.col("size") / (self.node // 2))
        pivots = stuck.groupBy("node").agg(F.min_by("class", F.xxhash64("class", "node")).alias("class"), F.first("size").alias("size"))
        pivots = pivots.select("node", "class", F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)).alias("block"))
        rows = stuck.select("node", "class", F.pmod(F.xxhash64("class", "node", F.lit(7)), number).alias("block"))
        return rows.unionByName(pivots).distinct().select(F.xxhash64("node", "block").alias("node"), "class")

    def open_nodes(self, stuck: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of large nodes that are not yet one component: cells for those with few stragglers, and the others."""
        marked = written(stuck.join(self.roots.select(F.col("node").alias("class"), "root"), "class", "left").select("node", "class", "size", F.coalesce("root", "class").alias("root")), "marked")
        parts = marked.groupBy("node", "root").agg(F.count(F.lit(1)).alias("part"), F.first("size").alias("size"))
        main = parts.groupBy("node").agg(F.max_by("root", F.struct("part", "root")).alias("main"), (F.first("size") - F.max("part")).alias("rest"))
        rows = written(marked.join(main.where("rest > 0"), "node"), "open")
        half, number = self.node // 2, F.ceil(F.col("size") / (self.node // 2))
        few = rows.where(F.col("rest") <= half)
        body = few.where("root = main").select("node", "class", F.pmod(F.xxhash64("class", F.lit(11)), number).alias("block"))
        rest = few.where("root <> main").select("node", "class", F.explode(F.sequence(F.lit(0).cast("bigint"), number - 1)).alias("block"))
        cells = body.unionByName(rest).select(F.xxhash64("node", "block").alias("node"), "class")
        return cells, rows.where(F.col("rest") > half).select("node", "class", "size")


def trees_for(target: float, threshold: int) -> int:
    """Trees that a pair at the threshold needs to meet in one of them with a chance of ``target``, in trees of any depth."""
    kept, lost = threshold / 100, 0.0
    for _ in range(10_000):  # the chance that all paths below a common root run out: the least fixed point
        part = 1 - kept + kept * lost
        lost = (part + part * part) / 2
    return math.ceil(math.log(1 - target) / math.log(1 - kept * (1 - lost)))


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """The first nodes of every class: tree ``t`` selects place ``t``."""
    nodes = F.array(*[F.xxhash64(F.lit(k), F.col("tokens")[k]) for k in range(trees)])
    return classes.select("class", F.explode(nodes).alias("node"))


def _sized(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of two classes and more, apart into small and large ones."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    table = written(rows.join(counts, "node").select("node", "class", "size"), "nodes")
    return table.where(F.col("size") <= limit).select("node", "class"), table.where(F.col("size") > limit)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD,
                    target: float = TARGET, node: int = NODE) -> DataFrame:
    """One row per document: ``id``, ``tag`` (a hash of the text), ``n_shingles``, ``group`` and ``component_id``.

    A document's set: distinct runs of ``shingle`` words (bytes other than blank and controls 9 to 13, A-Z in lower
    case); with fewer words the whole sequence. Two are linked if their sets share ``threshold`` per cent of the union.
    The filters before the comparison of full sets are made for 75 per cent: lower thresholds are refused.
    ``group`` numbers the connected components, ``component_id`` is the least id in one. ``target`` is the chance that a pair at the
    threshold is compared; it needs no more than 96 trees.

    Null or empty texts and texts without words have ``n_shingles`` 0, no group, and their own id as component. Null ids
    take part and are never the least; a group of null ids only has a null component. Repeated rows are one class, and an
    empty table gives an empty one.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the signature filter is made for thresholds of {THRESHOLD} and more")
    trees = trees_for(target, threshold)
    if trees > PLACES:
        raise ValueError("a signature has too few places for this target")
    own, kind = plain_id(docs, doc_id)
    keyed = docs.select(own.alias("id"), F.hash(f"`{text}`").alias("tag"), F.col(f"`{text}`").alias("text"))
    members = written(keyed.mapInArrow(_signed(shingle), f"id {kind}, tag int, n bigint, d1 bigint, d2 bigint, tokens array<int>"), "members")
    classes = members.where("n > 0").groupBy("d1", "d2").agg(
        F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.min(F.struct("id", "tag")).alias("of"), F.min("id").alias("least"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "n", "tokens", "of.id", "of.tag", "least"), "classes")
    join = _Join(keyed, classes, shingle, threshold, node)
    cells, large = _sized(_roots(classes, trees), node)
    while not large.isEmpty():
        small, stuck = join.descend(large)
        if stuck.isEmpty():
            cells = cells.unionByName(small)
            break
        join.compare(cells.unionByName(small).unionByName(join.blocks(stuck)), stuck)
        cells, large = join.open_nodes(stuck)
    if join.roots is None or not cells.isEmpty():
        join.compare(cells, None)
    roots = join.roots
    named = classes.join(roots, classes["class"] == roots["node"], "left").select("d1", "d2", "least", F.coalesce("root", "class").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.drop("least").join(least, "group")
    rows = members.drop("tokens").join(named, ["d1", "d2"], "left")
    return rows.select("id", "tag", F.col("n").alias("n_shingles"), "group", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of every group, the one with the least id (null ids last), in the columns of ``docs``.

    Documents without words are in no group and stay, repeated rows of them as well. Options as in
    :func:`near_duplicates`.
    """
    found = near_duplicates(docs, text, doc_id, **options).where("group is not null").groupBy("id", "tag").agg(F.first("group").alias("group"))
    first = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "tag")).alias("of")).select("of.id", "of.tag", "group")
    # the columns of the documents lie in one struct, so that none can have the name of one that is needed here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), plain_id(docs, doc_id)[0].alias("doc"), F.hash(f"`{text}`").alias("hash"))
    one = rows.join(first, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("tag"))).dropDuplicates(["group"])
    without = docs.where(F.coalesce(~F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return one.select("row.*").unionByName(without)
