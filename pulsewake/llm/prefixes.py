"""Documents with alike sets of word n-grams: a grouped prefix join.

All tokens have one order. If two sets share ``threshold`` per cent of their union, they share a token among the first few of
each: the prefix, a fifth of a set at 80 per cent. So only prefixes are joined. Documents with equal sets are one class; classes
with equal prefix and size are one group, joined once. Group pairs pass the filters of size, position and number of shared prefix
tokens, then their members are expanded and verified on full sets.

The order puts tokens that many documents have behind the others; which these are is found on a sample of a sixteenth of the
texts. That only steers the work: any order gives the same links.

Candidates come in two rounds. First each group in the list of a token meets one pivot and the few groups next to it: all pairs
of a short list, a fixed number for each posting of a long one. Then only long lists are left, and in them only groups that the
links so far don't connect: no long list of near copies is paired with itself. A linked pair shares half of what it needs in short
lists or more than half of it in long ones, so each round counts its own. Postings are dealt by sampled ranges of token and group, so a hot
token has many tasks, and kept in blocks of a few hundred; a pair of blocks inside one component is left out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.components import also_connected, connected, plain_id, sifted, written
from pulsewake.llm.near import linked, shingle_sets
from pulsewake.llm.words import SPACED, blocks, mix, second

SHINGLE = 5
THRESHOLD = 80
SAMPLE = 16  # one text of so many tells which tokens are common
COMMON = 4  # texts of the sample that have a common token
LISTED = 1 << 18  # common tokens that are put last, the most common ones
BLOCK = 256
FEW, PART = 3, 4  # of the tokens that two prefixes must share a fourth is asked for, at least 3: more leave fewer pairs to verify, but make more rows
NEXT = 8  # groups of a list that each one meets in the first round, besides the pivot
PARTNERS = 64


# -- sets, order, prefixes ----------------------------------------------------------------------------------------


def _tokens(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), SPACED, lower=True):
                sets = shingle_sets(block, size)
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    return work


def common_tokens(keyed: DataFrame, size: int) -> np.ndarray:
    """The tokens of more than a few texts, sorted; the most common ``LISTED`` ones, by a sample of different texts."""
    hashed = keyed.where("text is not null").select(F.xxhash64("text").alias("h"), "text").where(F.pmod("h", F.lit(SAMPLE)) == 0)
    texts = hashed.groupBy("h").agg(F.first("text").alias("text")).select("text")
    counts = texts.mapInArrow(_tokens(size), "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "token").limit(LISTED).toArrow()
    return np.sort(found.column("token").to_numpy().astype(np.int64).view(np.uint64))


def prefix_size(n: np.ndarray, threshold: int) -> np.ndarray:
    """Of ``n`` tokens all but the least number that must be shared, and one."""
    return n - (threshold * n + 99) // 100 + 1


def _prefixed(size: int, threshold: int, common):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = common.value
        for batch in batches:
            for block in blocks(batch.column(2), SPACED, lower=True):
                rows = []
                for tokens in shingle_sets(block, size):
                    n = len(tokens)
                    if not n:
                        rows.append((0, None, None, None, None, None))
                        continue
                    known = np.zeros(n, dtype=bool)
                    if len(last):
                        known = last[np.minimum(np.searchsorted(last, tokens), len(last) - 1)] == tokens
                    prefix = np.concatenate((tokens[~known], tokens[known]))[: int(prefix_size(np.int64(n), threshold))]
                    digests = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (mix(tokens), second(tokens), mix(prefix), second(prefix))]
                    rows.append((n, *digests, prefix.tobytes()))
                part = batch.slice(block.first, block.last - block.first)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "tag", "n", "d1", "d2", "p1", "p2", "prefix"])

    return work


# -- postings -----------------------------------------------------------------------------------------------------


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token of a prefix with the group; ``at`` holds size and place in one number."""
    for batch in batches:
        prefixes = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
        counts = np.array([len(x) for x in prefixes], dtype=np.int64)
        if not len(counts):
            continue
        groups, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        columns = [np.concatenate(prefixes), np.repeat(groups, counts), np.repeat(sizes << 32, counts) | place]
        for a in range(0, len(place), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in columns], names=["token", "group", "at"])


def _lists(size: int):
    """Sorted postings to blocks of one token. A token with a single posting is left out, unless the range begins or ends in it; lists
    that may go on in another block, and those of more than the first round pairs, are ``long``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the last run so far
        border = True  # whether that run is the first of the range

        def made(columns: list[np.ndarray], begins: np.ndarray, long: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(np.concatenate((begins, [len(columns[0])])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns[1:]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0][begins]), *lists, pa.array(long)], names=["token", "groups", "ats", "long"])

        def cut(columns: list[np.ndarray], first: bool, last: bool) -> pa.RecordBatch:
            n = len(columns[0])
            begins = np.concatenate(([0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1))
            lengths = np.diff(np.concatenate((begins, [n])))
            long = lengths > NEXT + 1
            long[0] |= first
            long[-1] |= last
            kept = long | (lengths > 1)
            rows = np.repeat(kept, lengths)
            columns, lengths = [c[rows] for c in columns], lengths[kept]
            begins = np.cumsum(lengths) - lengths
            parts = (lengths + size - 1) // size
            starts = np.repeat(begins, parts) + size * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            return made(columns, starts, np.repeat(long[kept], parts))

        for batch in batches:
            columns = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            if not len(columns[0]):
                continue
            begin = int(np.searchsorted(columns[0], columns[0][-1]))
            if begin:
                yield cut([c[:begin] for c in columns], border, False)
                border = False
            # of a long last run all whole blocks go at once
            whole = (len(columns[0]) - begin - 1) // size * size
            if whole:
                yield made([c[begin : begin + whole] for c in columns], np.arange(0, whole, size), np.ones(whole // size, dtype=bool))
                border = True
            held = [c[begin + whole :] for c in columns]
        if len(held[0]):
            yield cut(held, True, True)

    return work


def needed(size: np.ndarray, other: np.ndarray, threshold: int) -> np.ndarray:
    """Tokens that two sets must share near the beginning of their prefixes. A link takes so many in the prefixes: those it needs, less what
    at most one of them has behind its prefix. A part of them is asked for, so that the first ones count."""
    least = -(-threshold * (size + other) // (100 + threshold))
    inside = least - np.maximum(size - prefix_size(size, threshold), other - prefix_size(other, threshold))
    return np.minimum(inside, np.maximum(FEW, inside // PART))


def may_link(left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Filters of size and position for postings of one token: whether it can be among the first :func:`needed` ones that a linked pair
    shares. Then fewer than these are shared before it, and the rest from there on."""
    n, i, m, j = left >> 32, left & 0xFFFFFFFF, right >> 32, right & 0xFFFFFFFF
    shared = np.minimum(np.minimum(i, j), needed(n, m, threshold) - 1) + np.minimum(n - i, m - j)
    return (100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & ((100 + threshold) * shared >= threshold * (n + m))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _met(left: list[np.ndarray], right: list[np.ndarray], begins: np.ndarray, counts: np.ndarray, threshold: int, spots: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Postings ``[groups, ats]`` or ``[groups, ats, components, shorts, sizes]``, the k-th left one against the right ones from
    ``begins[k]``: rows of an array, of what may link. A few million postings meet at a time.

    Of groups alone: the groups ``a < b``, the number of tokens they share here and the number they need here, half of all. With
    components: the group of the smaller one and the larger component, so that a group and thousands of near copies are one row, the
    spot of the left posting, and the tokens that some pair of the two shares and the fewest that one needs: in long lists all but the
    tokens that both have in short ones, or less than half.
    """
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 21), side="right")))
        own = counts[first:last]
        x = np.repeat(np.arange(first, last), own)
        y = np.repeat(begins[first:last] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        first = last
        ok = may_link(left[1][x], right[1][y], threshold) & (left[0][x] != right[0][y])
        if spots is not None:
            ok &= left[2][x] != right[2][y]
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        need = needed(left[1][x] >> 32, right[1][y] >> 32, threshold)
        a, b = left[0][x], right[0][y]
        if spots is None:
            yield _counted(np.stack((np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64), np.ones(len(a), np.int64), (need + 1) // 2)))
            continue
        need -= np.minimum(np.minimum(left[3][x], right[3][y]), (need - 1) // 2)
        larger = (left[4][x] > right[4][y]) | ((left[4][x] == right[4][y]) & (left[2][x] > right[2][y]))
        # a component of one class meets a group once a token, so nothing has to be told apart
        spot = np.where(np.maximum(left[4][x], right[4][y]) > 1, spots[x], 0)
        yield _counted(np.stack((np.where(larger, b, a), np.where(larger, left[2][x], right[2][y]), spot, np.ones(len(a), np.int64), need)))


def _counted(rows: np.ndarray) -> np.ndarray:
    """One column for each pair and spot, with the sum of what it shares, at a spot other than 0 with 1, and the least need."""
    order = np.lexsort((rows[4], rows[2], rows[1], rows[0]))
    rows = rows[:, order]
    begins = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
    out = rows[:, begins]
    out[3] = np.where(out[2] == 0, np.add.reduceat(rows[3], begins), 1)
    return out


def _gathered(found: Iterator[np.ndarray], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_met`, equal pairs put together as far as a bounded buffer reaches."""
    names = ["a", "b", "spot", "shared", "need"]
    held, size = [], 0
    for rows in found:
        held.append(rows)
        size += rows.shape[1]
        if size > 2 * limit:
            held = [_counted(np.concatenate(held, axis=1))]
            size = held[0].shape[1]
            if size > limit:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _counted(np.concatenate(held, axis=1))], names=names)


_MET = "a bigint, b bigint, spot bigint, shared bigint, need bigint"


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return lengths, np.cumsum(lengths) - lengths


def _near_pairs(threshold: int):
    """The first posting of each block ``groups, ats`` against the rest of it, the others against the few behind them."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            lengths, begins = _lengths(batch.column(0))
            own = [_flat(batch.column(i)) for i in (0, 1)]
            at = np.arange(len(own[0]))
            behind = np.repeat(begins + lengths, lengths) - at - 1
            counts = np.where(at == np.repeat(begins, lengths), behind, np.minimum(behind, NEXT))
            yield from _met(own, own, at + 1, counts, threshold)

    return lambda batches: _gathered(met(batches))


def _inside_pairs(threshold: int):
    """Postings of a block ``groups, ats, comps, shorts, sizes`` with its spot against those behind them."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            lengths, begins = _lengths(batch.column(0))
            own = [_flat(batch.column(i)) for i in range(5)]
            at = np.arange(len(own[0]))
            yield from _met(own, own, at + 1, np.repeat(begins + lengths, lengths) - at - 1, threshold, np.repeat(batch.column(5).to_numpy(), lengths))

    return lambda batches: _gathered(met(batches))


def _across_pairs(threshold: int):
    """Postings of a block ``groups, ats, comps, shorts, sizes`` against those of a second one in the same row, which ends with the spot."""
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            lengths, _ = _lengths(batch.column(0))
            others, begins = _lengths(batch.column(5))
            left, right = ([_flat(batch.column(i)) for i in r] for r in (range(5), range(5, 10)))
            yield from _met(left, right, np.repeat(begins, lengths), np.repeat(others, lengths), threshold, np.repeat(batch.column(10).to_numpy(), lengths))

    return lambda batches: _gathered(met(batches))


# -- verifying ----------------------------------------------------------------------------------------------------


def _verified(size: int, threshold: int):
    """Cells of classes with texts: each left one against the right ones, a link to each of their components."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, entries = batch.column(0).value_lengths().to_numpy(), batch.column(0).flatten()
            classes, comps, lefts, texts = (entries.field(i) for i in range(4))
            sets = [x for block in blocks(texts, SPACED, lower=True) for x in shingle_sets(block, size)]
            classes, comps, lefts = classes.to_numpy(), comps.to_numpy(), lefts.to_numpy(zero_copy_only=False)
            found = []
            for end, length in zip(np.cumsum(cells), cells):
                own = np.arange(end - length, end)
                for i in own[lefts[own]]:
                    met = set()
                    for j in own[~lefts[own]]:
                        if comps[j] not in met and classes[i] != classes[j] and linked(sets[i], sets[j], threshold):
                            met.add(comps[j])
                            found.append((classes[i], classes[j]))
            pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return work


def _pair_cells(pairs: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of classes as cells ``x``, ``y``: a class on the left meets its partners a few dozen at a time."""
    pairs = written(pairs.where("a <> b").distinct(), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").select(F.col("a").alias("x"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("y"), "b")
    right = dealt.select("x", "y", F.col("b").alias("class"), F.col("b").alias("comp"), F.lit(False).alias("left"))
    return right.unionByName(dealt.select("x", "y", F.col("x").alias("class"), F.col("x").alias("comp"), F.lit(True).alias("left")).distinct())


def _wide_cells(wide: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs ``group``, ``one`` of a group and a component as cells: the classes of all groups that meet a component on the left, its own on the
    right, both in parts of a few dozen, each part of one with each of the other. ``placed`` has ``class``, ``group``, its component ``one`` and ``comp``."""
    lefts = wide.join(placed.select("group", "class", "comp"), "group").select("one", "class", "comp")
    rights = placed.join(wide.select("one").distinct(), "one").select("one", "class", "comp")
    parts = lambda rows, c: rows.groupBy("one").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias(c))
    sizes = parts(rights, "rows").join(parts(lefts, "columns"), "one")
    cell = F.col("row") * F.col("columns") + F.col("column")
    part = lambda c: F.pmod(F.xxhash64("class"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    right = rights.join(sizes, "one").select("*", part("rows").alias("row"), every("columns").alias("column"), F.lit(False).alias("left"))
    left = lefts.join(sizes, "one").select("*", part("columns").alias("column"), every("rows").alias("row"), F.lit(True).alias("left"))
    return right.unionByName(left).select(F.col("one").alias("x"), (-1 - cell).alias("y"), "class", "comp", "left")


class _Join:
    def __init__(self, keyed: DataFrame, classes: DataFrame, size: int, threshold: int):
        self.keyed, self.classes, self.size, self.threshold = keyed, classes, size, threshold

    def texts(self, wanted: DataFrame) -> DataFrame:
        """The text of one member of each class; texts take less room in a shuffle than the hashes of their sets."""
        of = written(self.classes.join(wanted, "class", "left_semi").select("class", F.col("id").alias("of_id"), F.col("tag").alias("of_tag")), "wanted")
        own = sifted(self.keyed, F.xxhash64("id", "tag"), of.select(F.xxhash64("of_id", "of_tag")))
        texts = own.join(of, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tag") == F.col("of_tag"))).select("class", "text")
        return texts.groupBy("class").agg(F.first("text").alias("text"))

    def verify(self, cells: DataFrame) -> DataFrame:
        """Links between classes of cells ``x``, ``y``."""
        cells = written(cells, "met")
        full = cells.join(self.texts(cells.select("class").distinct()), "class").groupBy("x", "y").agg(F.collect_list(F.struct("class", "comp", "left", "text")).alias("e"))
        return written(full.select("e").mapInArrow(_verified(self.size, self.threshold), "a bigint, b bigint"), "links")


# -- the join -----------------------------------------------------------------------------------------------------


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, threshold: int = THRESHOLD,
                      block: int = BLOCK) -> DataFrame:
    """One row per document: ``id``, ``tag`` (a hash of the text), ``n_shingles``, ``class_id`` (equal sets), ``group`` and ``component_id``.

    A document's set: distinct runs of ``shingle`` words (bytes other than blank and controls 9 to 13, A-Z in lower case); with
    fewer words the whole sequence. Two are linked if their sets share ``threshold`` per cent of the union. ``group`` numbers the
    connected components, ``component_id`` is the least id in one.

    Null or empty texts and texts without words have ``n_shingles`` 0, no class or group, and their own id as component. Null ids
    take part and are never the least; a group of null ids only has a null component. Repeated rows are one class; other columns
    are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    own, kind = plain_id(docs, doc_id)
    keyed = docs.select(own.alias("id"), F.hash(f"`{text}`").alias("tag"), F.col(f"`{text}`").alias("text"))
    common = spark.sparkContext.broadcast(common_tokens(keyed, shingle))
    members = written(keyed.mapInArrow(_prefixed(shingle, threshold, common), f"id {kind}, tag int, n bigint, d1 bigint, d2 bigint, p1 bigint, p2 bigint, prefix binary"), "members")
    classes = members.where("n > 0").groupBy("d1", "d2").agg(
        F.first("n").alias("n"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.min(F.struct("id", "tag")).alias("of"), F.min("id").alias("least"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "n", "p1", "p2", "of.id", "of.tag", "least"), "classes")
    key = ["n", "p1", "p2"]
    groups = written(classes.groupBy(*key).agg(F.min("class").alias("group")), "groups")
    prefixes = members.where("n > 0").groupBy(*key).agg(F.first("prefix").alias("prefix")).join(groups, key).select("group", "n", "prefix")
    grouped = written(classes.join(groups, key).select("class", "group"), "grouped")

    order = ["token", F.xxhash64("group")]
    postings = written(prefixes, "prefixes").mapInArrow(_postings, "token bigint, `group` bigint, at bigint")
    lists = postings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_lists(block), "token bigint, groups array<bigint>, ats array<bigint>, long boolean")
    lists = written(lists.select(F.monotonically_increasing_id().alias("block"), "*"), "lists")

    join = _Join(keyed, classes, shingle, threshold)
    near = written(_enough(lists.select("groups", "ats").mapInArrow(_near_pairs(threshold), _MET)), "near")
    inside = grouped.select(F.col("group").alias("a"), F.col("class").alias("b"))
    roots = written(connected(join.verify(_pair_cells(near.unionByName(inside)))), "roots")
    more = join.verify(_open(lists, near, grouped, roots, threshold))
    roots = written(also_connected(roots, more), "roots")

    named = classes.join(roots, classes["class"] == roots["node"], "left").select("d1", "d2", "class", "least", F.coalesce("root", "class").alias("group"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    rows = members.select("id", "tag", "n", "d1", "d2").join(named.drop("least").join(least, "group"), ["d1", "d2"], "left")
    return rows.select("id", "tag", F.col("n").alias("n_shingles"), F.col("class").alias("class_id"), "group",
                       F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _enough(met: DataFrame) -> DataFrame:
    """Pairs that share what they need here."""
    here = met.groupBy("a", "b", "spot").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
    shared = F.when(F.col("spot") == 0, F.col("shared")).otherwise(1)
    counts = here.groupBy("a", "b").agg(F.sum(shared).alias("shared"), F.min("need").alias("need"))
    return counts.where(F.col("shared") >= F.col("need")).select("a", "b")


def _open(lists: DataFrame, near: DataFrame, grouped: DataFrame, roots: DataFrame, threshold: int) -> DataFrame:
    """Cells of candidates in different components: of groups that meet in long lists, or were paired before by their
    first classes only."""
    comp = F.coalesce("root", "class")
    placed = written(grouped.join(roots, grouped["class"] == roots["node"], "left").select("class", "group", comp.alias("comp")), "placed")
    # a group of several components is one by itself, with a number that no class has
    ends = placed.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n"))
    short = lists.where("NOT long").select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("short"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("group"))
    of_group = written(ends.join(short, "group", "left").select("group", one.alias("comp"), F.coalesce("short", F.lit(0)).alias("short"), "n"), "components")
    sizes = of_group.groupBy("comp").agg(F.sum("n").alias("size"))
    entries = lists.where("long").select("block", "token", F.explode(F.arrays_zip("groups", "ats")).alias("e")).select(
        "block", "token", F.col("e.groups").alias("group"), F.col("e.ats").alias("at"))
    spans = entries.select("block", "token", "group").join(of_group, "group").groupBy("token").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("block").alias("first"), F.max("block").alias("last"))
    # a token of several blocks is a spot, to be counted once
    alive = spans.where("low <> high").select("token", F.when(F.col("first") < F.col("last"), F.col("token")).otherwise(0).alias("spot"))
    marked = entries.join(alive, "token").join(of_group.join(sizes, "comp").drop("n"), "group")
    cells = written(marked.groupBy("block", "token", "spot").agg(
        F.collect_list(F.struct("group", "at", "comp", "short", "size")).alias("e"), F.min("comp").alias("low"), F.max("comp").alias("high")).select(
        "block", "token", "spot", "low", "high", *[F.col(f"e.{c}").alias(f"{c}s") for c in ("group", "at", "comp", "short", "size")]), "cells")
    lists = ["groups", "ats", "comps", "shorts", "sizes"]
    own = cells.where("low <> high").select(*lists, "spot").mapInArrow(_inside_pairs(threshold), _MET)
    x, y = cells.alias("x"), cells.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.block") < F.col("y.block")) & (
        (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high")))
    across = x.join(y, apart).select(*[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "xy" for c in lists], F.col("x.spot").alias("spot")).mapInArrow(_across_pairs(threshold), _MET)
    wide = written(_enough(own.unionByName(across)), "open").select(F.col("a").alias("group"), F.col("b").alias("one"))
    member = lambda c: placed.select(F.col("group").alias(c), F.col("class").alias(f"{c}_class"), F.col("comp").alias(f"{c}_comp"))
    between = near.join(member("a"), "a").join(member("b"), "b").where("a_comp <> b_comp AND NOT (a_class = a AND b_class = b)").select(F.col("a_class").alias("a"), F.col("b_class").alias("b"))
    mixed = placed.join(ends.where("low <> high").select("group"), "group", "left_semi")
    within = mixed.alias("x").join(mixed.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.class") < F.col("y.class")) & (F.col("x.comp") != F.col("y.comp")))
    pairs = between.unionByName(within.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")))
    return _pair_cells(pairs).unionByName(_wide_cells(wide, placed.join(of_group.select("group", F.col("comp").alias("one")), "group")))
