"""Toxicity by weak supervision.

Many weak voters look at a text: lexicons of words and word beginnings, drawn from labelled texts with different strictness,
and patterns. A generative model of their votes, without labels, estimates how often each is right and which depend
on each other: given the class, votes form a tree, so every voter may lean on one other. Its posterior for each
combination of votes replaces hand-made labels: a linear classifier over words and word beginnings is trained on
it and scores every text.

What grows with the corpus stays in Spark: votes of all texts are counted by combination, of which there are at most
``2 ** 16``. Lexicons and classifier come from a sample of labelled texts whose size, ``sample_rows`` of each class, does
not grow; the sampled classes are weighted back to their counts among all labels. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewake.llm.components import written
from pulsewake.llm.words import ALNUM, Block, block_of, blocks, fingerprints, list_column, mix, text_bytes

SAMPLE_ROWS = 6000
FEATURES = 2048
CUTOFF = 0.3
BEGINNINGS = (0, 4, 5, 6)  # bytes of a word that make a feature; 0: the whole word
LEAST_TEXTS = 3
LOOSE, STRICT = 3.5, 70  # how many times as frequent in toxic texts as in clean ones
AMOUNTS = 4
VOTERS = 16

#: Plain insults every lexicon starts with
INSULTS = ["idiot", "stupid", "moron", "loser", "pathetic", "disgusting", "worthless", "scum", "trash", "clown", "dumb", "fool"]
#: Fixed patterns: plain insults, shouting, repeated marks, addressing someone
PATTERNS = [
    rb"(?i)\b(?:" + "|".join(INSULTS).encode() + rb")s?\b",
    rb"(?:\b[A-Z]{4,}\b[^A-Za-z]+){3}",
    rb"[!?]{2,}",
    rb"(?i)\b(?:you are|you're|du bist|tu es|vous \xc3\xaates|eres)\b",
]


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: positions of words and their fingerprints."""
    lengths = block.ends - block.begins
    for k in BEGINNINGS:
        if k == 0:
            yield np.arange(len(block.words)), block.words
        else:
            at = np.flatnonzero(lengths >= k)
            begins = block.begins[at]
            yield at, mix(fingerprints(block.buffer, begins, begins + k) ^ np.uint64(k))


@dataclass
class Found:
    """Entries of a lexicon in the texts of a block: distinct (text, entry) pairs, and how much there is in each text."""

    text: np.ndarray
    entry: np.ndarray
    amounts: np.ndarray  # a bit each for two, three, five hit words and for one word in a hundred


def _found(block: Block, lexicon: np.ndarray) -> Found:
    """Look up a sorted lexicon."""
    n = len(block.counts)
    if not len(lexicon):
        return Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64))
    text_of = np.repeat(np.arange(n), block.counts)
    pairs, hit_word = [], np.zeros(len(block.words), dtype=bool)
    for at, prints in _features(block):
        entry = np.minimum(np.searchsorted(lexicon, prints), len(lexicon) - 1)
        hit = lexicon[entry] == prints
        hit_word[at[hit]] = True
        pairs.append(text_of[at[hit]] * np.int64(len(lexicon)) + entry[hit])
    both = np.unique(np.concatenate(pairs))
    hits = np.bincount(text_of[hit_word], minlength=n)
    amounts = sum(m.astype(np.int64) << i for i, m in enumerate((hits >= 2, hits >= 3, hits >= 5, (hits > 0) & (100 * hits >= block.counts))))
    return Found(both // len(lexicon), both % len(lexicon), amounts)


@dataclass
class Lexicon:
    """Features of toxic texts: fingerprint (sorted), kind, and how many times as frequent they are there as in clean ones."""

    prints: np.ndarray
    kinds: np.ndarray
    lifts: np.ndarray

    def votes(self, found: Found) -> np.ndarray:
        """A bit per voter for each text: for each kind of feature a strict and a loose entry, then the amounts."""
        n = len(found.amounts)
        out = found.amounts << (2 * len(BEGINNINGS))
        if not len(self.prints):
            return out
        kind, strict = self.kinds[found.entry], self.lifts[found.entry] >= STRICT
        for i in range(len(BEGINNINGS)):
            for j, own in enumerate(((kind == i) & strict, kind == i)):
                out |= (np.bincount(found.text[own], minlength=n) > 0).astype(np.int64) << (2 * i + j)
        return out


_compiled = [regex.compile(p) for p in PATTERNS]


def _pattern_votes(texts: list) -> np.ndarray:
    return np.array([sum(1 << (VOTERS - len(PATTERNS) + i) for i, p in enumerate(_compiled) if p.search(t)) for t in texts], dtype=np.int64)


# -- label model --------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Class share, tables of each vote given its parent's and the class, and what follows from them."""

    parents: list[int]
    share: float
    tables: np.ndarray  # [voter, class, parent's vote]: chance of a vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of the toxic class for combinations of votes."""
        bits = (votes[:, None] >> np.arange(VOTERS)) & 1
        log = np.tile(np.log([1 - self.share, self.share]), (len(votes), 1))
        for v, parent in enumerate(self.parents):
            before = bits[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            for y in (0, 1):
                p = self.tables[v, y, before]
                log[:, y] += np.where(bits[:, v] == 1, np.log(p), np.log1p(-p))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    @staticmethod
    def fit(votes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, rounds: int = 50) -> "LabelModel":
        """Expectation maximisation over distinct combinations and their counts.

        ``labelled``, clean and toxic labelled texts of each combination, anchors the classes: together they weigh as
        much as all other texts.
        """
        bits = ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        known = labelled * (counts.sum() / max(labelled.sum(), 1))
        toxic = (known[1] + 0.01) / (known.sum(axis=0) + 0.1)
        model = None
        for _ in range(rounds):
            weights = np.stack((counts * (1 - toxic), counts * toxic)) + known
            share = float(np.clip(weights[1].sum() / max(weights.sum(), 1e-9), 1e-4, 0.5))
            joint = np.empty((2, VOTERS, VOTERS, 2, 2))
            for y in (0, 1):
                for a in (0, 1):
                    for b in (0, 1):
                        joint[y, :, :, a, b] = ((bits == a) * weights[y][:, None]).T @ (bits == b)
            parents = _tree(joint)
            tables = np.empty((VOTERS, 2, 2))
            for v, parent in enumerate(parents):
                for y in (0, 1):
                    if parent < 0:
                        tables[v, y, :] = (joint[y, v, v, 1, 1] + 0.1) / (joint[y, v, v].sum() + 0.5)
                    else:
                        own = joint[y, v, parent]
                        tables[v, y, :] = (own[1] + 0.1) / (own.sum(axis=0) + 0.5)
            model = LabelModel(parents, share, np.clip(tables, 1e-4, 1 - 1e-4))
            before, toxic = toxic, model.posterior(votes)
            if np.abs(before - toxic).max(initial=0) < 1e-4:
                break
        return model

    def accuracies(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Share of texts on which each voter agrees with the posterior."""
        toxic = self.posterior(votes)[:, None]
        bits = (votes[:, None] >> np.arange(VOTERS)) & 1
        return ((bits * toxic + (1 - bits) * (1 - toxic)) * counts[:, None]).sum(axis=0) / max(counts.sum(), 1)


def _tree(joint: np.ndarray) -> list[int]:
    """The tree over the voters with the most mutual information given the class; -1 for the root."""
    total = max(joint[:, 0, 0].sum(), 1e-9)
    p = joint / total + 1e-12
    a, b = p.sum(axis=4, keepdims=True), p.sum(axis=3, keepdims=True)
    mutual = (p * np.log(p * p.sum(axis=(3, 4), keepdims=True) / (a * b))).sum(axis=(0, 3, 4))
    parents, left = [-1] * VOTERS, set(range(1, VOTERS))
    inside = [0]
    while left:
        gain, parent, child = max((mutual[i, j], i, j) for i in inside for j in left)
        parents[child] = parent
        inside.append(child)
        left.remove(child)
    return parents


# -- classifier ---------------------------------------------------------------------------------------------------


def _fit_linear(rows: np.ndarray, entries: np.ndarray, n: int, targets: np.ndarray, weights: np.ndarray, size: int,
                rounds: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: presence of entries, full batches, adaptive steps."""
    w, b = np.zeros(size), -3.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weights = weights / weights.sum()
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, weights=w[entries], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) * weights
        gradient = np.append(np.bincount(entries, weights=error[rows], minlength=size) + decay * w, error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


@dataclass
class Scorer:
    """A linear model over presence of features (``prints``, sorted) and their amount."""

    prints: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, block: Block) -> np.ndarray:
        found = _found(block, self.prints)
        n = len(self.prints)
        z = self.bias + np.bincount(found.text, weights=self.weights[:n][found.entry], minlength=len(block.counts))
        z += ((found.amounts[:, None] >> np.arange(AMOUNTS)) & 1) @ self.weights[n:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Where there are no labels of both classes: nothing is toxic.
NOTHING_LEARNED = Scorer(np.zeros(0, np.uint64), np.zeros(AMOUNTS), -6.0)


def _known(labels: DataFrame) -> DataFrame:
    """The class of every id whose label may be learned from."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))


def _sample(docs: DataFrame, known: DataFrame, text: str, doc_id: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts of each class, by the order of a hash of their ids; equal texts once."""
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text"))
    both = texts.join(F.broadcast(chosen), F.col("__id") == chosen["id"]).where("text is not null")  # 2 * rows ids at most
    return written(both.groupBy(F.xxhash64("text").alias("key"), F.md5("text").alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "sample")


def _lexicon(learned: list[tuple[int, int, float]]) -> Lexicon:
    """The learned entries and the plain insults."""
    block = block_of([" ".join(INSULTS).encode()], ALNUM, lower=False)
    entries = {p: (0, STRICT) for p in block.words.view(np.int64).tolist()} | {p: (kind, lift) for p, kind, lift in learned}
    prints = np.array(list(entries), dtype=np.int64).view(np.uint64)
    order = np.argsort(prints)
    kinds, lifts = zip(*entries.values())
    return Lexicon(prints[order], np.array(kinds)[order], np.array(lifts)[order])


def _shown(lexicon: Lexicon, names: list[str]):
    """What the voters and the classifier see of texts, in the named columns; a label goes along."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), ALNUM, lower=True):
                rows, found = batch.slice(block.first, block.last - block.first), _found(block, lexicon.prints)
                out = {"votes": pa.array(lexicon.votes(found) | _pattern_votes(text_bytes(rows.column(0)))), "amounts": pa.array(found.amounts)}
                if "entries" in names:
                    out["entries"] = list_column(found.entry, np.bincount(found.text, minlength=len(block.counts)), pa.int32())
                    out["toxic"] = rows.column(1).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    return work


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS,
          features: int = FEATURES) -> tuple[Scorer, LabelModel | None]:
    """The classifier and the label model behind it."""
    known = _known(labels)
    sample = _sample(docs, known, text, doc_id, sample_rows)
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return NOTHING_LEARNED, None
    # what a sampled text of each class stands for among all labelled ones
    stands = np.ones(2)
    for r in known.groupBy("toxic").count().collect():
        stands[r.toxic] = max(1, r["count"] / sample_rows)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), ALNUM, lower=True):
                toxic = batch.column(1).to_numpy()[block.first : block.last]
                text_of = np.repeat(np.arange(len(block.counts)), block.counts)
                for kind, (at, prints) in enumerate(_features(block)):
                    order = np.lexsort((prints, text_of[at]))
                    p, t = prints[order], text_of[at][order]
                    new = np.ones(len(p), dtype=bool)
                    new[1:] = (p[1:] != p[:-1]) | (t[1:] != t[:-1])
                    p, t = p[new], t[new]
                    yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(np.full(len(p), kind, np.int32)), pa.array(toxic[t].astype(np.int64))], names=["print", "kind", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(listed, "print bigint, kind int, toxic bigint").groupBy("print").agg(
        F.first("kind").alias("kind"), F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # An entry must be further from chance than the best of as many features would be by luck, and much more frequent in toxic
    # texts than in clean ones. Neither rate depends on how many texts of the other class there are or were sampled.
    share = sizes[1] / (sizes[0] + sizes[1])
    both = F.col("bad") + F.col("good")
    surprise = 2 * (F.col("bad") * F.log(F.col("bad") / (both * share)) + F.col("good") * F.log(F.greatest(F.col("good"), F.lit(1)) / (both * (1 - share))))
    tried = written(counts.where(F.col("bad") + F.col("good") >= LEAST_TEXTS), "features")
    luck = 2 * float(np.log(max(tried.count(), 2)))
    lift = (F.col("bad") + 0.5) / (sizes[1] + 1) * (sizes[0] + 1) / (F.col("good") + 0.5)
    best = tried.where("bad > 0").withColumn("lift", lift).withColumn("surprise", surprise)
    best = best.where((F.col("lift") >= LOOSE) & (F.col("surprise") >= luck))
    best = best.orderBy(F.col("surprise").desc(), "print").limit(features).collect()
    lexicon = _lexicon([(r.print, r.kind, r.lift) for r in best])
    votes_of = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_shown(lexicon, ["votes"]), "votes bigint")
    combinations = votes_of.groupBy("votes").count().collect()
    seen = sample.select("text", "toxic").mapInArrow(_shown(lexicon, ["votes", "toxic", "entries", "amounts"]), "votes bigint, toxic int, entries array<int>, amounts bigint").collect()
    votes = np.array(sorted({r.votes for r in [*combinations, *seen]}), dtype=np.int64)
    counts = np.zeros(len(votes))
    counts[np.searchsorted(votes, [r.votes for r in combinations])] = [r["count"] for r in combinations]
    labelled = np.zeros((2, len(votes)))
    weight = stands[[r.toxic for r in seen]]
    np.add.at(labelled, (np.array([r.toxic for r in seen]), np.searchsorted(votes, [r.votes for r in seen])), weight)
    model = LabelModel.fit(votes, counts, labelled)
    targets = model.posterior(np.array([r.votes for r in seen]))
    size = len(lexicon.prints)
    entries = [[*r.entries, *(size + i for i in range(AMOUNTS) if r.amounts >> i & 1)] for r in seen]
    rows = np.repeat(np.arange(len(seen)), [len(e) for e in entries])
    flat = np.array([e for own in entries for e in own], dtype=np.int64)
    weights, bias = _fit_linear(rows, flat, len(seen), targets, weight, size + AMOUNTS)
    return Scorer(lexicon.prints, weights, bias), model


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic) and ``predicted`` (1 from 0.3 on).

    ``labels`` has ``doc_id`` and ``toxic`` (0 or 1; other rows are left out, of conflicting ones 1 counts). Labels of
    held-out rows are never read, and labels are no input of a score: equal texts get equal scores. Null and empty texts
    get the score of a text without any feature. Without labels of both classes every score is 0.0025. Repeated rows
    change nothing but the counts of votes; columns of ``docs`` named like a result are replaced. Options: ``sample_rows``,
    labelled texts of each class that are looked at, and ``features``.
    """
    scorer, _ = learn(docs, labels, text, doc_id, **options)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    place, size = kept.index(text), len(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(place), ALNUM, lower=True):
                rows, scores = batch.slice(block.first, block.last - block.first), scorer.scores(block)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(size)), pa.array(scores), pa.array((scores >= CUTOFF).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "score double, predicted int"])
    return plain.mapInArrow(work, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that are not predicted to be toxic, in their own columns."""
    held = docs.select(*[F.col(f"`{c}`").alias("__" + c) for c in docs.columns])
    found = score_toxicity(held, labels, "__" + text, "__" + doc_id, **options)
    return found.where("predicted = 0").select(*[F.col(f"`__{c}`").alias(c) for c in docs.columns])
