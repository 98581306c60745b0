"""Tokens, licences, language model, toxicity and decontamination against brute force, with odd inputs."""

import collections
import hashlib
import math
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pulsewake.llm import bpe, decontaminate, langmodel, licenses, toxicity, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\t", "a", "word " * 3000, "x" * 5000, "é" * 70, "A b\tC\x0bd", "same text", "same text"]


def frame(spark, texts, **more):
    """Texts with ids, an extra column and columns that clash with results."""
    rows = [(i, t, "extra", -1, -1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, score double")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- words --------------------------------------------------------------------------------------------------------


def test_words_of_blocks_match_the_pattern():
    import pyarrow as pa

    random.seed(1)
    texts = ["".join(random.choice("ab é\t\nZ9-,日") for _ in range(random.randint(0, 60))) for _ in range(300)] + [None, "", "y" * 300]
    for table, pattern, low in ((words.SPACED, r"[^\x20\x09-\x0D]+", False), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        seen = {}
        for block in words.blocks(pa.array(texts), table, low, size=500):
            for i, text in enumerate(texts[block.first : block.last]):
                want = re.findall(pattern, lower(text) if low else text or "")
                a, b = block.starts[i], block.starts[i + 1]
                got = [block.buffer[block.begins[j] : block.ends[j]].decode() for j in range(a, b)]
                assert got == want
                for j, word in zip(range(a, b), want):
                    assert seen.setdefault(word, block.words[j]) == block.words[j]
        assert len(set(seen.values())) == len(seen)


def test_runs_are_equal_only_for_equal_words():
    own = words.mix(np.arange(1, 2001, dtype=np.uint64) % np.uint64(3))
    for k in (1, 2, 5, 10, 35):
        by = {}
        for i, print_ in enumerate(words.runs(own, k)):
            by.setdefault(int(print_), set()).add(tuple(own[i : i + k].tolist()))
        assert all(len(v) == 1 for v in by.values())
        assert len(by) == 3


# -- encoding -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_encoding_equals_tiktoken(reference):
    own = bpe.codec(PATH, public_tokenizers.PATTERN)
    random.seed(3)
    tokens = list(own.ranks)
    for _ in range(4000):
        kind = random.random()
        if kind < 0.5:
            text = b"".join(random.choice(tokens) for _ in range(random.randint(1, 6))).decode("utf-8", "replace")
        else:
            text = "".join(random.choice("abehilnorstu éß日本 \n'.12") for _ in range(random.randint(1, 50)))
        ids = own.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_long_pieces_take_linear_time(reference):
    own = bpe.codec(PATH, public_tokenizers.PATTERN)
    for text in ("a" * 20000, "ab" * 9000, "=" * 9000, " " * 9000):
        assert own.encode(text).tolist() == reference.encode_ordinary(text)


def test_encoded_rows(spark, reference):
    texts = [*ODD, "Hello wörld, it's 2024!\n\n  done"]
    docs = frame(spark, texts).withColumnRenamed("n_words", "n_tokens")
    rows = {r.doc_id: r for r in bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert rows[i].token_ids == ids and rows[i].n_tokens == len(ids) and rows[i].lang == "extra" and rows[i].text == text
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


# -- decontamination ----------------------------------------------------------------------------------------------


def plain_matches(docs, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = collections.defaultdict(set)
    split = [(i, re.findall(pattern, lower(t))) for i, t in items]
    for item, ws in split:
        k = min(window, len(ws))
        for a in range(len(ws) - k + 1) if k else []:
            windows[tuple(ws[a : a + k])].add(item)
    out = []
    for text in docs:
        ws = re.findall(pattern, lower(text))
        hit, found, longest = set(), set(), 0
        for gram, owners in windows.items():
            for a in range(len(ws) - len(gram) + 1):
                if tuple(ws[a : a + len(gram)]) == gram:
                    hit.update(range(a, a + len(gram)))
                    found |= owners
        for _, other in split:
            for a in range(len(ws)):
                for b in range(len(other)):
                    n = 0
                    while a + n < len(ws) and b + n < len(other) and ws[a + n] == other[b + n]:
                        n += 1
                    if n >= min(window, len(other)):
                        longest = max(longest, n)
        out.append((len(ws), len(hit), sorted(str(f) for f in found if f is not None), longest))
    return out


def test_matches_against_brute_force(spark):
    random.seed(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps"]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 25)))) for i in range(12)]
    items += [(100, "Alpha, BETA!"), (None, "unique words that only this nameless item has got in its own text"), (3, items[4][1]), (7, None), (11, "é à ü")]
    texts = [" ".join(random.choice(vocabulary + ["other"]) for _ in range(random.randint(0, 80))) for _ in range(40)]
    texts += [items[5][1], "x " + items[6][1].upper() + " y", "unique words that only this nameless item has got in its own text", "é à ü", *ODD]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches(texts, items)
    for bound in (16 << 20, 300):  # in one block and in many
        rows = {r.doc_id: r for r in decontaminate.find_matches(docs, bench, item_block_bytes=bound).collect()}
        assert [(rows[i].n_words, rows[i].n_hit, rows[i].hit_items, rows[i].longest_match) for i in range(len(texts))] == want
        for i in range(len(texts)):
            assert sum(s.end - s.begin for s in rows[i].hit_spans) == rows[i].n_hit
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if w[1] == 0]
    assert decontaminate.find_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_matches(docs.limit(0), bench).count() == 0


# -- language model -----------------------------------------------------------------------------------------------


def test_backoff_scores_against_brute_force(spark):
    random.seed(9)
    texts = [" ".join(random.choice("the a cat dog sat ran on mat".split()) for _ in range(random.randint(0, 30))) for _ in range(50)] + ODD
    split = [spaced(lower(t)) for t in texts]
    ones, twos = collections.Counter(w for s in split for w in s), collections.Counter(p for s in split for p in zip(s, s[1:]))
    total, want = sum(ones.values()), []
    for s in split:
        own1, own2, score = collections.Counter(s), collections.Counter(zip(s, s[1:])), 0.0
        for i, w in enumerate(s):
            alone = max(ones[w] - own1[w], 0.5) / max(total - len(s), 1)
            pair = (s[i - 1], w) if i else None
            if pair and twos[pair] - own2[pair] > 0:
                score += math.log((twos[pair] - own2[pair]) / (ones[pair[0]] - own1[pair[0]]))
            else:
                score += math.log(alone * (0.4 if i else 1))
        want.append((len(s), score, score / len(s) if s else None))
    docs = frame(spark, texts)
    for options in ({}, {"block_bytes": 400, "bucket_words": 16}):
        rows = {r.doc_id: r for r in langmodel.backoff_scores(docs, **options).collect()}
        assert len(rows) == len(texts)
        for i, (n, total_score, mean) in enumerate(want):
            assert rows[i].n_words == n and rows[i].log_score == pytest.approx(total_score)
            assert rows[i].score == (None if mean is None else pytest.approx(mean))
    assert langmodel.backoff_scores(docs.limit(0)).count() == 0


def test_backoff_scores_of_any_order(spark):
    random.seed(10)
    texts = [" ".join(random.choice("the a cat dog sat ran on mat".split()) for _ in range(random.randint(0, 30))) for _ in range(50)] + ODD
    split = [spaced(lower(t)) for t in texts]
    grams = lambda s, n: collections.Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    docs = frame(spark, texts)
    for order in (1, 3, 4):
        everywhere = [sum((grams(s, n) for s in split), collections.Counter()) for n in range(order + 1)]
        total = sum(everywhere[1].values())

        def score(own, s, i, n):
            others = lambda g: everywhere[len(g)][g] - own[len(g)][g]
            gram = tuple(s[i - n + 1 : i + 1])
            if n == 1:
                return max(others(gram), 0.5) / max(total - len(s), 1)
            return others(gram) / others(gram[:-1]) if others(gram) > 0 else 0.4 * score(own, s, i, n - 1)

        want = []
        for s in split:
            own = [grams(s, n) for n in range(order + 1)]
            want.append(sum(math.log(score(own, s, i, min(order, i + 1))) for i in range(len(s))))
        rows = langmodel.backoff_scores(docs, block_bytes=400, bucket_words=16, order=order).collect()
        assert {r.doc_id: r.log_score for r in rows} == {i: pytest.approx(x) for i, x in enumerate(want)}


# -- licences -----------------------------------------------------------------------------------------------------


def test_licenses_of_lines(spark):
    lines = {
        "Released under the MIT License.": "MIT", "licensed under the apache license, version 2.0": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Licensed under CC BY 4.0.": "CC-BY", "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL",
    }
    texts = [f"some plain line here\n\n{line}\nand one more of them" for line in lines]
    texts += ["The driver's licence was released under bail by the general public.", "a version of this work, 2.0, is under way", *ODD]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(rows) == len(texts)
    for i, family in enumerate(lines.values()):
        assert [(x.paragraph, x.family, x.confirmed) for x in rows[i].licenses] == [(1, family, True)]
        assert rows[i].n_paragraphs == 3
    for i in range(len(lines), len(texts)):
        assert not any(x.confirmed for x in rows[i].licenses)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licenses_wrapped_over_lines(spark):
    long = [(f, t) for f in licenses.FAMILIES for t in licenses.TEMPLATES[f] if len(t) > 80]
    cases = [(f, textwrap.wrap(t, width), mark) for f, t in long for width in (30, 50, 72) for mark in ("", " * ", "# ")]
    texts = ["plain first line\nof a header\n" + "\n".join(mark + x for x in wrapped) + "\nsome more words follow here" for _, wrapped, mark in cases]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(rows) == len(texts)
    for i, (family, wrapped, _) in enumerate(cases):
        found = [(x.paragraph, x.family) for x in rows[i].licenses if x.confirmed]
        assert {f for _, f in found} == {family} and all(2 <= p < 2 + len(wrapped) for p, _ in found)
        assert rows[i].n_paragraphs == 3 + len(wrapped)


def test_license_classes_on_unseen_variants():
    filler = [f"word{i}" for i in range(200)]
    model = licenses.train([" ".join(filler[i : i + 12]) for i in range(0, 180, 3)])
    random_ = np.random.default_rng(99)
    right = total = 0
    for k, family in enumerate(licenses.FAMILIES):
        for template in licenses.TEMPLATES[family]:
            plain = licenses._words_of([template.encode()])[0].decode().split()
            best, chance, _ = model.judge(licenses._lowered(licenses._variants(plain, random_, filler, 20)))
            right += int((best == k).sum())
            total += 20
    assert right / total > 0.9
    best, _, _ = model.judge(licenses._lowered([" ".join(random_.choice(filler, 15)).encode() for _ in range(200)]))
    assert (best == licenses.NONE).all()


# -- toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_it_is_shown(spark):
    random.seed(11)
    plain = [f"w{i}" for i in range(300)]
    texts, toxic = [], []
    for i in range(900):
        ws = [random.choice(plain) for _ in range(40)]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            ws[random.randrange(40)] = "grumbl" + random.choice(["e", "ing", "er", "y"])
        texts.append(" ".join(ws))
        toxic.append(int(bad))
    docs = frame(spark, [*texts, *ODD])
    labels = spark.createDataFrame([*((i, 1, t) for i, t in enumerate(toxic)), (None, 1, 1), (3, 1, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).withColumn("held", toxicity.held_out()).collect()}
    assert len(rows) == len(texts) + len(ODD) and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(len(texts)) if rows[i].held]
    assert len(held) > 100 and sum(rows[i].predicted == toxic[i] for i in held) / len(held) > 0.98
    assert all(rows[i].predicted == 0 for i in range(len(texts), len(rows)))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows.values())


def test_toxicity_learns_from_classes_that_are_both_sampled(spark):
    random.seed(12)
    texts, toxic = [], []
    for i in range(1500):
        ws = [f"w{random.randrange(100)}" for _ in range(30)]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            ws[random.randrange(30)] = "grumbl" + random.choice(["e", "ing", "er", "y"])
        texts.append(" ".join(ws))
        toxic.append(int(bad))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    scorer, model = toxicity.learn(docs, labels, sample_rows=100)
    assert len(scorer.prints) > len(toxicity.INSULTS)
    assert model.share == pytest.approx(0.2, abs=0.03)
    rows = toxicity.score_toxicity(docs, labels, sample_rows=100).collect()
    assert sum(r.predicted == toxic[r.doc_id] for r in rows) / len(rows) > 0.98


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_never_read(spark):
    texts = [f"common words here number {i % 7} " + ("nasty nastier " if i % 5 == 0 else "") for i in range(200)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score_toxicity(docs, x).collect()} for x in (labels, other))
    assert a == b
