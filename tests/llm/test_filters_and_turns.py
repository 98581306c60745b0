"""Filter audit and conversation repair against brute force, with odd inputs."""

import binascii
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from pulsewake.llm import audit, conversations

SPACED = r"[^\x20\x09-\x0D]+"


# -- filter audit -------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """``docs``: id, text, source; every order applied document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    failed = []
    for i, text, source in docs:
        text = text or ""
        ws = re.findall(SPACED, text)
        own = set()
        own |= {"A"} if len(ws) < 200 else set()
        own |= {"B"} if 100 * len(set(ws)) < 50 * len(ws) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        failed.append((i, source or "", own))
    out = []
    for part in {p for _, p, _ in failed}:
        rows = [(i, f) for i, p, f in failed if p == part]
        removed = {x: 0 for x in "ABCDE"}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed[x] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == {x} for _, f in rows),
                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        for row in out:
            if row[0] == part:
                row.append(removed[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def audited(spark, docs, labels):
    rows = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, source string, n int, h string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(audit.combinations(audit.failures(rows), marks), "ABCDE")
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def some_documents():
    random.seed(5)
    texts = [" ".join(random.choice(["a", "B", "word", "x#", "É", "日本"]) + str(random.randint(0, n)) for _ in range(m)) for n in (2, 90, 900) for m in (3, 199, 200, 260)]
    texts += [None, "", " \n", "UPPER", "word " * 30_000, "100% " * 250, "x" * 10_000]
    docs = [(random.randint(0, 60), random.choice(texts), random.choice([None, "", "a", "b"])) for _ in range(150)]
    docs += [(None, texts[0], "a"), (None, texts[0], "a"), docs[0], docs[0], (10 ** 15, "UPPER", "only")]
    labels = [(random.choice([None, *range(70)]), random.choice([None, 0, 1]), random.choice([None, 0, 1])) for _ in range(120)]
    return docs, labels


def test_audit_against_brute_force(spark):
    docs, labels = some_documents()
    assert audited(spark, docs, labels) == plain_audit(docs, labels)
    assert audited(spark, docs[:1], []) == plain_audit(docs[:1], [])
    assert audited(spark, [], labels) == []


def test_audit_salts_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(audit, "HOT_ROWS", 3)
    docs, labels = some_documents()
    docs += [(i, "the same text", "a") for i in range(200)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, "ab")], "id long, body string").withColumn("site", F.lit("s"))
    failed = audit.failures(rows, "id", "body", "site", {"X": lambda t, ws: t.contains("a"), "Y": lambda t, ws: t.contains("b")})
    assert sorted((r.id, r.mask) for r in failed.collect()) == [(1, 1), (2, 2), (3, 5), (4, 3)]
    counts = audit.combinations(failed, spark.createDataFrame([(3, 1, 0)], "id long, quality int, toxic int"), "id")
    found = {(r.filter_order, r.step): r for r in audit.audit(counts, "XYZ").collect()}
    assert found["XYZ", 1].removed == 3 and found["XYZ", 2].removed == 1 and found["XYZ", 2].redundant == 1 and found["ZXY", 1].good_lost == 1
    assert found["XYZ", 1].shapley == 6 + 3 + 3 and found["ZYX", 1].shapley == 3


# -- conversations ------------------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = binascii.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def in_order(rows):
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}:{t}".encode()).digest()
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), digest(x[2], x[3])))


def plain_repair(rows):
    """Rows of one conversation in order: counts, and the least edits by trying all, place after place."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        if not re.search(SPACED, text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    asks = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def with_inserts(states):
        for _ in range(3):
            for q, (cost, letters, said) in list(states.items()):
                new = (cost + 3, letters + "I", (*said, ("user" if asks[q] == "u" else "assistant", "")))
                states[asks[q]] = min(states.get(asks[q], new), new)
        return states

    for (_, _, role, text), fault in zip(rows, faults):
        states, best = with_inserts(dict(best)), {}
        for q, (cost, letters, said) in states.items():
            options = [(q, cost + 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if role[:1] and (asks[q] == role[:1] or (q == "" and role[:1] == "s")):
                    options.append((role[:1], cost + extra, "K", ((role, text),)))
                options.append((asks[q], cost + 3 + extra, "R", (("user" if asks[q] == "u" else "assistant", text),)))
            for then, c, x, new in options:
                option = (c, letters + x, said + new)
                best[then] = min(best.get(then, option), option)
    states = with_inserts(dict(best))
    cost, letters, said = min(states[q] for q in ("", "a") if q in states)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    joined = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(joined.encode()).hexdigest()), said


def some_turns(seed, n):
    random.seed(seed)
    rows = []
    for conv in [None, *range(n)]:
        length = random.choice([0, 1, 2, 3, 5, 8, 13])
        for t in range(length):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"])
            if random.random() < 0.6:
                role = ["user", "assistant"][t % 2]
            text = random.choice(["Yes.", "No", "Why?", "", " \t", None, "Right! ", f"text {t}.", f"line {t}\nnext", "é" * 50 + "."])
            rows.append((conv, random.choice([t, t, t, t + 1, 3 * t, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, seg string, kind int")


def wanted(rows, ids):
    damaged = plain_damage(rows)
    return {c: plain_repair(in_order([r for r in damaged if r[0] == c]))[0] for c in ids}


@pytest.mark.parametrize("segment", [1, 2, 4096])
def test_repair_against_brute_force(spark, segment):
    rows = some_turns(segment, 150)
    original = frame(spark, rows)
    found = conversations.audit(conversations.damaged(original), ids=original, segment=segment).collect()
    want = wanted(rows, {r[0] for r in rows})
    assert len(found) == len(want)
    assert {r.conv_id: tuple(r[1:]) for r in found} == want


def test_long_conversations(spark):
    random.seed(3)
    rows = [(1, i, "user", f"said {i}.") for i in range(3000)] + [(2, i, ["user", "assistant"][i % 2], "the same.") for i in range(3000)]
    rows += [(3, i, random.choice(["system", "user", "assistant"]), f"{i}" + random.choice(["", "."])) for i in range(3000)]
    rows += [(4, 0, "user", "very long. " * 50_000), (4, 1, "assistant", "short")]
    rows += [(5, i, ["user", "assistant"][i % 2], "") for i in range(40)]
    original = frame(spark, rows)
    want = wanted(rows, {1, 2, 3, 4, 5})
    for segment in (100, conversations.SEGMENT):
        found = conversations.audit(conversations.damaged(original), ids=original, segment=segment).collect()
        assert {r.conv_id: tuple(r[1:]) for r in found} == want


def test_repaired_turns(spark):
    rows = [r for r in some_turns(11, 60) if r[2] is not None and r[3] is not None]
    found = conversations.repaired(frame(spark, rows)).collect()
    for conv in {r[0] for r in rows}:
        said = plain_repair(in_order([r for r in rows if r[0] == conv]))[1]
        own = sorted((r.place, r.role, r.text) for r in found if r.conv_id == conv)
        assert own == [(i + 1, role, text) for i, (role, text) in enumerate(said)]


def test_text_ids_and_empty_tables(spark):
    rows = frame(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]).withColumn("conv_id", F.lit("a"))
    assert [tuple(r)[:8] for r in conversations.audit(rows).collect()] == [("a", 0, 0, 0, 0, 0, 0, "KK")]
    assert conversations.audit(frame(spark, [])).collect() == []
    alone = conversations.audit(frame(spark, []), ids=frame(spark, [(7, 0, "user", "Hi.")])).collect()
    assert [tuple(r) for r in alone] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_powers_equal_steps():
    random.seed(1)
    for symbol in range(9):
        v = (0, 6, 3, 0)
        for n in range(1, 70):
            v = conversations.apply(conversations.power(symbol, 0), v)
            assert conversations.over_run(symbol, n, (0, 6, 3, 0)) == v
            assert conversations.apply(conversations.run_matrix(symbol, n), (0, 6, 3, 0)) == v
