"""Conversation repair, importance resampling and substring dedup against plain Python on small tables with every awkward row."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from studylake.llm import conversation_repair, importance_resampling, substring_dedup

SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, place string, gone string, a string"
DOCS = "doc_id long, text string, bucket string, n long, key string, rank string"


def cheapest(rows):
    """Cost and audit over all edits, by trying them."""
    best = [(1 << 30, "")]

    def go(i, out, cost, audit):
        if cost > best[0][0] or not re.fullmatch("s?(ua)*u?", out):
            return
        for k in range(3):
            for added in itertools.product("ua", repeat=k):
                o, c, a = out + "".join(added), cost + 2 * k, audit + "I" * k
                if i == len(rows):
                    if re.fullmatch("(s?(ua)+)?", o):
                        best[0] = min(best[0], (c, a))
                    continue
                role, fault = rows[i]
                go(i + 1, o, c + 3, a + "D")
                if fault < 2:
                    go(i + 1, o + (role if role in "sua" else "#"), c + fault, a + "K")
                    for r in "ua":
                        go(i + 1, o + r, c + 2 + fault, a + "R")

    go(0, "", 0, "")
    return best[0]


def conversation(rng, n, faults=(0, 0, 0, 1, 2, 3)):
    return "".join(chr(97 + 4 * rng.choice([0, 1, 1, 2, 2, 3]) + rng.choice(faults)) for _ in range(n))


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(3)
    for _ in range(120):
        codes = conversation(rng, rng.randint(0, 5))
        assert conversation_repair.align(codes) == conversation_repair.folded(codes) == cheapest(conversation_repair.turns(codes))


def test_long_conversations_fold_to_the_same_audit(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(conversation_repair, "BLOCK", 7)
    for n in [0, 1, 6, 7, 8, 50, 90]:
        for _ in range(30):
            codes = conversation(rng, n)
            assert conversation_repair.align(codes) == conversation_repair.folded(codes)
    cost, audit = conversation_repair.align("ei" * 60_000 + "e")  # beyond the table
    assert (cost, audit[-2:]) == (2, "KI")


def repaired(rows):
    """A conversation's result, from its turns after damage in order."""
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    if not rows:
        return none | {"sha": hashlib.sha256(b"").hexdigest()}
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(SPACE)
        faults.append(3 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 1)
        seen.add((role, text))
    codes = "".join(chr(97 + 4 * (("s", "u", "a").index(role[:1]) if role[:1] in ("s", "u", "a") else 3) + f) for (_, role, _), f in zip(rows, faults, strict=True))
    cost, audit = conversation_repair.folded(codes)
    turn = [t for t, _, _ in rows if t is not None]
    out, left = [], list(rows)
    for e in audit:
        row = None if e == "I" else left.pop(0)
        if e != "D":
            out.append((e, row))
    lead = len(out) % 2
    lines = [f"{row[1] if e == 'K' else ('user', 'assistant')[(k - lead) % 2]}:{'' if e == 'I' else row[2]}" for k, (e, row) in enumerate(out)]
    return {
        "gaps": max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0,
        "blank": faults.count(3), "duplicate": faults.count(2), "truncated": faults.count(1),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)


def test_conversations_whole(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "agent", "tool", "", "User", None]), rng.choice(["Yes.", "so", " ", "", None, "Why?\n", "é!", "a.b", f"t{t}."])) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (100, None, "user", "A."), (100, 5, "assistant", "B."), (101, 3, "user", "Once."), (101, 3, "user", "Once.")]
    rows += [(102, t, ("user", "assistant")[t % 2], f"{t} " + "long " * (4000 if t == 7 else 1) + "end.") for t in range(9000)]
    rows += [(103, -(1 << 63), "user", "A."), (103, (1 << 63) - 1, "assistant", "B.")]
    got = conversation_repair.repair(conversation_repair.damage(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS))).collect()
    by_conv = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        by_conv[conv].append((turn, role, text))
    assert len(got) == len(by_conv)
    for r in got:
        turns = sorted(by_conv[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0))
        want = repaired(turns)
        want["gaps"] = min(want["gaps"], (1 << 63) - 1)
        assert {"sha": r.repaired_sha256} | {k: r[k] for k in want if k != "sha"} == want, r.conv_id


def test_no_conversations(spark):
    assert conversation_repair.repair(conversation_repair.damage(spark.createDataFrame([], TURNS))).count() == 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["An", "ble", "TH", "er", "ou9", "ça"]) + rng.choice(["sh", "nd", "re"]) + str(rng.randint(0, 50))
    passage, other = [word() for _ in range(70)], [word() for _ in range(300)]
    body = lambda n: [word() for _ in range(n)]
    rows = [(i, " ".join(body(rng.randint(0, 90)) + passage[rng.randint(0, 19) :] + body(5))) for i in range(1, 30)]
    rows += [(i, rng.choice([" ", "\n", "\t "]).join(other[: rng.choice([49, 50, 51, 200, 300])])) for i in range(30, 50)]
    rows += [(50, " ".join(["la"] * 900)), (51, "la " * 300), (52, " ".join(["la"] * 49)), (53, None), (54, ""), (55, SPACE), (None, " ".join(other)), (None, None), (56, "x" * 5000 + " " + " ".join(passage))]
    rows += [(57, "x" * 5000 + "\r" + "\x0b".join(passage)), (57, " ".join(other)), (57, " ".join(other)), (-3, " ".join(passage[5:60])), (58, " ".join(body(20_000) + other))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "b", 1, "k", "r") for i, t in texts], DOCS)


@pytest.mark.parametrize("hot", [1000, 0])
def test_repeated_windows_go(spark, docs, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    words = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for _, t in texts]
    first: dict[tuple, int] = {}
    for (i, _), w in zip(texts, words, strict=True):
        for k in range(len(w) - 49) if i is not None else ():
            window = tuple(w[k : k + 50])
            first[window] = min(i, first.get(window, i))
    want = Counter()
    for (i, _), w in zip(texts, words, strict=True):
        gone = {p for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want[(i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    assert any(x[2] for x in want) and any(x[1] > 49 and not x[2] for x in want)
    assert Counter(map(tuple, substring_dedup.drop_repeated(docs).collect())) == want


def test_windows_of_one_hash_are_compared(monkeypatch):
    """With a hash that says nothing, windows are told apart by their words."""
    import numpy as np
    import pyarrow as pa

    strings = [" ".join(f"w{(i * k) % 7}" for i in range(60)).encode() for k in (1, 2, 3, 1)]
    plain = substring_dedup.smallest(pa.array(strings, pa.binary()), np.array([5, 6, 7, 4]))
    monkeypatch.setattr(substring_dedup, "_rolling", lambda ids: np.zeros(len(ids), np.uint64))
    for a, b in zip(plain, substring_dedup.smallest(pa.array(strings, pa.binary()), np.array([5, 6, 7, 4])), strict=True):
        assert a.tolist() == b.tolist()


def test_no_documents_to_clear(spark):
    assert substring_dedup.drop_repeated(spark.createDataFrame([], DOCS)).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_resampling(spark, docs, texts):
    target = [" ".join((texts[0][1] or "").split()[:40]), None, "", "An9 élan, AND [more]"]
    source, wanted = Counter(), Counter()
    for _, t in texts:
        source.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    s, t_ = source.total(), wanted.total()
    gain = [math.floor(1000 * math.log((wanted[k] + 1) * (s + 10_000) / ((source[k] + 1) * (t_ + 10_000)))) for k in range(10_000)]
    rows = []
    for i, t in texts:
        n, found = features(t)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for percent in (5, 30, 100):
        want = Counter((*r[:4], None) for r in rows if r[4] < 20)
        want += Counter((*r[:4], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able))
        got = importance_resampling.resample(docs, spark.createDataFrame([(x, 1) for x in target], "text string, item_id long"), percent)
        assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == want


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], DOCS)
    assert importance_resampling.resample(none, docs).count() == 0
    assert importance_resampling.resample(docs, none).count() == docs.count()
