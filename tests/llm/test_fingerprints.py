"""Consistent weighted sampling against exact similarities."""

import hashlib
import math
import random
from collections import Counter

import pytest

from ledgerlens.llm import fingerprints as fp


def _likeness(a, b):
    x, y = (Counter(t.lower().replace("\t", " ").split()) for t in (a, b))
    both = sum(max(x[w], y[w]) for w in x | y)
    return sum(min(x[w], y[w]) for w in x & y) / both if both else 1.0


def _edited(text, following):
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def test_edits_and_order(spark, hard_docs, hard_texts):
    rows = fp.fingerprints(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    texts = {i: t or "" for i, t in hard_texts.items()}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    prints = {}
    for i, own in by.items():
        for r in own if i is not None else ():
            assert r["n_chars"] == len(texts[i])
            prints.setdefault(texts[i], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and all(len(r["fingerprint"]) == 16 * fp.SAMPLES for r in rows)
    first = {i: next(iter(prints[t])) for i, t in texts.items()}
    for i, t in texts.items():
        following = texts[i + 1] if i + 1 in texts else ""  # nulls come first, an empty text among them or the first text
        hashes = {r["edited_sha256"] for r in by[i]}
        if i + 1 in texts:
            assert hashlib.sha256(_edited(t, following).encode()).hexdigest() in hashes
            pairs = zip(*[[f[k:k + 16] for k in range(0, len(f), 16)] for f in (first[i], first[i + 1])])
            assert sum(a == b for a, b in pairs) / fp.SAMPLES in [pytest.approx(r["near_next"]) for r in by[i]]
    unlike = [w for w in ("a" * 5000, "one") if first[69] == w]
    assert not unlike and first[66] == first[67] == first[68] != first[69]


def test_whole_order_over_bands(spark):
    rng = random.Random(2)
    ids = sorted(rng.sample(range(-5000, 5000), 300)) + [10 ** 15, 2 ** 62]
    texts = {i: f"text {i} " * rng.randint(0, 5) + "🙂é" * rng.randint(0, 3) for i in ids}
    docs = spark.createDataFrame([(i, texts[i], 1) for i in rng.sample(ids, len(ids))], "doc_id long, text string, at int")
    got = {r["doc_id"]: r for r in fp.fingerprints(docs, 4).collect()}
    assert len(got) == len(ids)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        assert got[i]["edited_sha256"] == hashlib.sha256(_edited(texts[i], texts[j]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(texts[i])
    alone = fp.fingerprints(docs.limit(1), 4).collect()[0]
    assert alone["near_next"] == 1.0


def test_collisions_follow_similarity(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows, want = [], []
    for i in range(24):
        a = rng.choices(words, k=rng.randint(20, 200), weights=range(60, 0, -1))
        b = a[:int(len(a) * i / 24)] + rng.choices(words, k=int(len(a) * (1 - i / 24)) + i)
        rows.append((i, " ".join(a), " ".join(b)))
        want.append(_likeness(*rows[-1][1:]))
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    got = {}
    for part in range(8):  # shift the terms to get other hashes: 8 times 32 draws
        shifted = frame.selectExpr("id", f"regexp_replace(a, 'w', 'p{part}w') AS a", f"regexp_replace(b, 'w', 'p{part}w') AS b")
        for r in fp.sampled(shifted, ("id",), ("a", "b")).collect():
            got.setdefault(r["id"], []).append(sum(x == y for x, y in zip(r["first"], r["second"])) / len(r["first"]))
    errors = [sum(got[i]) / 8 - w for i, w in enumerate(want)]
    assert max(map(abs, errors)) < 4.5 * math.sqrt(0.25 / 256)
    assert abs(sum(errors) / len(errors)) < 0.02


def test_hand_computed_draws(spark):
    """The sampled term is the argmin by the formulas, recomputed in Python from the same uniforms."""
    frame = spark.createDataFrame([(0, "a a a b c", "a b b b c"), (1, "", " ")], "id long, a string, b string")
    got = {r["id"]: r for r in fp.sampled(frame, ("id",), ("a", "b"), 8).collect()}
    hashes = {}
    for w in "abc":
        one = [f"xxhash64(xxhash64(xxhash64('{w}'), 0), {k})" for k in range(8)]
        columns = [c for x in one for c in (x, f"xxhash64({x})")]
        hashes[w] = [v % 2 ** 64 for v in spark.sql(f"SELECT {', '.join(columns)}").first()]

    def u(bits, shift, width):
        return ((bits >> shift) % 2 ** width + 0.5) * 2.0 ** -width

    same = []
    for k in range(8):
        best = []
        for text in ("a a a b c", "a b b b c"):
            ways = []
            for w, n in Counter(text.split()).items():
                one, two = hashes[w][2 * k:2 * k + 2]
                r = -math.log(u(one, 0, 32) * u(one, 32, 32))
                c, b = math.log(-math.log(u(two, 0, 21) * u(two, 21, 21))), u(two, 42, 22)
                t = math.floor(math.log(n) / r + b)
                ways.append((c - r * (t - b) - r, w, t))
            best.append(min(ways)[1:])
        same.append(best[0] == best[1])
    assert [x == y for x, y in zip(got[0]["first"], got[0]["second"])] == same
    assert got[1]["first"] == got[1]["second"] and len(set(got[1]["first"])) == 1


def test_no_documents(no_docs):
    assert fp.fingerprints(no_docs).count() == 0
