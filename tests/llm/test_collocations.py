"""Phrase counts, cuts and tries against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import collocations as co
from ledgerlens.llm.phrase_trie import Trie, digits_for


def _brute(rows, least, longest, percent, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    held = {p: n for p, n in f.items() if n >= least and len(p) > 2}
    around = {}
    for (lang, *words), n in held.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                sub = (lang, *words[i:i + k])
                around[sub] = max(around.get(sub, 0), n)
    out = {}
    for p, a in held.items():
        lang, words = p[0], p[1:]
        ways = [(2000000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min(ways, key=lambda w: w[:2])
        if 100 * around.get(p, 0) < percent * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), a, l, r, total[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


@pytest.fixture(scope="module")
def wordy():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "日本", "x\x1cy", "nul\0", "ABC"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", ":", "!", "? "]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.choice([0, 1, 5, 60, 90])):
            words.append(rng.choice(["new york city hall", "of the", "a a a a", "New  York"]) if rng.random() < 0.2 else vocabulary[min(int(rng.expovariate(0.12)), 44)])
        rows.append((rng.choice(["en", "en", "de", None, "und", "x.y"]), "".join(w + rng.choice(ends) for w in words)))
    return rows + [("en", None), (None, None), ("en", ""), ("en", "the end " * 5000), ("long", "one " * 31)]


@pytest.mark.parametrize("sizes", [{}, {"CHUNK_BYTES": 3000, "SLICE_BYTES": 64, "BLOCK": 37, "FLUSH": 100}])
@pytest.mark.parametrize("top", [2000, 5])
def test_collocations_equal_counting(spark, wordy, monkeypatch, sizes, top):
    for name, value in sizes.items():
        monkeypatch.setattr(co, name, value)
    least = 30 if not sizes else 20
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, "w") for i, (lang, t) in enumerate(wordy)], "doc_id long, text string, lang string, source string, f int, id int, words string")
    got = sorted(map(tuple, co.collocations(docs, least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    want = _brute(wordy, least, 4, 80, top)
    assert got == want and len(got) > 10


def test_exact_scores_of_huge_counts(spark):
    row = spark.range(1).selectExpr("cast(9000000000000000000 as decimal(20,0)) a", "cast(18000000000000000001 as decimal(21,0)) lr")
    assert row.selectExpr("(2000000 * a) div lr").first()[0] == 2000000 * 9000000000000000000 // 18000000000000000001


@pytest.mark.parametrize("n,largest,length", [(1, 1, 1), (5, 300, 2), (3000, 90_000, 3), (20_000, 500, 2), (9000, 70_000, 4)])
def test_trie_finds_what_it_holds(n, largest, length):
    rng = np.random.default_rng(n)
    sequences = np.unique(np.minimum(rng.geometric(20 / largest if largest > 20 else 0.9, (n, length)), largest), axis=0)
    trie = Trie.unpacked(Trie.build(sequences, digits_for(largest)).packed())
    assert len(np.unique(trie.leaf)) == len(sequences)
    text = np.concatenate([sequences.ravel(), rng.integers(0, largest + 1, 5000)])
    known = {tuple(s): i for i, s in enumerate(sequences.tolist())}
    want = [(i, known[t]) for i in range(len(text) - length + 1) if (t := tuple(text[i:i + length].tolist())) in known]
    at, state = trie.walk(text)
    assert sorted(zip(at.tolist(), trie.number[state].tolist())) == want
    assert len(trie.base) < 12 * n * length * digits_for(largest) + 2000


@pytest.mark.parametrize("length", [1, 2])
def test_full_nodes(length):
    """Every byte below a node, as with vocabularies of more than 256 words."""
    numbers = np.arange(1, 2001)
    sequences = np.stack([np.roll(numbers, i) for i in range(length)], axis=1)
    trie = Trie.build(sequences, digits_for(2000))
    at, state = trie.walk(sequences.ravel())
    assert set(range(0, length * 2000, length)) <= set(at.tolist()) and len(set(trie.leaf.tolist())) == 2000
    own = at % length == 0
    assert (trie.number[state[own]] == at[own] // length).all()


def test_large_vocabulary_equals_counting(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(900)]
    rows = [("en", " ".join(rng.choice(words) if rng.random() < 0.5 else "red green blue" for _ in range(4000))) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = sorted(map(tuple, co.collocations(docs, 4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == _brute(rows, 4, 4, 80, 2000) and len(got) > 500


def test_nothing_frequent(spark, no_docs):
    assert co.collocations(no_docs).count() == 0
    rare = spark.createDataFrame([(1, "only once here", "en")], "doc_id long, text string, lang string")
    assert co.collocations(rare).count() == 0
    single = spark.createDataFrame([(1, "a. " * 50, "en")], "doc_id long, text string, lang string")
    assert co.collocations(single).count() == 0


def test_sums_and_pairs_travel_packed():
    """One line a slab for each flush, few bytes a pair; the sums of the slabs and the pairs of rich sums are exact."""
    rng = np.random.default_rng(8)
    words = np.minimum(rng.geometric(0.01, 200_000), 900)
    trie = Trie.build(np.arange(1, 901)[:, None], digits_for(900))
    sums = co.Sums(len(words), 30)
    prefix, word = words[:-1] - 1, words[1:]
    wanted = Counter(sums.of(prefix, word).tolist())
    got = Counter()
    lines = list(sums.partial(trie, 0, iter([words])))
    assert sum(b.num_rows for b in lines) <= 1 << co.SLAB_BITS
    for batch in lines:
        for slab, blob in zip(batch.column("slab").to_pylist(), batch.column("blob").to_pylist()):
            low, n = co._unpacked(blob)
            got.update(dict(zip(((slab << sums.low) + low).tolist(), n.tolist())))
    assert got == {s: min(n, 30) for s, n in wanted.items()}
    assert sum(b.nbytes for b in lines) < 4 * len(wanted)
    large = np.sort(rng.integers(0, 1 << 40, 1000))
    for column, back in zip((large, large[::-1]), co._unpacked(co._packed(large, large[::-1]))):
        assert (column == back).all()
    assert [len(c) for c in co._unpacked(co._packed(large[:0], large[:0]))] == [0, 0]
