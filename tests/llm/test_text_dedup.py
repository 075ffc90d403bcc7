"""SimHash and suffix arrays against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash, suffix_dedup
from ledgerlens.llm import suffix_levels as sl


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    ids = sorted(prints, key=lambda i: (i is None, i))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_masks_leave_no_pair_out():
    masks = [m % 2**64 for m in simhash.covering_masks()]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("bucket", [32, 1])
def test_groups_equal_brute_force(hard_docs, hard_texts, bucket):
    got = simhash.near_duplicates(hard_docs, bucket).collect()
    want = {i: _fingerprint(t) for i, t in hard_texts.items()}
    component = _components(want)
    assert len(got) == hard_docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']]:016x}", component[r["doc_id"]])


def test_near_prints_are_linked_in_full_buckets(spark):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    frame = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    for bucket in (1, 8, 10_000):
        found = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame, bucket).collect()}
        assert all((a ^ b).bit_count() <= 2 for a, b in found)
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in found:
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert {p: find(p) for p in prints} == _components({p: p for p in prints})


def test_one_document_of_a_group_stays(hard_docs, hard_texts):
    kept = [r["doc_id"] for r in simhash.keep_one(hard_docs).collect()]
    component = _components({i: _fingerprint(t) for i, t in hard_texts.items()})
    assert sorted(i for i in kept if i is not None) == sorted(set(component.values())) and None not in kept
    nameless = hard_docs.filter("doc_id IN (0, 4, 66) OR doc_id IS NULL").selectExpr("CASE WHEN doc_id = 4 THEN doc_id END AS doc_id", "text")
    assert simhash.keep_one(nameless).count() == 4  # texts 0, 4 and 5 and the empty ones
    assert simhash.keep_one(hard_docs).columns == hard_docs.columns


def _removed(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], i)
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49) if i is not None else ():
            if first[t[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        yield i, t, gone


def _digest(rows):
    for i, t, gone in _removed(rows):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        yield i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def _by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("sizes", [{}, {"BATCH_BYTES": 20_000, "PART_BYTES": 30_000, "ENTRY_BATCH": 50, "PIECE_BYTES": 700}])
def test_removals_equal_brute_force(hard_docs, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in hard_docs.select("doc_id", "text").collect()]
    assert _by_id(suffix_dedup.removals(hard_docs).collect()) == _by_id(_digest(rows))


def test_cut_text_keeps_columns_and_whole_characters(hard_docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in hard_docs.select("doc_id", "text").collect()]
    want = [(i, bytes(b for b, g in zip(t, gone) if not g).decode(errors="ignore")) for i, t, gone in _removed(rows)]
    got = suffix_dedup.cut_repeats(hard_docs)
    assert got.columns == hard_docs.columns and got.schema["size"].dataType == hard_docs.schema["size"].dataType
    assert _by_id(got.select("doc_id", "text").collect()) == _by_id(want)
    held = {r["doc_id"]: (r["lang"], r["source"], r["size"]) for r in hard_docs.collect()}
    assert all(held[r["doc_id"]] == (r["lang"], r["source"], r["size"]) for r in got.collect() if r["doc_id"] is not None)


def test_common_strings_only_move_anchors(hard_texts):
    data = "".join(t or "" for t in hard_texts.values()).encode()[:20_000]
    text = np.frombuffer(data + bytes(200), np.uint8)
    hashes = sl.gram_hashes(text, len(data))
    ends, starts = np.array([len(data)]), np.array([0])
    for common in (None, np.unique(hashes[::3])):
        first, last, anchor = sl.runs(hashes, ends, starts, common)
        assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all()
        assert ((anchor >= last) & (anchor <= first + sl.REACH)).all()


def test_partitions_of_a_batch_cost_little(monkeypatch):
    rng = np.random.default_rng(1)
    n, calls = 4000, []
    left, right = rng.integers(0, sl.REACH + 1, n), rng.integers(sl.SPAN, sl.SPAN + 1, n)
    matrix = rng.integers(1, 250, (n, sl.WIDTH), dtype=np.uint8) * sl.inside(left, right)
    row, start = np.sort(rng.integers(0, 300, n)), rng.integers(0, 9000, n)
    unique = np.unique
    monkeypatch.setattr(suffix_dedup.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    out = {"part": [], "batch": [], "covered": [], "blob": []}
    part = rng.integers(0, 900, n).astype(np.int32)
    suffix_dedup._collapse(out, 7, part, row, start, left, right, matrix, row + 10_000)
    monkeypatch.undo()
    assert len(calls) < 5 and len(out["blob"]) == len(unique(part))  # what is not a plain slice is done once for all partitions
    got = []
    for p, blob in zip(out["part"], out["blob"]):
        users, first, index, at, l, r, text = suffix_dedup._unpacked(blob, "u4", "i8", "u4", "u4", "u1", "u1", "u1")
        cuts = np.cumsum(l.astype(int) + r)[:-1]
        got += [(p, u, f, a, x, y, t.tobytes()) for u, f, a, x, y, t in zip(users[index], first[index], at, l, r, np.split(text, cuts))]
    want = [(p, w, w + 10_000, a, x, y, m[sl.REACH - x:sl.REACH + y].tobytes()) for p, w, a, x, y, m in zip(part, row, start, left, right, matrix)]
    assert sorted(got) == sorted(want)


def test_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family = sl.Family()
    for i in range(13):
        family.add(rng.integers(1, 250, (64, sl.WIDTH), dtype=np.uint8), np.full(64, 20, np.uint8), np.full(64, 50, np.uint8), np.full(64, i))
    assert [len(level) for level in family.levels] == [512, 256, 64]


def test_empty_tables(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 == simhash.keep_one(no_docs).count()
    assert suffix_dedup.removals(no_docs).count() == 0 == suffix_dedup.cut_repeats(no_docs).count()
