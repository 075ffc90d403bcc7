"""Quality, mixing, tokens and language against brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerlens.llm import byte_bpe, language_id, mixing, quality, token_files
from ledgerlens.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH, PATTERN = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference_encoding():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _figures(text):
    words, seen, dups, covered = WORD.findall(text or ""), set(), 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {w for w in set(windows) if len(words) < 5_000 and windows.count(w) > 1}
    for i, w in enumerate(windows):
        if w in repeated:
            covered.update((i, i + 1, i + 2))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_quality_figures_and_base_rules(hard_docs, hard_texts):
    for r in quality.judged(hard_docs).collect():
        if r["doc_id"] is None or r["doc_id"] == 74:
            continue
        want = _figures(hard_texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_label_model_learns_rules():
    rng = np.random.default_rng(0)
    truth = rng.random(40_000) < 0.8
    right_bad = (0.9, 0.6, 0.3, 0.05)
    votes = np.stack([np.where(truth, rng.random(40_000) < 0.97, rng.random(40_000) >= a) for a in right_bad], axis=1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = 2
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, good, bad = quality.fit(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05 and np.abs(good - 0.97).max() < 0.05 and np.abs(bad - right_bad).max() < 0.1
    assert ((quality.posterior(votes, prior, good, bad) >= 0.5) == truth).mean() > 0.93


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'klmno'[i % 5]}q{'rstuvw'[i // 7 % 6]}" for i in range(90))
    junk = " ".join(f"{w}$$$ ###" for w in prose.split())
    docs = spark.createDataFrame([(i, prose if i % 5 else junk) for i in range(100)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == [i for i in range(100) if i % 5]


def _targets(sizes):
    """Water-filling by repetition."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix_targets_and_quotas(hard_docs, hard_texts):
    plan = mixing.Mix(hard_docs)
    rows = hard_docs.select("doc_id", "source", "text").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want, taken = _targets(sizes), {s: 0 for s in sizes}
    source = {r["doc_id"]: r["source"] for r in rows if r["doc_id"] is not None}
    got = plan.digest().collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.Mix(hard_docs).digest().collect()), key=str)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            assert r["size"] == len(WORD.findall(hard_texts[r["doc_id"]] or ""))
            assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
            taken[source[r["doc_id"]]] += r["taken"]
    mixed = plan.mixture()
    assert mixed.columns == hard_docs.columns
    words = {}
    for r in mixed.select("source", "text").collect():
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert sum(words.values()) == sum(r["taken"] for r in got)


def test_tree_quotas_add_up(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    docs = spark.createDataFrame([(i, "w " * (5 + i % 7), f"s{i % 3 * (i % 2)}") for i in range(2000)], "doc_id long, text string, source string")
    plan = mixing.Mix(docs)
    quota = {}
    for r in plan.tree().collect():
        quota.setdefault((r["level"], r["node"]), {})[r["source"]] = r["quota"]
    depth = max(level for level, _ in quota)
    assert depth >= 4
    for (level, node), own in quota.items():
        if level < depth:
            halves = [quota.get((level + 1, 2 * node + i), {}) for i in (0, 1)]
            assert own == {s: sum(h.get(s, 0) for h in halves) for s in own}
            assert abs(sum(halves[0].values()) - sum(halves[1].values())) <= 1
    totals = plan.digest().groupBy("target", "source_size").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 11 for r in totals)


def _short_by(plan, source):
    """Words that each source misses, after a check that no undrawn document fits them."""
    rows = plan.digest().collect()
    short = {}
    for r in rows:
        short[source[r["doc_id"]]] = short.get(source[r["doc_id"]], r["target"]) - r["taken"]
    for r in rows:
        own = short[source[r["doc_id"]]]
        assert own > -1e-6
        if r["size"] and r["taken"] <= r["size"] * int(r["target"] // r["source_size"]) < 3 * r["size"]:
            assert r["size"] > own, "an undrawn document fits what is missing"
    return short


def test_mix_draws_until_nothing_fits(hard_docs):
    source = {r["doc_id"]: r["source"] for r in hard_docs.filter("doc_id IS NOT NULL").collect()}
    short = _short_by(mixing.Mix(hard_docs.filter("doc_id IS NOT NULL")), source)
    # src2 has one document of 30,000 words, more than its rest, and all others are drawn
    assert max(abs(v) for s, v in short.items() if s != "src2") <= 120


@pytest.mark.parametrize("seed", range(3))
def test_mix_fills_behind_a_very_long_document(spark, seed):
    # very long documents in several blocks of a source whose short ones can fill its rest; and equal rows
    rows = [(i, "w " * (100 + i % 4), f"s{i % 2}") for i in range(2400)] + [(5000 + i, "w " * 20_000, "s0") for i in range(4)]
    rows += [(9000, "w " * 77, "s1")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    short = _short_by(mixing.Mix(docs, seed), {r[0]: r[2] for r in rows})
    assert max(map(abs, short.values())) <= 104


def test_digest_counts_what_the_tree_deals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    docs = spark.createDataFrame([(i, "w " * (5 + i % 7), f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    plan = mixing.Mix(docs)
    whole, all_shards = plan.digest().collect(), plan.shards
    plan.shards = lambda: all_shards().filter("copy <> 1")
    less = {r["doc_id"]: r["taken"] for r in plan.digest().collect()}
    assert all(less[r["doc_id"]] == r["taken"] - min(r["size"], r["taken"]) for r in whole) and sum(r["taken"] for r in whole) > 0


def test_tokens_equal_the_tokenizer_library(hard_docs, hard_texts, reference_encoding):
    for r in byte_bpe.round_trip(hard_docs, PATH, PATTERN).collect():
        if r["doc_id"] is None:
            continue
        text = hard_texts[r["doc_id"]] or ""
        ids = reference_encoding.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    ids = byte_bpe.encoded(hard_docs, PATH, PATTERN)
    back = {r["doc_id"]: bytes(r["text"]) for r in byte_bpe.decoded(ids, PATH, PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t in hard_texts.items())


def test_matrix_heap_and_library_agree(reference_encoding, monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.choice(list(b"aeinrst"), n)).decode() for n in rng.integers(1, 300, 200)] + ["a" * 1000, "é" * 400, "ab" * 700]
    bpe = byte_bpe.ByteBPE(PATH, PATTERN)
    want = [reference_encoding.encode_ordinary(p) for p in pieces]
    assert [list(x) for x in bpe.encode_pieces([p.encode() for p in pieces])] == want
    for limit in (0, 2000):
        monkeypatch.setattr(byte_bpe, "MATRIX_BYTES", limit)
        assert [list(x) for x in bpe.encode_pieces([p.encode() for p in pieces])] == want


@pytest.mark.parametrize("block", [1 << 16, 16])
def test_token_files_are_counted(hard_docs, hard_texts, reference_encoding, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", block)
    docs = hard_docs if block > 100 else hard_docs.filter("length(text) < 3000 OR text IS NULL")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_files.token_counts(docs, PATH, PATTERN).collect()), key=str)
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted(((r["doc_id"], len(reference_encoding.encode_ordinary(r["text"] or ""))) for r in rows), key=str)


def test_open_documents_are_stitched_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 16)
    lengths = [0, 3, 40, 1, 200, 0, 7]
    ids = np.concatenate([np.array([*token_files.head_ids(i - 3 if i else None), *([5] * n), token_files.END], ">u2") for i, n in enumerate(lengths)]).astype(">u2")
    ids = np.concatenate([ids, np.full(-len(ids) % 8, token_files.FILL)]).astype(">u2")
    (tmp_path / "tokens").mkdir()
    (tmp_path / "tokens" / "part").write_bytes(ids.tobytes())
    real = spark.sparkContext.binaryRecords
    for tasks in (1, 3, 11):
        class Context:
            @staticmethod
            def binaryRecords(path, size):
                blocks = real(path, size).collect()
                return spark.sparkContext.parallelize(blocks, tasks)

        class Session:
            sparkContext = Context
            createDataFrame = staticmethod(spark.createDataFrame)

        got = {r["doc_id"]: r["n_tokens"] for r in token_files.scan(Session, str(tmp_path / "tokens")).collect()}
        assert got == {i - 3 if i else None: n for i, n in enumerate(lengths)}


def test_ids_of_any_sign_survive_the_head():
    for value in (None, 0, 1, -1, 2**63 - 1, -2**63, 123456789012):
        assert token_files.head_value(token_files.head_ids(value)) == value


def test_languages_are_told_apart(spark):
    words = {"xx": "zug ganz vogel berg wald".split(), "yy": "mer chou eau rouge petit".split(), "zz": "the king sat down here".split()}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k], 12)), k) for i, k in enumerate(list(words) * 60)]
    rows += [(1000, None, "xx"), (1001, "12 34 !!", "yy"), (1002, "Zug Ganz", None), (None, "vogel berg", "xx"), (1000, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identified(docs).collect()}
    for i, _, lang in rows[:180]:
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[1000][2:], got[1001][2:]] == [("und", 0.0), ("und", 0.0)] and got[1002]["lang_pred"] == "xx" and got[None]["held_out"] is False


def test_language_is_learned_only_from_its_own_part(spark, hard_docs):
    docs = spark.createDataFrame([(i, "abc def", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else None) for i in range(50)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identified(docs).collect()} == {"und"}
    assert language_id.identified(hard_docs).count() == hard_docs.count()


def test_empty_tables(no_docs):
    assert quality.judged(no_docs).count() == 0 == quality.keep_good(no_docs).count()
    assert mixing.Mix(no_docs).digest().count() == 0 == mixing.mix(no_docs).count()
    assert byte_bpe.round_trip(no_docs, PATH, PATTERN).count() == 0 == language_id.identified(no_docs).count()
    assert token_files.token_counts(no_docs, PATH, PATTERN).count() == 0
