"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

Texts are cut by the tokenizer's pattern. Pieces that a task has not met yet are encoded together: they are put into padded matrices
by length, every row merges its leftmost pair of the smallest rank in each round, pairs are looked up in a hash
table, and finished rows leave the matrix (compaction). Pieces of over MATRIX_BYTES would make a round too
wide and go through a heap that merges in the same order. Known pieces are kept in a dictionary of bounded size.

Defined cases: null text is empty and has no tokens (digests of the empty string); repeated rows and ids come back
one by one; an empty table gives an empty result; very long texts and pieces are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import lean_stream, pieces

MATRIX_BYTES, REMEMBERED, PIECE_BYTES = 128, 200_000, 1 << 20
NONE = np.int32(2**31 - 1)


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, tuple[int, ...]] = {}
        self._hash_pairs()

    def _hash_pairs(self) -> None:
        """Open-addressing table from (left id, right id) to the id of their concatenation."""
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slots, self.probes = self._slot(keys), 0
        while len(keys):  # each free slot takes one of the keys that ask for it, the others move on
            free = self.keys[slots] < 0
            chosen, first = np.unique(slots[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[chosen], self.values[chosen] = keys[at], values[at]
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of concatenated pairs, NONE where there is none; negative ids are padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        found = np.full(keys.shape, NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        slots = self._slot(keys[open_])
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == keys[open_]
            found[open_[hit]] = self.values[slots[hit]]
            on = ~hit & (held >= 0)
            open_, slots = open_[on], (slots[on] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return found

    def encode_pieces(self, items: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        out: list = [None] * len(items)
        by_width: dict[int, list[int]] = {}
        for i, item in enumerate(items):
            rank = self.ranks.get(item)
            if rank is not None:
                out[i] = (rank,)
            elif len(item) > MATRIX_BYTES:
                out[i] = self._by_heap(item)
            else:
                by_width.setdefault(-(-len(item) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            for at in range(0, len(rows), 16_384):
                own = rows[at:at + 16_384]
                for i, ids in zip(own, self._by_matrix([items[i] for i in own], width)):
                    out[i] = ids
        return out

    def _by_matrix(self, items: list[bytes], width: int) -> list[tuple[int, ...]]:
        padded = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in items), np.uint8).reshape(-1, width)
        length = np.array([len(x) for x in items])
        ids = np.where(np.arange(width) < length[:, None], self.single[padded], np.int32(-1)).astype(np.int32)
        ranks = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(items), width - 1)
        ranks = np.concatenate([ranks, np.full((len(items), 1), NONE)], axis=1)
        row, out, columns = np.arange(len(items)), [()] * len(items), np.arange(width)
        while len(row):
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            for r, held in zip(row[done].tolist(), ids[done].tolist()):
                out[r] = tuple(x for x in held if x >= 0)
            row, ids, ranks, at, best = row[~done], ids[~done], ranks[~done], at[~done], best[~done]
            if not len(row):
                break
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            every = np.arange(len(row))
            ids[every, at] = best
            following = np.where(at + 1 < width, ids[every, np.minimum(at + 1, width - 1)], -1)
            ranks[every, at] = self.merged(best, following)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.merged(ids[has, at[has] - 1], best[has])
        return out

    def _by_heap(self, item: bytes) -> tuple[int, ...]:
        ids = self.single[np.frombuffer(item, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            rank = pairs.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                found = pairs.get(rank << 32 | ids[after[i]])
                if found is not None:
                    heapq.heappush(heap, (found, i, rank, ids[after[i]]))
            if before[i] >= 0:
                found = pairs.get(ids[before[i]] << 32 | rank)
                if found is not None:
                    heapq.heappush(heap, (found, before[i], ids[before[i]], rank))
        return tuple(x for x in ids if x >= 0)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self.pattern.findall(text) for text in texts]
        known = self.known
        fresh = list(set().union(*cut).difference(known)) if cut else []
        if len(known) + len(fresh) > REMEMBERED and known:
            known.clear()
            fresh = list(set().union(*cut))
        known.update(zip(fresh, self.encode_pieces([x.encode("utf-8") for x in fresh])))
        return [list(chain.from_iterable(map(known.__getitem__, parts))) for parts in cut]

    def encode_each(self, batches, column: str):
        """(batch, ids of each text) for pieces of Arrow batches; the dictionary lives as long as a task, as Python workers are used again."""
        try:
            for batch in pieces(batches, column, PIECE_BYTES):
                yield batch, self.encode(batch.column(column).to_pylist())
        finally:
            self.known.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text)."""

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch, found in bpe.encode_each(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(lean_stream(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) bytes of every row of (doc_id, ids)."""

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            found = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(lean_stream(run), "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text is encoded and its ids decoded again, in one pass."""

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch, found in bpe.encode_each(batches, "text"):
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(ids) for ids in found], pa.int64()),
                 pa.array([hashlib.sha256(bpe.joined(ids).encode()).hexdigest() for ids in found], pa.string()),
                 pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(lean_stream(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
