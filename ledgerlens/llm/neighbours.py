"""Nearest neighbours by inner product with randomly rotated one-bit codes (RaBitQ; Gao and Long, 2024).

Index: vectors are dealt to blocks by a hash. In a block, a vector's residual from the block's mean is rotated by a random
orthogonal matrix and kept as one sign bit per dimension, packed to 64-bit words, with its length and the inner product f of the unit residual
with its code. Search: for a query q, <q, x> = <q, mean> + length * <q, residual / length>; the last factor is estimated by <code, rotated q> / f. The rotated query
is rounded to PLANES bits a dimension, so that inner product is a weighted sum of population counts of the code and one bit plane of the query at a time.
The estimate's error has a standard deviation of about |q| * sqrt((1 - f * f) / (f * f)) / sqrt(dimensions - 1), a bound is CONFIDENCE times that.

Passes over more and more blocks choose what is reranked by the exact inner product in double precision. The first reranks the k best estimates of one block; the k-th
best exact score that a query has so far is its floor. Every further pass reads about three times the blocks read before, reranks the vectors whose upper bound reaches the
floor and sends those on whose exact score reaches it: about 3 * k for each query, so what is sent grows with the queries and the logarithm of the rows, not with queries times blocks.
A block is scanned once, the first one twice. Vectors that belong to the k nearest are lost only where an estimate is off by more than its bound, so recall is a little below 1 (README has figures).

A stated query set is searched against all rows, in blocks: every pair of a query block and an index block is one group of bounded size,
at most the k best per query and block leave it, and a window merges them after each pass.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components takes no part, nor does a null id; vectors are compared with those
of the same number of dimensions; of rows that repeat an id one takes part (the smallest array); equal scores go to the smaller id; fewer than k
candidates are all returned; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import parts_for
from ledgerlens.session import materialize

BLOCK, QUERY_BLOCK, CONFIDENCE, PLANES, SEED = 4096, 4096, 2.0, 6, 6


@lru_cache(maxsize=4)
def rotation(dimensions: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))[0]


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vector, dimensions) of the rows that take part, one for each id."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & e.isNotNull() & sound)
    return rows.groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(e).cast("array<double>").alias("vector")).withColumn("dimensions", F.size("vector"))


def _matrix(held: pa.Table, column: str) -> np.ndarray:
    values = held.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    padded[:, :bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def build(rows: DataFrame, count: int) -> DataFrame:
    """The index: one line per block with ids, codes, lengths, factors, mean and vectors."""
    blocks = parts_for(count, BLOCK)

    def encode(held: pa.Table) -> pa.Table:
        order = np.argsort(held.column("id").to_numpy())
        ids, x = held.column("id").to_numpy()[order], _matrix(held, "vector")[order]
        mean = x.mean(axis=0)
        residual = (x - mean) @ rotation(x.shape[1])
        length = np.linalg.norm(residual, axis=1)
        factor = np.abs(residual).sum(axis=1) / np.sqrt(x.shape[1]) / np.where(length > 0, length, 1)
        line = {
            "block": held.column("block")[0], "dimensions": held.column("dimensions")[0],
            "ids": ids.astype("<i8").tobytes(), "codes": _words(residual > 0).tobytes(),
            "lengths": length.astype("<f8").tobytes(), "factors": factor.astype("<f8").tobytes(),
            "mean": mean.astype("<f8").tobytes(), "vectors": x.astype("<f8").tobytes(),
        }
        return pa.table({k: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v]) for k, v in line.items()}).cast(INDEX)

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block", "dimensions").applyInArrow(
        encode, "block int, dimensions int, ids binary, codes binary, lengths binary, factors binary, mean binary, vectors binary")


INDEX = pa.schema([("block", pa.int32()), ("dimensions", pa.int32()), *[(n, pa.binary()) for n in ("ids", "codes", "lengths", "factors", "mean", "vectors")]])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def estimates(line: dict, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error bound) of the inner product of each query with each vector of a block, from the packed codes alone."""
    d = line["dimensions"]
    length, factor = np.frombuffer(line["lengths"], "<f8"), np.frombuffer(line["factors"], "<f8")
    codes = np.frombuffer(line["codes"], np.uint64).reshape(len(length), -1)
    mean, known = np.frombuffer(line["mean"], "<f8"), length > 0
    safe = np.where(known, factor, 1)
    turned = q @ rotation(d)
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-300) / (2**PLANES - 1)
    level = np.rint((turned - low) / step).astype(np.int64)
    set_bits = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    weighted = np.zeros((len(q), len(codes)), np.int32)
    for plane in range(PLANES):
        words = _words((level >> plane & 1).astype(bool))
        for w in range(codes.shape[1]):
            weighted += np.bitwise_count(codes[None, :, w] & words[:, w, None]).astype(np.int32) << plane
    inside = weighted * step + low * set_bits  # sum of the rotated query over the set bits
    scale = np.where(known, length / safe / np.sqrt(d), 0)
    estimate = (2 * inside - turned.sum(axis=1, keepdims=True)) * scale + (q @ mean)[:, None]
    by_code = np.where(known, length * np.sqrt(np.maximum(0, 1 - safe**2)) / safe, 0) / np.sqrt(max(1, d - 1))
    by_rounding = step / np.sqrt(3) * np.sqrt(d) * scale
    return estimate, CONFIDENCE * (np.linalg.norm(q, axis=1)[:, None] * by_code + by_rounding)


def scan(line: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
    """(query id, vector ids, scores): up to k vectors of one block for each query.

    Without floors, the k best estimates; with them, the k best of the vectors whose upper bound and then exact score reach the query's floor.
    """
    ids, vectors = np.frombuffer(line["ids"], "<i8"), np.frombuffer(line["vectors"], "<f8").reshape(-1, line["dimensions"])
    for at in range(0, len(queries), 64):
        q, names = queries[at:at + 64], query_ids[at:at + 64]
        estimate, error = estimates(line, q)
        estimate[names[:, None] == ids[None, :]] = -np.inf
        for i in range(len(q)):
            if floors is None:
                rows = np.argpartition(-estimate[i], k - 1)[:k] if len(ids) > k else np.arange(len(ids))
            else:
                rows = np.flatnonzero(estimate[i] + error[i] >= floors[at + i])
            rows = rows[estimate[i][rows] > -np.inf]  # not the query itself
            score = (vectors[rows] * q[i]).sum(axis=1)  # each row by itself, so equal vectors score alike
            if floors is not None:
                rows, score = rows[score >= floors[at + i]], score[score >= floors[at + i]]
            best = np.lexsort((ids[rows], -score))[:k]
            yield names[i], ids[rows[best]], score[best]


def passes(blocks: int) -> list[tuple[int, int]]:
    """(first block, end) of every pass. The first has no floors to go by, so its block is scanned again with the next three."""
    out, end = [(0, 1)], 0
    while end < blocks:
        out.append((end, min(blocks, max(4, 4 * end))))
        end = out[-1][1]
    return out


def nearest(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id is divisible by `every`."""
    rows = materialize(usable(vectors), "vectors")
    count, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, query_blocks = parts_for(count, BLOCK), parts_for(asked, QUERY_BLOCK)
    index = materialize(build(rows, count), "vector-index")
    queries = rows.filter(F.col("id") % every == 0).withColumn("query_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int"))

    def numbers(low: int, end: int) -> Column:
        return F.explode(F.sequence(F.lit(low), F.lit(end - 1)))

    def search(lines: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if lines.num_rows and asked.num_rows:
            floors = asked.column("floor").to_numpy() if "floor" in asked.column_names else None
            found = scan(lines.to_pylist()[0], asked.column("id").to_numpy(), _matrix(asked, "vector"), k, floors)
            out += [(np.full(len(i), q), i, s) for q, i, s in found]
        return pa.table([np.concatenate(c) for c in zip(*out)], names=FOUND.names).cast(FOUND)

    keys = ["block", "query_block", "dimensions"]
    schema = "query_id long, vec_id long, score double"
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)

    best = None
    for low, end in passes(blocks):
        asked = queries
        if best is not None:
            floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            asked = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        left = index.filter(F.col("block").between(low, end - 1)).withColumn("query_block", numbers(0, query_blocks))
        found = left.groupBy(*keys).cogroup(asked.withColumn("block", numbers(low, end)).groupBy(*keys)).applyInArrow(search, schema)
        best = materialize(merged(found if best is None else best.drop("rank").unionByName(found).distinct()), "best-neighbours")
    return best.select("query_id", "rank", "vec_id", "score")
