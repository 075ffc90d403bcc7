"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter 3-gram is the product of its letters' vectors, permuted (rotated) by two, one and no
place; a text is the sum of its 3-grams (a non-letter counts as one blank, and a 3-gram has a letter in its middle); a language is the sum
of its texts. A text gets the language whose vector has the largest cosine with its own.

Sums are linear, so a task counts 3-grams first and multiplies the counts of a batch with the vectors of the 3-grams in it.
What leaves a task while learning is one vector per language, and the languages' vectors are all that is sent back: languages are
taken to be few (a label), documents may be any number.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if nothing could be learned; a null doc_id
is not held out; ties take the language that is first by code point; repeated rows are judged one by one; very long texts are read
whole; an empty table gives an empty result. Other columns, and lang in prediction, are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import pieces

DIMENSIONS, SYMBOLS, SEED, PIECE_BYTES = 1024, 64, 8, 2 << 20
HELD_OUT = 2  # of crc32 mod 4
UNKNOWN = "und"


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Symbol of every code point: 0 for non-letters, a to z, and hashed to what is left for other letters; case is folded."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    letters = letter_vectors()
    first, second, third = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return (np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]).astype(np.float32)


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 3-gram) of all 3-grams."""
    joined = "\n" + "\n\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    read = symbols()[points].astype(np.int32)
    middle = np.flatnonzero(read[1:-1]) + 1
    grams = (read[middle - 1] * SYMBOLS + read[middle]) * SYMBOLS + read[middle + 1]
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64) + 2)
    return np.searchsorted(ends, middle, side="right"), grams


def bundles(owner: np.ndarray, grams: np.ndarray, owners: int) -> np.ndarray:
    """(owners, DIMENSIONS) sums of 3-gram vectors."""
    seen = np.flatnonzero(np.bincount(grams, minlength=SYMBOLS**3))
    place = np.zeros(SYMBOLS**3, np.int64)
    place[seen] = np.arange(len(seen))
    out = np.zeros((owners, DIMENSIONS), np.float32)
    vectors = gram_vectors(seen)
    order = np.searchsorted(owner, np.arange(0, owners + 512, 512))  # owners come sorted
    for i, at in enumerate(range(0, owners, 512)):
        own = slice(order[i], order[i + 1])
        n = min(512, owners - at)
        counts = np.bincount((owner[own] - at) * len(seen) + place[grams[own]], minlength=n * len(seen))
        out[at:at + n] = counts.reshape(n, -1).astype(np.float32) @ vectors
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """One vector for each language of the documents that are not held out."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            found = [pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])]
            sums.clear()
            return found

        for batch in pieces(batches, "text", PIECE_BYTES):
            names, number = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            order = np.argsort(number, kind="stable")
            texts = batch.column("text").to_pylist()
            owner, grams = text_grams([texts[i] for i in order])
            for name, vector in zip(names, bundles(number[order][owner], grams, len(names)).astype(float)):
                sums[name] = sums.get(name, 0) + vector
            if len(sums) > 256:
                yield from flush()
        if sums:
            yield from flush()

    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    vectors = rows.mapInArrow(run, "lang string, vector array<double>")
    total = vectors.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    lines = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("vector")).collect()
    learned = {r["lang"]: np.array([x["value"] for x in r["vector"]]) for r in lines}
    return {k: v for k, v in sorted(learned.items()) if np.any(v)}


def predict(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    names = list(learned)
    profile = np.array([v / np.linalg.norm(v) for v in learned.values()]).reshape(-1, DIMENSIONS)

    def run(batches):
        for batch in pieces(batches, "text", PIECE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            owner, grams = text_grams(texts)
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = np.bincount(owner, minlength=len(texts)) > 0
            if len(names) and lettered.any():
                vectors = bundles(owner, grams, len(texts)).astype(float)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = vectors @ profile.T / np.where(norms > 0, norms, 1)[:, None]
                best = cosines.argmax(axis=1)
                scores = np.where(lettered, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
                found = [names[b] if has else UNKNOWN for b, has in zip(best.tolist(), lettered.tolist())]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return predict(docs, learn(docs))
