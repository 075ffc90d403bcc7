"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A fingerprint bit is set where more than half of the 3-word shingles' XXH64 values have it. Pairs within
RADIUS bits are found with the structured masks of covering LSH (Pagh, 2016): every bit position gets a
non-zero vector of RADIUS + 1 bits, and there is one mask for every non-zero vector v, which keeps the positions whose
vector is not orthogonal to v. The vectors of the at most RADIUS positions in which two fingerprints differ leave some v
orthogonal to all of them, so that mask drops these positions and the pair meets in its table: no pair is
missed, with 2 ** (RADIUS + 1) - 1 tables.

Distinct fingerprints are hashed, not documents, so copies never meet. A bucket of up to BUCKET fingerprints is
compared in place. A fuller one is not compared pair by pair: its fingerprints are keyed by all values at
distance 0 or 1, two of them share a key exactly when they differ in at most 2 bits, and a key has at most
65 of them. Both ways give the same links; groups are then contracted by connected_components.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null doc_id is
grouped by its text and never names a component unless no member has an id (then component_id is null);
repeated rows each come back; ties take the smallest doc_id; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, lean_stream
from ledgerlens.operators.components import connected_components
from ledgerlens.session import materialize

SEED, SHINGLE, RADIUS, BITS, BUCKET = 42, 3, 2, 64, 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """SimHash of one text, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[: -SHINGLE])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:])]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(octets), 65_536):  # long texts in bounded pieces
        ones += np.unpackbits(octets[at:at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of every row of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

    text = as_bytes("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(lean_stream(run), "doc_id long, text_hash long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector v of radius + 1 bits, as signed numbers; position i has vector 1 + i mod (2 ** (radius + 1) - 1)."""
    vectors = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return [m - 2 ** bits if m >> (bits - 1) else m for m in masks]


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between fingerprints of a written one-column table `fp`, enough to connect all pairs within RADIUS bits.

    Every returned pair is within RADIUS; in full buckets each fingerprint is linked to the smallest one of a key.
    """
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks()])).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").count().filter("count > 1")
    members = keyed.join(sizes, ["mask", "key"])
    pairs = (
        members.filter(F.col("count") <= bucket)
        .groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("held"))
        .select(F.explode(F.expr(
            "flatten(transform(held, (x, i) -> transform(filter(slice(held, i + 2, size(held)),"
            f" y -> bit_count(x ^ y) <= {RADIUS}), y -> struct(x AS a, y AS b))))")).alias("pair"))
        .select("pair.a", "pair.b")
    )
    balls = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)]]
    full = members.filter(F.col("count") > bucket).select("fp").distinct()
    near = (
        full.select("fp", F.explode(F.array(*balls)).alias("key"))
        .groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("held"))  # at most 65 of them
        .filter(F.size("held") > 1)
        .select(F.col("held")[0].alias("a"), F.explode(F.slice("held", 2, BITS + 1)).alias("b"))
    )
    return pairs.unionByName(near).distinct()


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, group, text_hash) of every row: documents within RADIUS bits share a component, transitively.

    group is the smallest fingerprint of the component, which also names components without an id.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    members, _ = connected_components(links(groups.select("fp"), bucket))
    joined = groups.join(members.withColumnRenamed("node", "fp"), "fp", "left")
    linked = joined.filter("component IS NOT NULL")
    roots = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(
        linked.join(roots, "component").select("fp", "component_id", F.col("component").alias("group"))
        .unionByName(joined.filter("component IS NULL").select("fp", F.col("first_id").alias("component_id"), F.col("fp").alias("group"))),
        "fingerprint-components",
    )
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of one document of each near-duplicate group: the one that names it. Columns stay as they are.

    Where an id is repeated or null, one row of the group stays, of the text with the smallest hash. The copies are
    fewer than the documents, so it is their ids that meet the texts.
    """
    found = near_duplicates(docs)
    odd = materialize(found.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__odd_id")), "repeated-ids")
    is_odd = F.col("doc_id").eqNullSafe(F.col("__odd_id"))
    copies = found.join(odd, is_odd, "left_anti").filter(F.col("doc_id") != F.col("component_id"))
    copies = materialize(copies.select(F.col("doc_id").alias("__copy_id")), "copies")
    is_copy = F.col("doc_id") == F.col("__copy_id")
    if odd.isEmpty():
        return docs.join(copies, is_copy, "left_anti")
    chosen = (
        found.join(odd, is_odd, "left_semi").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("group", F.col("doc_id").alias("__kept_id")).agg(F.min("text_hash").alias("__kept_hash")).drop("group"))
    is_chosen = F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.xxhash64(as_bytes("text")) == F.col("__kept_hash"))
    again = docs.join(chosen, is_chosen).dropDuplicates(["__kept_id", "__kept_hash"]).drop("__kept_id", "__kept_hash")
    return docs.join(odd, is_odd, "left_anti").join(copies, is_copy, "left_anti").unionByName(again)
