"""Token counts of documents from flat token files without an index, by a vectorised separator scan.

Files are 16-bit big-endian ids one after the other. A document is HEAD ids that spell its doc_id, its tokens, and END; FILL pads. Neither
END nor FILL is a vocabulary id. Spark writes the files (fixed blocks of BLOCK_BYTES, whose last id, FILL, is the text writer's line separator), so they go
to any store that Spark writes to, and reads them as fixed-length blocks, so a file of any size is read by many tasks.

scan(): a task searches its blocks for END with one vectorised comparison per block, and cumulative sums of the ids that
are no FILL give the lengths of the documents between them; what is open at a block's end is carried to the next. A document that is open
at a task's end is stitched over tasks by a prefix scan over one summary line per task: the number of tasks with an END before names the document, the lengths add up.

Defined cases: null and empty texts have 0 tokens; a null doc_id comes back as null; repeated rows come back one by one; very long documents may span
any number of blocks and tasks; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import tokenizer
from ledgerlens.session import work_dir

BLOCK_BYTES = 1 << 16
END, FILL, FILL_TEXT = 0xC480, 0xC481, "ā"  # FILL_TEXT in UTF-8 is FILL in big-endian order
HEAD, DIGIT_BITS = 6, 13


def head_ids(doc_id: int | None) -> list[int]:
    """0 and 13-bit digits of the id, or 1 and zeros for null."""
    if doc_id is None:
        return [1] + [0] * (HEAD - 1)
    value = doc_id % 2**64
    return [0, *(value >> DIGIT_BITS * i & (1 << DIGIT_BITS) - 1 for i in range(HEAD - 1))]


def head_value(ids) -> int | None:
    if ids[0] == 1:
        return None
    value = sum(int(v) << DIGIT_BITS * i for i, v in enumerate(ids[1:HEAD]))
    return value - 2**64 if value >> 63 else value


def write(docs: DataFrame, folder: str, path: str, pattern: str) -> None:
    """Encode every text and write the ids as flat files."""
    room = BLOCK_BYTES // 2 - 1

    def run(batches):
        bpe, held = tokenizer(path, pattern), np.zeros(0, np.uint16)
        for batch, found in bpe.encode_each(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found):
                held = np.concatenate([held, np.array([*head_ids(doc_id), *ids, END], np.uint16)])
                whole = len(held) // room * room
                if whole:
                    yield pa.record_batch([pa.array([b.tobytes() for b in held[:whole].astype(">u2").reshape(-1, room)], pa.binary())], ["block"])
                    held = held[whole:]
        if len(held):
            held = np.concatenate([held, np.full(room - len(held), FILL, np.uint16)])
            yield pa.record_batch([pa.array([held.astype(">u2").tobytes()], pa.binary())], ["block"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = rows.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", FILL_TEXT).option("compression", "none").text(folder)


def _scanned(number: int, blocks):
    """(task, doc_id, n_tokens, open_ids, open_count, kind) of one task's blocks: kind 0 is a whole document, 1 what precedes the first END, 2 what follows the last END."""
    start = np.zeros(0, np.int64)  # the first ids of what is open
    length, closed = 0, False
    for block in blocks:
        ids = np.frombuffer(block, ">u2").astype(np.int64)
        ids = ids[ids != FILL]
        ends = np.flatnonzero(ids == END)
        begins = np.append(0, ends + 1)
        if len(ends):
            lengths = ends - begins[:-1]
            lengths[0] += length
            first = np.concatenate([start, ids[:min(ends[0], HEAD)]])[:HEAD]
            if not closed:
                yield number, None, None, first.tolist(), int(lengths[0]), 1
            else:
                yield number, head_value(first), int(lengths[0]) - HEAD, None, None, 0
            for begin, n in zip(begins[1:-1].tolist(), lengths[1:].tolist()):
                yield number, head_value(ids[begin:begin + HEAD]), n - HEAD, None, None, 0
            start, length, closed = ids[begins[-1]:begins[-1] + HEAD], len(ids) - int(begins[-1]), True
        else:
            start, length = np.concatenate([start, ids[:HEAD]])[:HEAD], length + len(ids)
    yield number, None, None, start.tolist(), length, 2 if closed else 3


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n_tokens) of every document in the files of a folder."""
    schema = "task int, doc_id long, n_tokens long, open_ids array<long>, open_count long, kind int"
    blocks = spark.sparkContext.binaryRecords(folder, BLOCK_BYTES)
    rows = spark.createDataFrame(blocks.mapPartitionsWithIndex(_scanned), schema)
    whole = rows.filter("kind = 0").select("doc_id", "n_tokens")
    # kind 1 closes what the tasks before have left open, 2 and 3 leave something open: one or two lines per task
    open_ = rows.filter("kind > 0")
    before = Window.orderBy("task", "kind").rowsBetween(Window.unboundedPreceding, -1)
    named = open_.withColumn("document", F.coalesce(F.sum((F.col("kind") == 1).cast("int")).over(before), F.lit(0)))
    pieces_ = F.sort_array(F.collect_list(F.struct("task", "kind", "open_ids")))
    stitched = named.groupBy("document").agg(F.sum("open_count").alias("n"), F.flatten(F.transform(pieces_, lambda p: p["open_ids"])).alias("ids"))
    value = " + ".join(f"shiftleft(ids[{i + 1}], {DIGIT_BITS * i})" for i in range(HEAD - 1))
    return whole.unionByName(stitched.filter("n > 0").select(F.expr(f"CASE WHEN ids[0] = 0 THEN {value} END").alias("doc_id"), (F.col("n") - HEAD).alias("n_tokens")))


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Write the documents' ids as token files in the shared folder and count from the files."""
    spark = docs.sparkSession
    folder = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, path, pattern)
    return scan(spark, folder)
