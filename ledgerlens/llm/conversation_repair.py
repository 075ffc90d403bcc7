"""Cheapest repair of conversation structure, solved with Four-Russians block tables.

The roles of a repaired conversation read (system? (user assistant)+)? by their initials. Every row is one of nine symbols (initial
s, u, a or other, each with or without a cut-off text, or a row that has to go). The costs of finishing from the four states of that
pattern form a vector; taken relative to its smallest entry only a few dozen vectors exist. `tables()` lists them and precomputes, for
each vector behind a block of BLOCK symbols and each such block, the vector in front of it, the cost added, and the state after it for each state
before it. A conversation is then two runs of lookups, one step a block: from the end for the cost vectors, from the start for the states.
Blocks are expanded backward to the vectors behind their single rows, and with those every row's edits are read off. Edits are chosen
against the cost of finishing, the ASCII-least letter first, so ties are decided by the whole rest of the conversation.

Jobs: (1) texts that a conversation's role repeats in a later turn are found by a grouped count of digests; (2) rows are sorted by
conversation and turn, and each task solves the conversations that it reads; (3) rows meet their edits in the same order and come out repaired.
A conversation is read in order by one task, because its digest runs over its whole text, but the task streams: it holds one byte and the letters
of its edits for each row of the conversation at hand, never its texts.

Defined cases: a null role or text is one space, as is a null part of the damage key; null turns come first; rows of one turn are
ordered by role, then text; a null conv_id is a conversation; repeated rows are duplicates; a conversation without rows costs nothing
and is empty; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize

DELETE, REPLACE, INSERT, CUT_OFF = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial (by index in "sua"); what is not listed is not allowed.
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The one role that can be inserted in a state leads here.
INSERTED = (USER, USER, ASSISTANT, USER)
#: Cost of finishing after the last row.
FINISH = (0, 2 * INSERT, INSERT, 0)
MUST_GO, PAD, SYMBOLS, BLOCK = 8, 9, 10, 4
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
LETTER = r"[^\x20\x09-\x0D]"


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cost of finishing from each state in front of a row, given those behind it."""
    if symbol == PAD:
        return after
    found = [cost for _, cost, _ in (min(row_edits(after, symbol, q), key=lambda e: e[1]) for q in range(4))]
    for _ in range(2):
        found = [min(found[q], INSERT + found[INSERTED[q]]) for q in range(4)]
    return tuple(found)


def row_edits(after, symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost of finishing, state behind) of the edits of one row in one state, in ASCII order."""
    edits = [("D", DELETE + after[state], state)]
    if symbol != MUST_GO:
        extra = CUT_OFF if symbol >= 4 else 0
        initial = "sua "[symbol % 4]
        if state in STEP.get(initial, {}):
            edits.append(("K", extra + after[STEP[initial][state]], STEP[initial][state]))
        edits += [("R", REPLACE + extra + after[STEP[i][state]], STEP[i][state]) for i in "ua" if state in STEP[i]]
    return edits


def traced(after, symbol: int, state: int) -> tuple[str, int]:
    """The ASCII-least letters on a cheapest way over one row, insertions in front of it included, and the state behind it."""
    if symbol == PAD:
        return "", state
    costs, letters = before(after, symbol), ""
    while True:
        edits = {letter: q for letter, cost, q in reversed(row_edits(after, symbol, state)) if cost == costs[state]}
        if "D" not in edits and INSERT + costs[INSERTED[state]] == costs[state]:
            letters, state = letters + "I", INSERTED[state]
            continue
        letter = min(edits)
        return letters + letter, edits[letter]


class Tables(NamedTuple):
    vectors: np.ndarray  # (vectors, 4) costs relative to the smallest
    row_vector: np.ndarray  # (vectors, SYMBOLS): vector in front of one row
    row_state: np.ndarray  # (vectors, SYMBOLS, 4): state behind one row
    row_letters: np.ndarray  # (vectors, SYMBOLS, 4): index into letters
    letters: list[str]
    block_vector: np.ndarray  # (vectors, SYMBOLS ** BLOCK)
    block_cost: np.ndarray
    block_state: np.ndarray  # (vectors, SYMBOLS ** BLOCK, 4)


@cache
def tables() -> Tables:
    """All cost vectors and the transitions over rows and blocks; vector 0 is the one behind the last row."""
    listed, numbers = [FINISH], {FINISH: 0}
    steps: list[list[tuple[int, int]]] = []
    for vector in listed:  # grows while it is read
        steps.append([])
        for symbol in range(SYMBOLS):
            found = before(vector, symbol)
            least = min(found)
            reduced = tuple(c - least for c in found)
            if reduced not in numbers:
                numbers[reduced] = len(listed)
                listed.append(reduced)
            steps[-1].append((numbers[reduced], least))
    row_vector, row_cost = (np.array([[s[i] for s in line] for line in steps], np.int16) for i in range(2))
    letters: dict[str, int] = {}
    row_state = np.zeros((len(listed), SYMBOLS, 4), np.int8)
    row_letters = np.zeros((len(listed), SYMBOLS, 4), np.int8)
    for v, symbol, q in product(range(len(listed)), range(SYMBOLS), range(4)):
        found, row_state[v, symbol, q] = traced(listed[v], symbol, q)
        row_letters[v, symbol, q] = letters.setdefault(found, len(letters))
    vector, cost, state = row_vector, row_cost, row_state
    for _ in range(BLOCK - 1):  # put one more row in front of the blocks
        front = np.moveaxis(row_vector[vector], 2, 1)
        added = np.moveaxis(row_cost[vector], 2, 1)
        over = np.moveaxis(row_state[vector], 2, 1)  # (vectors, symbol in front, rest, state)
        state = np.take_along_axis(np.broadcast_to(state[:, None], over.shape), over.astype(np.int64), 3)
        cost = (cost[:, None] + added).reshape(len(listed), -1)
        vector, state = front.reshape(len(listed), -1), state.reshape(len(listed), -1, 4)
    return Tables(np.array(listed, np.int16), row_vector, row_state, row_letters, list(letters), vector, cost, state)


def solve(symbols: list[np.ndarray]) -> list[tuple[int, str]]:
    """(cost, letters of the edits) of each conversation's symbols."""
    t = tables()
    sizes = np.array([-(-len(s) // BLOCK) for s in symbols], np.int64)
    ends = np.cumsum(sizes)
    padded = np.full((int(ends[-1]) if len(ends) else 0, BLOCK), PAD, np.int64)
    flat = padded.ravel()
    for s, end in zip(symbols, ends.tolist()):
        flat[end * BLOCK - len(s):end * BLOCK] = s  # padding stands in front
    codes = padded @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    behind = np.zeros(len(codes), np.int64)  # vector behind each block
    vector, cost = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for step, n in enumerate(active.tolist()):
        own = order[:n]
        at = ends[own] - 1 - step
        behind[at] = vector[own]
        cost[own] += t.block_cost[vector[own], codes[at]]
        vector[own] = t.block_vector[vector[own], codes[at]]
    cost += t.vectors[vector, START]
    entry, state = np.zeros(len(codes), np.int64), np.zeros(len(sizes), np.int64)  # state in front of each block
    for step, n in enumerate(active.tolist()):
        own = order[:n]
        at = ends[own] - sizes[own] + step
        entry[at] = state[own]
        state[own] = t.block_state[behind[at], codes[at], state[own]]
    rows_behind = np.zeros(padded.shape, np.int64)
    for j in range(BLOCK - 1, -1, -1):
        rows_behind[:, j] = behind
        behind = t.row_vector[behind, padded[:, j]]
    found = np.zeros(padded.shape, np.int64)
    for j in range(BLOCK):
        found[:, j] = t.row_letters[rows_behind[:, j], padded[:, j], entry]
        entry = t.row_state[rows_behind[:, j], padded[:, j], entry]
    at_end = ["I" * (FINISH[q] // INSERT) for q in state.tolist()]
    names = np.array(t.letters, object)
    return [(c, "".join(names[found[e - s:e].ravel()]) + last)
            for c, s, e, last in zip(cost.tolist(), sizes.tolist(), ends.tolist(), at_end)]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): the rows with the faults that the checksum of conv_id and turn names; dropped rows have alive false."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = (F.crc32(key.cast("binary")) % 20).alias("fault")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], fault)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.col("fault") != 0,
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).toDF("conv_id", "turn", "role", "text", "alive", "copy").drop("copy")


def intact(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of damaged()."""
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.lit(True).alias("alive"))


ORDER = ("conv_id", "alive", "turn", "role", "text")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, alive, turn, symbol, fault, illegal, new_turn) sorted by conversation within partitions."""
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    known = rows.filter("alive").select("conv_id", "turn", "role", digest)
    again = known.groupBy("conv_id", "role", "digest").agg(
        F.min("turn").alias("first"), F.max("turn").alias("last"), (F.count("turn") < F.count(F.lit(1))).alias("untimed"),
    ).filter("first < last OR (untimed AND first IS NOT NULL)").select(
        F.col("conv_id").alias("other"), F.col("role").alias("other_role"), F.col("digest").alias("other_digest"), "first", "untimed")
    joined = rows.withColumn("digest", digest).join(
        again, F.col("conv_id").eqNullSafe(F.col("other")) & (F.col("role") == F.col("other_role")) & (F.col("digest") == F.col("other_digest")), "left")
    spread = joined.select(*ORDER, "digest", "first", "untimed").repartition("conv_id")
    within = Window.partitionBy("conv_id", "alive").orderBy("turn", "role", "text")
    initial = F.substring("role", 1, 1)

    def previous(column):
        return F.lag(column).over(within)

    start = F.row_number().over(within) == 1
    same = ~start & previous("turn").eqNullSafe(F.col("turn")) & (previous("role") == F.col("role")) & (previous("digest") == F.col("digest"))
    later = F.when(F.col("untimed"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    fault = (
        F.when(~F.col("text").rlike(LETTER), BLANK)
        .when(same | F.coalesce(later, F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(NO_FAULT)
    )
    pair = F.concat(previous(initial), initial)
    index = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    found = spread.select(
        *ORDER, fault.alias("fault"), index.alias("index"), (~start & ~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (start | ~previous("turn").eqNullSafe(F.col("turn")))).alias("new_turn"))
    symbol = F.when(F.col("fault").isin(BLANK, DUPLICATE), MUST_GO).otherwise(F.col("index") + F.when(F.col("fault") == TRUNCATED, 4).otherwise(0))
    return found.sortWithinPartitions(*ORDER).select(
        "conv_id", "alive", "turn", symbol.cast("byte").alias("symbol"), F.col("fault").cast("byte").alias("fault"), "illegal", "new_turn")


COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame, held_rows: int = 1 << 17) -> DataFrame:
    """One line of FOUND for each conversation of damaged() or intact() rows."""

    def lines(done: list[dict]) -> pa.RecordBatch:
        solved = solve([np.concatenate(d["symbols"]) if d["symbols"] else np.zeros(0, np.uint8) for d in done])
        gaps = [d["max"] - d["min"] + 1 - d["turns"] if d["turns"] else 0 for d in done]
        columns = {"conv_id": [d["conv_id"] for d in done], "gaps": gaps} | {c: [d[c] for d in done] for c in COUNTS[:4]}
        columns |= {"cost": [c for c, _ in solved], "audit": [a for _, a in solved]}
        return pa.record_batch([pa.array(v, pa.string() if k == "audit" else pa.int64()) for k, v in columns.items()], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id")
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (null[1:] != null[:-1])))
            ends = np.append(starts[1:], batch.num_rows)
            alive, illegal, new = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("alive", "illegal", "new_turn"))
            symbol, fault = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("symbol", "fault"))
            turn = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False)
            for start, end in zip(starts.tolist(), ends.tolist()):
                conv = None if null[start] else int(number[start])
                if last is None or last["conv_id"] != conv:
                    if last is not None:
                        done.append(last)
                        held += sum(map(len, last["symbols"]))
                        if held >= held_rows:
                            yield lines(done)
                            done, held = [], 0
                    last = {"conv_id": conv, "symbols": [], "min": None, "max": None} | dict.fromkeys(COUNTS, 0)
                start += int((~alive[start:end]).sum())  # dropped rows come first
                if start == end:
                    continue
                last["symbols"].append(symbol[start:end].astype(np.uint8))
                for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
                    last[name] += int((fault[start:end] == kind).sum())
                last["illegal"] += int(illegal[start:end].sum())
                timed = start + np.flatnonzero(new[start:end])
                if len(timed):
                    last["turns"] += len(timed)
                    last["min"] = int(turn[timed[0]]) if last["min"] is None else last["min"]
                    last["max"] = int(turn[timed[-1]])
        if last is not None:
            done.append(last)
        if done:
            yield lines(done)

    return marked(rows).mapInArrow(run, FOUND)


REPAIRED = "conv_id long, position long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _repairs(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's line of `found` (position null), then its repaired rows in order, without a break within a partition."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    blank = [F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in FOUND.split(", ")[1:])]
    heads = found.select("conv_id", F.lit(False).alias("alive"), *[F.lit(None).cast(k).alias(n) for n, k in (("turn", "long"), ("role", "string"), ("text", "string"))],
                         *names[1:])
    both = heads.unionByName(rows.filter("alive").select(*ORDER, *blank)).repartition("conv_id").sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, letters, at, position, odd = None, "", 0, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "alive", "role", "text")]
            whole = [batch.column(n) for n in names[1:]]
            out, head_at = [], []

            def put(edit, role, text):
                nonlocal position
                out.append((conv, position, edit, role, text))
                head_at.append(None)
                position += 1

            def role_here():
                return ("user", "assistant")[(position - odd) % 2]

            def inserts():
                nonlocal at
                while at < len(letters) and letters[at] == "I":
                    at += 1
                    put("I", role_here(), "")

            for i, (name, alive, role, text) in enumerate(zip(*columns)):
                if not alive:
                    inserts()
                    conv, letters, at, position = name, whole[-1][i].as_py(), 0, 0
                    odd = (len(letters) - letters.count("D")) % 2  # only a kept system row makes an odd number
                    out.append((conv, None, None, None, None))
                    head_at.append(i)
                    continue
                inserts()
                letter = letters[at]
                at += 1
                if letter != "D":
                    put(letter, role if letter == "K" else role_here(), text)
            if out:
                yield _repaired_batch(out, head_at, whole)
        out, head_at = [], []
        while at < len(letters):
            out.append((conv, position, "I", ("user", "assistant")[(position - odd) % 2], ""))
            position, at = position + 1, at + 1
        if out:
            yield _repaired_batch(out, [None] * len(out), None)

    def _repaired_batch(out, head_at, whole):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
        index = pa.array(head_at, pa.int64())
        for j, name in enumerate(names[1:]):
            kind = pa.string() if name == "audit" else pa.int64()
            arrays.append(whole[j].take(index) if whole else pa.nulls(len(out), kind))
        return pa.record_batch(arrays, ["conv_id", "position", "edit", "role", "text", *names[1:]])

    return both.mapInArrow(run, REPAIRED)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired rows of damaged() or intact() ones, with the edit that made each."""
    return _repairs(rows, materialize(audits(rows), "conversation-audits")).filter("position IS NOT NULL").select("conv_id", "position", "edit", "role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """FOUND and the digest of the repaired `role:text` lines of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, empty = None, None, True
        for batch in batches:
            heads, found = [], []
            whole = batch.select([f.split()[0] for f in FOUND.split(", ")])
            for i, (position, role, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("position", "role", "text")])):
                if position is None:
                    if head is not None:
                        heads.append(head)
                        found.append(digest.hexdigest())
                    head, digest, empty = whole.slice(i, 1), hashlib.sha256(), True
                else:
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if heads:
                yield _digest_batch(heads, found)
        if head is not None:
            yield _digest_batch([head], [digest.hexdigest()])

    def _digest_batch(heads, found):
        table = pa.Table.from_batches(heads).combine_chunks()
        return table.append_column("repaired_sha256", pa.array(found, pa.string())).to_batches()[0]

    return _repairs(rows, materialize(audits(rows), "conversation-audits")).mapInArrow(run, FOUND + ", repaired_sha256 string")
