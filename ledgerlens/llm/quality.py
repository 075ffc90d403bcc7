"""Quality rules as weak supervision: rules vote or abstain, a label model weighs them.

Every document is measured once; each rule then votes 1 (good), 0 (bad) or nothing. Expectation-maximisation over the counts
of all vote patterns (at most 3 ** number of rules, whatever the table) estimates how often each rule is
right on good and on bad documents and what share is good; a document is kept if its posterior probability of
being good reaches THRESHOLD and the two hard base rules hold. Nothing is asked of all rules at once, and no labels are used.

The model starts from rules that seldom speak against good documents and is kept there (FLOOR_GOOD), so good and bad
cannot change places. Counts cover all documents.

Defined cases: null, empty and blank texts have no words, fail the base rules and are not kept; repeated rows and ids are
judged one by one; an empty table gives an empty result; a posterior equal to THRESHOLD is kept. Other columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WHITE_SPACE, as_bytes, lean_stream
from ledgerlens.session import materialize

MIN_WORDS, MAX_REPEAT_PCT, THRESHOLD = 50, 50, 0.5
SYMBOLS = b"#*$%&|<>"
#: Share of good documents, and rules' shares of right votes on good and bad ones, that EM starts from; bounds of these shares.
START, FLOOR_GOOD, FLOOR_BAD, CEILING, ROUNDS = (0.5, 0.98, 0.15), 0.9, 0.02, 0.999, 100
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_digits long, n_letters long"


def measure(text: bytes) -> tuple[int, ...]:
    """The figures of STATS for one text."""
    words = text.split()
    repeated = 0
    if len(words) > 2:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
            covered = np.zeros(len(words), bool)
            for shift in range(3):
                covered[shift:shift + len(windows)] |= again
            repeated = int(covered.sum())
    lines = [line for line in text.split(b"\n") if line.strip(WHITE_SPACE)]
    octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    code_points = len(text) - int(octets[0x80:0xC0].sum())
    letters = int(octets[65:91].sum() + octets[97:123].sum() + octets[0xC2:].sum())
    return (
        len(words), code_points - int(octets[list(WHITE_SPACE)].sum()), int(octets[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)), repeated, len(lines), int(octets[48:58].sum()), letters,
    )


def measured(docs: DataFrame) -> DataFrame:
    """(row_key, figures) of every row; only the id and the text travel to Python."""

    def run(batches):
        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*found)) if found else [[] for _ in range(8)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "text_hash", *[c.split()[0] for c in STATS.split(", ")]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_bytes("text")).alias("text_hash"), as_bytes("text").alias("text"))
    return rows.mapInArrow(lean_stream(run), f"doc_id long, text_hash long, {STATS}")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1).otherwise(2)


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, 0 bad, 2 abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    some, lined = words > 0, F.col("n_lines") > 2
    return {
        "length": _vote(words >= 2 * MIN_WORDS, words < MIN_WORDS),
        "word_size": _vote(some & (chars <= 7 * words) & (chars >= 4 * words), some & ((chars > 10 * words) | (chars < 3 * words))),
        "symbols": _vote(50 * F.col("n_symbols") <= words, 10 * F.col("n_symbols") > words),
        "lines": _vote(lined & (10 * F.col("n_dup_lines") <= F.col("n_lines")), lined & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        "repeats": _vote(some & (10 * F.col("n_repeat_words") <= words), 2 * F.col("n_repeat_words") > words),
        "digits": _vote(some & (20 * F.col("n_digits") <= chars), 2 * F.col("n_digits") > chars),
        "letters": _vote(some & (10 * F.col("n_letters") >= 9 * chars), some & (10 * F.col("n_letters") < 7 * chars)),
    }


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * words)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for conditionally independent rules; abstentions say nothing.

    patterns: (n, rules) of 1, 0 and 2. Returns the share of good documents, and each rule's
    probability of voting right on good and on bad documents when it votes. A rule may see few of the bad
    documents, as there are many ways to be bad, but it seldom speaks against a good one (FLOOR_GOOD).
    """
    rules = patterns.shape[1]
    prior, right = START[0], np.stack([np.full(rules, START[2]), np.full(rules, START[1])])  # rows: bad, good
    voted = patterns != 2
    for _ in range(rounds):
        weight = posterior(patterns, prior, right[1], right[0]) * counts
        rest = counts - weight
        prior = float(np.clip((weight.sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        for row, (w, vote, floor) in enumerate(((rest, 0, FLOOR_BAD), (weight, 1, FLOOR_GOOD))):
            hit = ((patterns == vote) * w[:, None]).sum(axis=0)
            seen = (voted * w[:, None]).sum(axis=0)
            right[row] = np.clip((hit + START[2 - row]) / (seen + 1), floor, CEILING)
    return prior, right[1], right[0]


def posterior(patterns: np.ndarray, prior: float, right_good: np.ndarray, right_bad: np.ndarray) -> np.ndarray:
    up = np.where(patterns == 1, np.log(right_good / (1 - right_bad)), 0.0)
    down = np.where(patterns == 0, np.log((1 - right_good) / right_bad), 0.0)
    return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + (up + down).sum(axis=1))))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, figures, base_failed, quality_probability, kept) of every row."""
    rules = votes()
    rows = materialize(
        measured(docs).withColumn("base_failed", base_failed())
        .withColumn("pattern", F.concat(*[v.cast("string") for v in rules.values()])), "quality-figures")
    found = rows.groupBy("pattern").count().collect()  # at most 3 ** 7 lines
    table = rows.sparkSession.createDataFrame(_scored(found, len(rules)), "pattern string, quality_probability double")
    return rows.join(F.broadcast(table), "pattern").withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality_probability") >= THRESHOLD)).drop("pattern")


def _scored(found: list, rules: int) -> list[tuple[str, float]]:
    if not found:
        return []
    patterns = np.array([[int(c) for c in r["pattern"]] for r in found]).reshape(-1, rules)
    prior, good, bad = fit(patterns, np.array([r["count"] for r in found], float))
    return list(zip([r["pattern"] for r in found], map(float, posterior(patterns, prior, good, bad))))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with their columns as they are. Rows of one id and one text share a verdict."""
    verdict = judged(docs).filter("kept").select(
        F.col("doc_id").alias("__quality_id"), F.col("text_hash").alias("__quality_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__quality_id")) & (F.xxhash64(as_bytes("text")) == F.col("__quality_hash"))
    return docs.join(verdict, same, "left_semi")
