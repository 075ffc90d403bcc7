"""Fingerprints of documents by consistent weighted sampling, in native columns only.

A text's terms are its lower-cased words, weighted by how often they occur. For every term and each of SAMPLES draws, hashes give
r and c of the Gamma(2, 1) law and a uniform b (Ioffe, 2010); a term of weight w has t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r.
A draw's sample is the term with the smallest a, with its t. Since a is a function of term and t, the smallest ln a itself stands for the sample: two texts have equal
samples with probability equal to their generalised Jaccard similarity, sum(min(w)) / sum(max(w)), so the share of equal places estimates it.

Documents are ordered by id and shuffled once, in bands of BAND ids; the words of a document and of its edited text are counted and sampled inside
their band's partition, without another shuffle. What a band's last document needs of the next band's first comes from a table with one text a band.

Defined cases: a null text is empty; null ids come first, ordered and banded by text hash; rows that repeat an id are ordered by text hash, and each is a
document; a text without words has a fingerprint of its own (all places equal that of any other such text); a table of one document has
itself as next; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import number_rows
from ledgerlens.session import materialize, row_count

SAMPLES, GROUP, BAND_BITS = 32, 16, 8
BAND = ("known", "band")
SPACE = r"[\x20\x09-\x0D]+"


def _rows(docs: DataFrame) -> DataFrame:
    """(known, band, doc_id, text_hash, text): ascending in this order is the documents' order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    band = F.coalesce(F.shiftright(doc_id, BAND_BITS), F.shiftright(F.xxhash64(text), 40))
    return docs.select(
        doc_id.isNotNull().alias("known"), band.alias("band"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _from_next_band(firsts: DataFrame, value: str) -> DataFrame:
    """(of_known, of_band, next_one): a band's value from the band that follows; the first band follows the last."""
    ordered = firsts.select(*BAND, value).repartitionByRange(*BAND).sortWithinPartitions(*BAND)
    placed = materialize(number_rows(ordered, "place", start=0), "bands")
    bands = max(1, row_count(placed))
    ahead = placed.select(F.expr(f"(place + {bands - 1}) % {bands}").alias("place"), F.col(value).alias("next_one"))
    return placed.select("place", F.col("known").alias("of_known"), F.col("band").alias("of_band")).join(ahead, "place").drop("place")


def _with_next(rows: DataFrame, firsts: DataFrame, value: str, order: tuple[str, ...]) -> DataFrame:
    """The rows with `next`: the value of the row that follows in the whole order."""
    led = rows.withColumn("ahead", F.lead(value).over(Window.partitionBy(*BAND).orderBy(*order)))
    last = (F.col("known") == F.col("of_known")) & (F.col("band") == F.col("of_band")) & F.col("ahead").isNull()
    return led.join(_from_next_band(firsts, value), last, "left").withColumn("next", F.coalesce("ahead", "next_one")).drop(
        "of_known", "of_band", "ahead", "next_one")


def pairs(docs: DataFrame) -> DataFrame:
    """(known, band, at, doc_id, text, edited): every document and its edited text, `at` counting through the band."""
    rows = _rows(docs)
    firsts = rows.groupBy(*BAND).agg(F.min_by("text", F.struct("doc_id", "text_hash")).alias("text"))
    order = ("doc_id", "text_hash")
    placed = rows.repartition(*BAND).withColumn("at", F.row_number().over(Window.partitionBy(*BAND).orderBy(*order)))
    joined = _with_next(placed, firsts, "text", order)
    cut = "cast(char_length(text) div 4 as int)"
    edited = F.concat(F.expr(f"left(text, char_length(text) - {cut})"), F.expr(f"left(next, {cut})"))
    return joined.select(*BAND, "at", "doc_id", "text", edited.alias("edited"))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number inside (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -width)


def _draw(term: Column, number: int, weights: tuple[Column, ...]) -> list[Column]:
    """ln a of one draw at the natural logarithms of some weights of a term."""
    one = F.xxhash64(term, F.lit(number))
    two = F.xxhash64(one)
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = F.ln(-F.ln(_uniform(two, 0, 21) * _uniform(two, 21, 21)))
    b = _uniform(two, 42, 22)
    return [c - r * (F.floor(w / r + b).cast("double") - b + F.lit(1.0)) for w in weights]


def sampled(texts: DataFrame, keys: tuple[str, ...], columns: tuple[str, str], samples: int = SAMPLES) -> DataFrame:
    """keys and arrays `first`, `second` of the samples of two text columns."""
    both = texts.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("held")) for i, c in enumerate(columns)])).alias("one"))
    words = both.select(*keys, "one.which", F.explode(F.split(F.lower("one.held"), SPACE)).alias("word"))
    counted = words.groupBy(*keys, "word").agg(*[F.count(F.when(F.col("which") == i, 1)).alias(f"n{i}") for i in range(2)])
    # draws are made GROUP at a time, so that the generated code stays small enough to be compiled well
    groups, last = divmod(samples, GROUP)
    sizes = [GROUP] * groups + ([last] if last else [])
    terms = counted.select(
        *keys, F.explode(F.array(*[F.lit(g) for g in range(len(sizes))])).alias("part"), F.xxhash64("word").alias("word_hash"),
        *[F.when(F.col("word") != "", F.ln(F.col(f"n{i}").cast("double"))).alias(f"w{i}") for i in range(2)],
    ).withColumn("term", F.xxhash64("word_hash", "part"))
    draws = [_draw(F.col("term"), k, (F.col("w0"), F.col("w1"))) for k in range(min(GROUP, samples))]
    least = terms.groupBy(*keys, "part").agg(*[F.min(d[i]).alias(f"m{i}_{k}") for k, d in enumerate(draws) for i in range(2)])
    parts = least.select(*keys, "part", *[
        F.array(*[F.xxhash64(f"m{i}_{k}") for k in range(len(draws))]).alias(name) for i, name in enumerate(("first", "second"))])
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "first", "second"))).alias("parts"))  # a few lines a text
    return whole.select(*keys, *[F.slice(F.flatten(F.col(f"parts.{name}")), 1, samples).alias(name) for name in ("first", "second")])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _spelled(samples: Column) -> Column:
    """16 hex digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of (doc_id, text)."""
    keys = (*BAND, "at")
    texts = pairs(docs)
    prints = sampled(texts, keys, ("text", "edited"), samples)
    facts = texts.select(*keys, "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    held = materialize(facts.join(prints, list(keys)), "fingerprints")
    joined = _with_next(held, held.filter("at = 1"), "first", ("at",))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", _spelled(F.col("first")).alias("fingerprint"), _spelled(F.col("second")).alias("edited_fingerprint"),
        likeness(F.col("first"), F.col("second")).alias("near_edited"),
        likeness(F.col("first"), F.col("next")).alias("near_next"))
