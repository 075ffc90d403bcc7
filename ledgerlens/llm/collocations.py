"""Phrase collocations, counted level by level with broadcast double-array tries.

Texts are cut into words once and written as number sequences in which 0 stands for a piece's end and for every word below `least`:
no frequent phrase has such a word. Then, for phrases of 2, 3 and more words:

1. Sieve. Every position where a frequent phrase of one word less is followed by a frequent word adds to a hashed sum (Park, Chen and
   Yu, 1995), partial sums per task first. There are at least twice as many sums as words in the corpus, up to 2 ** 32. A phrase in a sum below `least` is below it itself.
2. Candidates are the different phrases in the sums that are left; so their first part and last word are frequent, and none that is frequent is missing.
   A bitmap of these sums, folded to at most 2 ** FILTER_BITS bits, is broadcast, so that tasks send few others; the exact sums decide where the phrases meet.
3. Count. Candidates are numbered and packed into tries of BLOCK phrases. A trie is broadcast, numpy moves the states of all positions of a chunk
   of text along it at once, accepting states are counted by bincount, and the counts of the chunks are summed.

A trie holds at most BLOCK phrases and so has bounded size; more phrases make more tries, and each is met with every chunk. The driver packs nothing:
tries are built in tasks and pass through it one at a time. Sums, phrases and counts travel packed, one line for each task and slab of numbers,
and a slab is added up by one task. Cuts, scores and nested phrases are joins of the counted tables.

Defined cases: a null text is empty; a null language is `und`; ties are decided as stated in collocations(); repeated rows count each; a null
or repeated doc_id changes nothing; an empty table, or one without frequent words, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, lean, lean_stream
from ledgerlens.llm.phrase_trie import Trie, digits_for
from ledgerlens.operators.ordering import number_rows
from ledgerlens.session import materialize, row_count

CHUNK_BYTES, SLICE_BYTES, BLOCK, FLUSH = 4 << 20, 1 << 20, 1 << 19, 1 << 22
#: Slabs of sums, bits of the broadcast filter, and numbers in a slab of counts.
SLAB_BITS, FILTER_BITS, COUNT_BITS = 8, 27, 16
SLABS = "slab long, blob binary"
#: A-Z to lower case and all ends of pieces to a full stop.
_PREPARED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a prepared text that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _squeezed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i8").tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which packs well: the lowest byte of all, the next of all, up to the last that any needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _packed(rising: np.ndarray, other: np.ndarray) -> bytes:
    """Two columns of numbers, the first of which never falls and is kept as steps."""
    held = len(other).to_bytes(8, "little") + _planes(np.diff(rising, prepend=0)) + _planes(other)
    return zstandard.ZstdCompressor(level=1).compress(held)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, columns = int(raw[:8].view("<u8")[0]), 8, []
    for _ in range(2):
        width = int(raw[at])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[at + 1:at + 1 + width * n].reshape(width, n).T
        columns.append(wide.view("<i8").ravel())
        at += 1 + width * n
    return np.cumsum(columns[0]), columns[1]


def _dealt(slab: np.ndarray, rising: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """One packed line per slab of two columns that are sorted by slab."""
    starts = np.flatnonzero(np.append(True, slab[1:] != slab[:-1])) if len(slab) else np.zeros(0, np.int64)
    blobs = [_packed(rising[a:b], other[a:b]) for a, b in zip(starts, np.append(starts[1:], len(slab)))]
    return pa.record_batch([pa.array(slab[starts].astype(np.int64)), pa.array(blobs, pa.binary())], ["slab", "blob"])


def _added(held: pa.Table, size: int, kind: type) -> np.ndarray:
    """The sums of a slab's packed (place, n) lines."""
    total = np.zeros(size, kind)
    for blob in held.column("blob"):
        place, n = _unpacked(blob.as_py())
        total[place] += n.astype(kind)
    return total


def chunked(docs: DataFrame) -> DataFrame:
    """(lang, words, counts, codes): texts of one language in chunks; code i > 0 is the chunk's i-th word, 0 ends a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list]] = {}
        size = 0

        def flushed():
            for lang, (known, parts) in held.items():
                codes = np.concatenate(parts)
                counts = np.bincount(codes, minlength=len(known))[1:]
                words = [w.decode() for w in known][1:]
                yield pa.record_batch([
                    pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())),
                    pa.array([_squeezed(codes)], pa.binary())], ["lang", "words", "counts", "codes"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in held:
                    known = defaultdict()
                    known.default_factory = known.__len__
                    known[b"."]
                    held[lang] = known, []
                known, parts = held[lang]
                text = text.as_py().translate(_PREPARED)
                for part in _slices(text):
                    words = part.replace(b".", b" . ").split()
                    parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                parts.append(np.zeros(1, np.int64))
                size += len(text) + 1
                if size >= CHUNK_BYTES:
                    yield from flushed()
                    size = 0
        yield from flushed()

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), as_bytes("text").alias("text"))
    return rows.mapInArrow(lean_stream(run), "lang string, words array<string>, counts array<long>, codes binary")


def _recoded(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(codes) of all chunks with the numbers of frequent words, 0 for all others."""
    listed = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    named = listed.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of_chunk"), (F.col("at") + 1).alias("at"), "id")

    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for blob in held.column("codes").to_pylist():
            codes = _numbers(blob)
            ids = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
            ids[found.column("at").to_numpy()] = found.column("id").to_numpy()
            out.append(_squeezed(ids[codes]))
        return pa.table({"codes": pa.array(out, pa.binary())})

    return chunks.select("chunk", "codes").groupBy("chunk").cogroup(named.groupBy("of_chunk")).applyInArrow(run, "codes binary")


def _tries(phrases: DataFrame, length: int, digits: int) -> DataFrame:
    """(block, first, blob): a packed trie for every BLOCK of numbered phrases (id from 0, words)."""

    def build(held: pa.Table) -> pa.Table:
        ids = held.column("id").to_numpy()
        order = np.argsort(ids)
        flat = held.column("words").combine_chunks().flatten().to_numpy()
        blob = Trie.build(flat.reshape(-1, length)[order], digits).packed()
        return pa.table({"block": held.column("block").slice(0, 1), "first": pa.array([ids.min()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    blocks = phrases.select("id", "words", F.expr(f"id div {BLOCK}").alias("block"))
    return blocks.groupBy("block").applyInArrow(build, "block long, first long, blob binary")


def _scanned(text: DataFrame, tries: DataFrame, blocks: int, schema: str, work: Callable) -> DataFrame:
    """work(trie, first number, sequences) over the written text for each trie, as one frame."""
    context = text.sparkSession.sparkContext
    out = None
    for block in range(blocks):
        row = tries.filter(F.col("block") == block).select("first", "blob").first()
        sent, first = context.broadcast(bytes(row["blob"])), row["first"]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            trie = Trie.unpacked(sent.value)
            yield from work(trie, first, (_numbers(c.as_py()) for batch in batches for c in batch.column("codes")))

        part = text.mapInArrow(lean_stream(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _follow(trie: Trie, first: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase number, next word) of all positions where a phrase of the trie is followed by a frequent word."""
    at, state = trie.walk(codes)
    inside = at + trie.length < len(codes)
    at, state = at[inside], state[inside]
    following = codes[at + trie.length]
    known = following > 0
    return first + trie.number[state[known]].astype(np.int64), following[known]


class Sums:
    """Hashed sums of pairs (phrase number, next word), dealt to slabs; those of at least `least` are rich."""

    def __init__(self, positions: int, least: int):
        self.bits, self.least = min(32, max(2 * SLAB_BITS, (2 * positions).bit_length())), least
        self.low = self.bits - SLAB_BITS
        self.fold = min(self.low, FILTER_BITS - SLAB_BITS)

    def of(self, prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which sum a phrase adds to."""
        mixed = (prefix.astype(np.uint64) * MIX) ^ word.astype(np.uint64)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def partial(self, trie: Trie, first: int, texts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """What the phrases in some texts add to the sums."""
        held, size = [], 0

        def flushed():
            sums, n = np.unique(np.concatenate(held), return_counts=True)
            return _dealt(sums >> self.low, sums & ((1 << self.low) - 1), np.minimum(n, self.least))  # more than enough is enough

        for codes in texts:
            held.append(self.of(*_follow(trie, first, codes)))
            size += len(held[-1])
            if size >= FLUSH:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    def rich(self, partial: DataFrame) -> DataFrame:
        """(slab, rich, folded): a bitmap of the rich sums of every slab that has some, and the same folded for the filter."""

        def run(held: pa.Table) -> pa.Table:
            rich = _added(held, 1 << self.low, np.int32) >= self.least
            bits = [zstandard.ZstdCompressor(level=1).compress(np.packbits(b).tobytes()) for b in (rich, rich.reshape(-1, 1 << self.fold).any(axis=0))]
            line = pa.table({"slab": held.column("slab").slice(0, 1), "rich": pa.array(bits[:1], pa.binary()), "folded": pa.array(bits[1:], pa.binary())})
            return line if rich.any() else line.slice(0, 0)

        return partial.groupBy("slab").applyInArrow(lean(run), "slab long, rich binary, folded binary")

    def filter(self, rich: DataFrame) -> bytes:
        """The folded bitmaps of all slabs, at most 2 ** FILTER_BITS bits."""
        size = 1 << self.fold - 3
        out = bytearray(size << SLAB_BITS)
        for row in rich.select("slab", "folded").collect():
            out[row["slab"] * size:(row["slab"] + 1) * size] = zstandard.ZstdDecompressor().decompress(bytes(row["folded"]))
        return bytes(out)

    def different(self, sent, trie: Trie, first: int, texts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The different pairs in some texts that pass the filter."""
        passing, held, size = np.frombuffer(sent.value, np.uint8), [], 0

        def flushed():
            pairs = np.unique(np.concatenate(held))
            prefix, word = _apart(pairs)
            slab = self.of(prefix, word) >> self.low
            order = np.argsort(slab, kind="stable")
            return _dealt(slab[order], prefix[order], word[order])

        for codes in texts:
            prefix, word = _follow(trie, first, codes)
            sums = self.of(prefix, word)
            at = (sums >> self.low << self.fold) | (sums & ((1 << self.fold) - 1))
            inside = (passing[at >> 3] << (at & 7).astype(np.uint8) & 128) > 0
            held.append(np.unique(_together(prefix[inside], word[inside])))
            size += len(held[-1])
            if size >= FLUSH:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    def candidates(self, different: DataFrame, rich: DataFrame) -> DataFrame:
        """(prefix, word): every different pair of a rich sum once."""

        def run(held: pa.Table, found: pa.Table) -> pa.Table:
            pairs, waiting, size = np.zeros(0, np.uint64), [], 0
            for blob in held.column("blob") if found.num_rows else []:
                waiting.append(_together(*_unpacked(blob.as_py())))
                size += len(waiting[-1])
                if size >= FLUSH:
                    pairs, waiting, size = np.unique(np.concatenate([pairs, *waiting])), [], 0
            prefix, word = _apart(np.unique(np.concatenate([pairs, *waiting])))
            if len(prefix):
                bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(found.column("rich")[0].as_py()), np.uint8)
                inside = np.unpackbits(bits)[self.of(prefix, word) & ((1 << self.low) - 1)] > 0
                prefix, word = prefix[inside], word[inside]
            return pa.table({"prefix": pa.array(prefix), "word": pa.array(word)})

        both = different.groupBy("slab").cogroup(rich.select("slab", "rich").groupBy("slab"))
        return both.applyInArrow(lean(run), "prefix long, word long")


def _together(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Pairs as single numbers; both parts are below 2 ** 32."""
    return prefix.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


def _apart(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _counted(trie: Trie, first: int, texts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(trie.base), np.int64)
    for codes in texts:
        total += np.bincount(trie.walk(codes)[1], minlength=len(total))
    counts = total[trie.leaf]
    own = np.flatnonzero(counts)
    ids = first + own
    yield _dealt(ids >> COUNT_BITS, ids & ((1 << COUNT_BITS) - 1), counts[own])


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """(id, f) of the phrases that occur `least` times or more."""

    def run(held: pa.Table) -> pa.Table:
        total = _added(held, 1 << COUNT_BITS, np.int64)
        own = np.flatnonzero(total >= least)
        return pa.table({"id": pa.array((held.column("slab")[0].as_py() << COUNT_BITS) + own), "f": pa.array(total[own])})

    return counts.groupBy("slab").applyInArrow(lean(run), "id long, f long")


class Phrases:
    """Frequent phrases of a corpus: totals (lang, n), words (id, lang, word, f) and levels {length: (id, words, f)}."""

    def __init__(self, docs: DataFrame, least: int = 30, longest: int = 4):
        chunks = materialize(chunked(docs).withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")
        counted = materialize(
            chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("line"))
            .groupBy("lang", F.col("line.words").alias("word")).agg(F.sum("line.counts").alias("f")), "phrase-words")
        self.totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        self.words = materialize(number_rows(counted.filter(F.col("f") >= least), "id"), "frequent-words")  # ids from 1
        found = row_count(self.words)
        self.levels = {1: self.words.select((F.col("id") - 1).alias("id"), F.array("id").alias("words"), "f")}
        if not found:
            return
        text = materialize(_recoded(chunks, self.words), "phrase-text")
        digits = digits_for(found)
        sums = Sums(self.totals.agg(F.sum("n")).first()[0], least)
        for length in range(2, longest + 1):
            known = self.levels[length - 1]
            tries = materialize(_tries(known, length - 1, digits), "phrase-tries")
            blocks = row_count(tries)
            rich = materialize(sums.rich(_scanned(text, tries, blocks, SLABS, sums.partial)), "phrase-sieve")
            if not row_count(rich):
                break
            sent = text.sparkSession.sparkContext.broadcast(sums.filter(rich))
            pairs = sums.candidates(_scanned(text, tries, blocks, SLABS, partial(sums.different, sent)), rich)
            longer = pairs.join(known.select(F.col("id").alias("prefix"), "words"), "prefix")
            candidates = materialize(number_rows(longer.select(F.concat("words", F.array("word")).alias("words")), "id", start=0), "phrase-candidates")
            tries = materialize(_tries(candidates, length, digits), "phrase-tries")
            frequent = _frequent(_scanned(text, tries, row_count(tries), SLABS, _counted), least)
            self.levels[length] = materialize(
                number_rows(candidates.join(frequent, "id").select("words", "f"), "id", start=0), "frequent-phrases")
            if not row_count(self.levels[length]):
                break

    def all_of(self, lengths) -> DataFrame:
        """(words, f) of the frequent phrases of several lengths."""
        frames = [self.levels[n].select("words", "f") for n in lengths if n in self.levels]
        out = frames[0] if frames else self.levels[1].select("words", "f").limit(0)
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out


def _whole(column: str) -> Column:
    """Exact in sums and products of counts."""
    return F.col(column).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, nested_percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    The score is floor(2000000 * a / (l + r)) at the cut where it is lowest, ties at the first cut. A phrase goes if a longer one that
    holds it has at least nested_percent of its count. Rank is by score and a, both descending, then phrase.
    """
    phrases = Phrases(docs, least, longest)
    held = phrases.all_of(range(2, longest + 1)).withColumnRenamed("f", "a")
    parts = phrases.all_of(range(1, longest))
    cuts = held.select("words", "a", F.posexplode(F.sequence(F.lit(1), F.size("words") - 1)).alias("at", "cut"))
    cuts = cuts.select("words", "a", "cut", F.expr("slice(words, 1, cut)").alias("left"), F.expr("slice(words, cut + 1, size(words))").alias("right"))
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    scored = cuts.withColumns({"la": _whole("a"), "lr": _whole("l") + _whole("r")}).select(
        "words", "a", F.struct(F.expr("(2000000 * la) div lr").alias("score"), "cut", "l", "r").alias("way"))
    best = scored.groupBy("words", "a").agg(F.min("way").alias("way"))
    inner = "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), s -> slice(words, s, n))))"
    longer = phrases.all_of(range(3, longest + 1)).select(F.explode(F.array_distinct(F.expr(inner))).alias("words"), "f")
    around = longer.groupBy("words").agg(F.max("f").alias("around"))
    free = best.join(around, "words", "left").filter(
        F.col("around").isNull() | (_whole("around") * 100 < _whole("a") * nested_percent))
    spelled = (
        free.select("words", "a", "way", F.posexplode("words").alias("at", "id"))
        .join(phrases.words.select("id", "lang", "word"), "id")
        .groupBy("words", "a", "way").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    )
    lines = spelled.select("lang", F.array_join("spelled.word", " ").alias("phrase"), "a", "way.l", "way.r", "way.score")
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(phrases.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same rows: words numbered through the text, a piece's number with each; phrases by looking ahead in the piece.
ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS held FROM documents),
piece AS (SELECT doc, lang, unnest(held) AS p, generate_subscripts(held, 1) AS part FROM pieces),
listed AS (SELECT doc, lang, part, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
word AS (SELECT doc, lang, part, unnest(ws) AS w, generate_subscripts(ws, 1) AS spot FROM listed),
ahead AS (
  SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4 FROM word
  WINDOW s AS (PARTITION BY doc, part ORDER BY spot)),
f AS (
  SELECT lang, 1 AS m, w1 AS p, count(*) AS f FROM ahead GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, p, string_split(p, ' ') AS ws, f AS a FROM f WHERE m > 1),
cut AS (SELECT lang, p, ws, a, unnest(range(1, m)) AS k FROM cand),
sides AS (SELECT *, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM cut),
scored AS (
  SELECT s.lang, s.p, s.a, s.k, l.f AS l, r.f AS r, CAST(2000000 * CAST(s.a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM sides s JOIN f l ON l.lang = s.lang AND l.p = s.x JOIN f r ON r.lang = s.lang AND r.p = s.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a AS f, array_to_string(ws[s:s + n - 1], ' ') AS sub
  FROM (SELECT lang, a, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM (SELECT lang, a, ws, unnest(range(2, m)) AS n FROM cand WHERE m > 2))),
around AS (SELECT lang, sub, max(f) AS f FROM inside GROUP BY ALL),
free AS (
  SELECT b.lang, b.p AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.sub = b.p WHERE o.f IS NULL OR 100 * CAST(o.f AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
