"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Targets: the words of all documents are shared among sources by weight; a source stops at MAX_EPOCHS times its own
   words and the excess is shared again by weight (solved in closed form, sources in order of cap by weight).
2. Blocks: a hash deals the documents of a source to disjoint blocks of about BLOCK_ROWS. A source is drawn
   in whole passes plus, for the rest, in rounds. A round sees the undrawn documents of at most the rest: its first blocks are
   drawn whole and the block in which the rest ends is walked document by document, up to the first that does not fit. Rounds go on until no
   undrawn document fits, so a source misses its target by less than its smallest undrawn document. Each draws one document
   at least; as the order is random, about log(rows) are needed. Which blocks come first is random, as blocks are random sets.
3. Tree: the quotas of blocks of all sources are split in halves, again and again, until a leaf is an output
   shard. One seeded random order of all block draws is cut at the middle of every node: given the node's quotas, the
   left part of such a cut is a multivariate-hypergeometric draw, exactly and with exact totals. tree() shows the quotas at every node.
4. Each shard is shuffled by itself.

The only windows are over the sources, over the block totals of a source, over a bounded number of hash buckets of block draws,
over one block and over equal rows. Documents are never shuffled to be counted or drawn.

Defined cases: null text has size 0; a document without words is never drawn (taken 0); a null source comes after all
others; repeated rows are drawn one by one; an empty table gives an empty result; other columns, whatever their names, pass through mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD
from ledgerlens.session import materialize, row_count

WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
BLOCK_ROWS, SHARD_BLOCKS, RANK_BITS = 256, 16, 10
SEED = 20


def words_in(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD + "+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rows) -> with target: words that the mix takes of each source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("cap", F.col("source_size") * float(MAX_EPOCHS))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    share = (F.sum("source_size").over(everything) - before) / after
    ranked = weighted.withColumns({"share": share, "place": F.row_number().over(by_ratio)})
    fits = F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("place", "share"))
    level = F.coalesce(F.min(fits).over(everything)["share"], F.lit(0.0))
    return ranked.withColumn("level", level).select(
        "source", "source_size", "rows", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


class Mix:
    """The plan of one mix over a table with doc_id, source and text."""

    def __init__(self, docs: DataFrame, seed: int = SEED):
        self.docs, self.seed = docs, seed
        sized = docs.select("doc_id", F.col("source").alias("source"), F.xxhash64("text").alias("hash"), words_in("text").alias("size"))
        self.sized = materialize(sized, "mix-sizes")
        sizes = self.sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        self.sources = materialize(
            targets(sizes).withColumns({
                "blocks": F.ceil(F.col("rows") / BLOCK_ROWS),
                "passes": F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(F.col("target") / F.col("source_size")))).otherwise(0),
            }).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")
        self.filled = self._fill()
        self.blocks = materialize(
            self.drawn(self.sized).groupBy("source", "block").agg(F.max("copies").alias("draws")).filter("draws > 0"), "mix-blocks")

    def _placed(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """Rows with their source's line, their block and their place in it, and what the rounds so far say of them: functions of the row and that line."""
        row = F.xxhash64(F.lit(self.seed), "doc_id", "hash")
        met = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns(
            {"block": F.pmod(row, "blocks"), "place": F.xxhash64(F.lit(self.seed + 1), "doc_id", "hash")})
        key, size, block = F.struct("place", "doc_id", "hash"), F.col("size"), F.col("block")
        before = F.exists("rounds", lambda r: (size <= r["left"]) & ((block < r["block"]) | ((block == r["block"]) & F.coalesce(key < r["cut"], F.lit(False)))))
        last = F.filter("rounds", lambda r: (size <= r["left"]) & (block == r["block"]) & F.coalesce(key == r["cut"], F.lit(False)))
        # drawn once more; equal rows are, up to a number, where a round ended among them
        return met.withColumns({"more": before.cast("int"), "ties": F.when(~before, F.get(last, F.lit(0))["ties"])})

    def _fill(self) -> DataFrame:
        """The sources with what is left of their rest and the rounds that filled it: (left before, block and key of the last row drawn, equal rows of it drawn)."""
        doc_id = self.sized.schema["doc_id"].dataType.simpleString()
        rounds = f"array<struct<left:double,block:bigint,cut:struct<place:bigint,doc_id:{doc_id},hash:bigint>,ties:bigint>>"
        state = self.sources.select("source", "source_size", "target", "blocks", "passes", F.col("rest").alias("left"), F.array().cast(rounds).alias("rounds"))
        while True:
            fits = self._placed(self.sized, state).filter("size > 0 AND size <= left AND more = 0 AND ties IS NULL")
            to = F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            totals = fits.groupBy("source", "block", "left").agg(F.sum("size").alias("words")).withColumn("to", to)
            split = F.min(F.when(F.col("to") > F.col("left"), F.struct("block", (F.col("to") - F.col("words")).alias("before"))))
            ends = materialize(totals.groupBy(F.col("source").alias("s")).agg(split.alias("split"), F.sum("words").alias("words")), "mix-ends")
            if not row_count(ends):
                return state
            in_block = Window.partitionBy("source").orderBy("place", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            walked = fits.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("split.block"))).withColumn(
                "up_to", F.sum("size").over(in_block)).filter(F.col("up_to") <= F.col("left") - F.col("split.before"))
            walked = walked.groupBy("source", F.struct("place", "doc_id", "hash").alias("cut")).agg(F.count("*").alias("ties"), F.sum("size").alias("size"))
            walked = walked.groupBy(F.col("source").alias("w")).agg(F.max(F.struct("cut", "ties")).alias("last"), F.sum("size").alias("walked"))
            used = F.when(F.col("split").isNull(), F.col("words")).otherwise(F.col("split.before") + F.coalesce("walked", F.lit(0)))
            this = F.struct("left", F.coalesce("split.block", "blocks").alias("block"), F.col("last.cut").alias("cut"), F.col("last.ties").alias("ties"))
            met = state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").join(walked, F.col("source").eqNullSafe(F.col("w")), "left")
            state = materialize(met.withColumns({
                "rounds": F.when(F.col("words").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(this).cast(rounds))),
                "left": F.col("left") - F.coalesce(used, F.lit(0))}).select(*state.columns), "mix-rounds")

    def drawn(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, source, hash, size, ...) with block and copies, how often each is taken."""
        met = self._placed(rows, self.filled)
        equal = Window.partitionBy("source", "place", "doc_id", "hash")
        tied = met.filter("ties IS NOT NULL").withColumn("more", (F.row_number().over(equal.orderBy("block")) <= F.col("ties")).cast("int"))
        copies = F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0).cast("int")
        return met.filter("ties IS NULL").unionByName(tied).withColumn("copies", copies).drop("passes", "left", "rounds", "more", "ties", "blocks", "place")

    def shards(self) -> DataFrame:
        """(source, block, copy, shard): the leaf of every block draw; copy counts from 1."""
        draws = self.blocks.select("source", "block", F.explode(F.sequence(F.lit(1), "draws")).alias("copy"))
        key = F.xxhash64(F.lit(self.seed + 2), "source", "block", "copy")
        draws = draws.withColumn("key", key).withColumn("bucket", F.shiftrightunsigned("key", 64 - RANK_BITS))
        counts = draws.groupBy("bucket").count()
        up_to = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        total = F.sum("count").over(Window.partitionBy())
        offsets = counts.select(F.col("bucket"), F.coalesce(F.sum("count").over(up_to), F.lit(0)).alias("before"), total.alias("total"))
        inside = Window.partitionBy("bucket").orderBy("key", "source", "block", "copy")
        # 2 ** RANK_BITS lines at most
        ranked = draws.join(F.broadcast(offsets), "bucket").withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("total") / SHARD_BLOCKS))).cast("int")
        leaves = F.expr("shiftleft(1L, depth)")
        return ranked.withColumn("depth", depth).select(
            "source", "block", "copy", "depth", F.floor(F.col("rank") * leaves / F.col("total")).cast("int").alias("shard"))

    def tree(self) -> DataFrame:
        """(level, node, source, quota): block quotas at every node; a node's quotas are the sums of its two children's."""
        level = F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("level")
        return self.shards().select("source", "shard", "depth", level).select(
            "level", F.expr("shiftright(shard, depth - level)").alias("node"), "source").groupBy("level", "node", "source").agg(F.count("*").alias("quota"))

    def digest(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every row; taken counts the copies that the tree deals to a shard."""
        leaves = self.shards().groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.collect_list("copy").alias("dealt"))
        rows = self.drawn(self.sized).join(leaves, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
        copies = F.when(F.col("dealt").isNull(), 0).otherwise(F.size(F.filter("dealt", lambda copy: copy <= F.col("copies"))))
        return rows.select(
            F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"))

    def mixture(self) -> DataFrame:
        """The drawn rows with the columns of the table, dealt to shards and shuffled in each."""
        rows = self.docs.select(
            F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("hash"), words_in("text").alias("size"),
            F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"))
        drawn = self.drawn(rows).filter("copies > 0").select("source", "block", "row", "doc_id", "hash", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        leaves = self.shards().select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("copy").alias("c"), "shard")
        same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("copy") == F.col("c"))
        order = F.xxhash64(F.lit(self.seed + 3), "doc_id", "hash", "copy")
        dealt = drawn.join(leaves, same).withColumn("order", order).repartition("shard").sortWithinPartitions("shard", "order")
        return dealt.select(*[F.col("row")[c].alias(c) for c in self.docs.columns])


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows, each as often as it is drawn, with their columns as they are."""
    return Mix(docs).mixture()
