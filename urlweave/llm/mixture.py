"""Mixing sources to target weights: fixed-length blocks, shard draws, index permutations, a join by index.

* Sizes are words. Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the total of all
  sizes; a source's target stops at ``MAX_EPOCHS`` times its size and the excess is shared again by weight. The
  shares come from one ordered pass over the sources' totals: sources are capped in order of size by weight.
* The words of a source, in the order of (id, size, text hash), are packed into blocks of ``BLOCK_WORDS``; a block
  holds segments (row, first word, words). Offsets are sums in two levels, over buckets of rows and inside each.
* The mix has one slot for each block that the targets ask for, in shards of ``SHARD_SLOTS``. Every slot draws its source
  by the targets' shares (a hash of the slot's place falls into one source's part of all slots), which makes a shard's
  source counts a multinomial draw. Running sums of the counts number each source's slots across the shards.
* The remainder is corrected: what a source has drawn beyond its target is handed, in order, to the sources that have
  drawn less. Those slots are about the square root of all; they keep their shards, and every source meets its target
  to within a block.
* A source's j-th slot takes block P(j mod blocks), where P is a permutation of that source's block indices for
  epoch j div blocks; slots and blocks meet in a join by (source, index). No block is taken more often than
  MAX_EPOCHS times.

Permutations are swap-or-not shuffles on [0, n): each round pairs x with (k - x) mod n and a hash of the larger
decides whether to swap. A source with a third of all rows is many buckets, blocks and slots, never one task.

Defined cases: a null or blank text has size 0 and is never taken; null is a source of its own, the last; a source
without words has target 0; rows that repeat are rows of their own; null ids are ordered first; an empty table gives an
empty mix; further columns pass through ``mix_documents`` whatever their names, and are not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, quoted, stage, table

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_EPOCHS = 3
SEED = 20240607

#: Rows of a bucket, on average: what one task orders at a time.
BUCKET_ROWS = 2048

#: Slots or cells that one generated row makes at most.
CHUNK = 1 << 14

#: Whole numbers of a cell when numbers look up the range that holds them: as many ranges at most are tried.
CELL = 64

#: Terms that one task sums in order, of a running sum.
RUN = 4096

ROUNDS = 14


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def permuted(x: Column, n: Column, *key: Column | int) -> Column:
    """The image of x under the keyed swap-or-not shuffle of [0, n)."""
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]
    rounds = F.array(*(F.struct(F.lit(r).alias("r"), F.pmod(F.xxhash64(*keys, F.lit(r)), n).alias("k")) for r in range(ROUNDS)))

    def step(at: Column, turn: Column) -> Column:
        other = F.pmod(turn["k"] - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), turn["k"], turn["r"]).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("bigint"), step)


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of equal keys whose ``order`` (whole numbers) is smaller.

    In two levels: groups of RUN numbers, and inside each, so no task orders all terms of a hot key.
    """
    grouped = df.withColumn("_run", F.expr(f"{order} div {RUN}"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = grouped.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, "_run", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = grouped.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return told.join(sums, [*keys, "_run"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_run", "_before", "_inside")


def spread(df: DataFrame, n: Column, name: str) -> DataFrame:
    """A row for each of the numbers 0 to n - 1, in two steps, so that no array is longer than CHUNK; none for n = 0."""
    chunks = df.withColumn("_n", n.cast("bigint")).where("_n > 0").withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK})")))
    dealt = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*chunks.columns))
    return dealt.withColumn(name, F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(_n, (_chunk + 1) * {CHUNK}) - 1)"))).drop("_n", "_chunk")


def located(points: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """``points`` with the columns of the one of ``ranges`` (low to high - 1, disjoint) that holds ``value``."""
    first = F.expr(f"low div {CELL}")
    cells = spread(ranges.where("high > low"), F.expr(f"(high - 1) div {CELL}") - first + 1, "_cell").withColumn("_cell", F.col("_cell") + first)
    # The planner can't see how many cells a range makes and would broadcast them.
    return points.withColumn("_cell", F.expr(f"{value} div {CELL}")).hint("merge").join(cells, "_cell").where(f"{value} >= low and {value} < high").drop("_cell", "low", "high")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to source_size, target and the number of the source in order.

    A window over the sources' totals: a row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", (F.col("at") % 3 + 1).cast("double"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "at")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * MAX_EPOCHS).over(before), F.lit(0))
    share = left * F.col("weight") / F.sum("weight").over(after)
    capped = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("is_capped", share >= F.col("source_size") * MAX_EPOCHS)
    # Capped sources come first in this order; the first that isn't sets the level for all after it.
    level = F.min(F.when(~F.col("is_capped"), F.struct(F.col("source_size") / F.col("weight"), "at", "level"))).over(everything)["level"]
    leveled = capped.withColumn("open_level", level)
    target = F.when(F.col("is_capped"), (F.col("source_size") * MAX_EPOCHS).cast("double")).otherwise(F.col("weight") * F.col("open_level"))
    return leveled.select("source", F.col("at").cast("bigint").alias("source_at"), "source_size", target.alias("target"))


class Mix:
    """The staged tables of one mix: rows, sources, blocks and taken slots."""

    def __init__(self, docs: DataFrame, seed: int = SEED, rid: Column | None = None):
        """rid: a number for every row that is the same at every reading, if ``docs`` has one."""
        self.seed = seed
        number = F.monotonically_increasing_id() if rid is None else rid
        self.rows = stage(docs.select(number.alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source"), words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix_rows")
        sizes = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        per_source = source_targets(sizes)
        blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("bigint")
        slots = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), F.col("blocks") * MAX_EPOCHS)).otherwise(F.lit(0))
        counted = per_source.withColumn("blocks", blocks).withColumn("slots", slots)
        order = Window.orderBy("source_at")
        self.sources = stage(counted.withColumn("first_slot", F.sum("slots").over(order) - F.col("slots")), "mix_sources")
        self.all_slots = self.sources.agg(F.sum("slots")).first()[0] or 0
        self.counts = stage(self.drawn(), "mix_counts")

    def drawn(self) -> DataFrame:
        """How many slots of each shard drew each source: shard, source_at, drawn."""
        places = self.rows.sparkSession.range(self.all_slots).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64(F.lit(self.seed), "id"), F.lit(max(1, self.all_slots))).alias("draw"))
        ranges = self.sources.select(F.col("first_slot").alias("low"), (F.col("first_slot") + F.col("slots")).alias("high"), "source_at")
        return located(places, "draw", ranges).groupBy("shard", "source_at").agg(F.count("*").alias("drawn"))

    def segments(self) -> DataFrame:
        """Every row's words cut by the blocks of its source: source_at, block, rid, first_word, words."""
        buckets = max(1, -(-self.rows.count() // BUCKET_ROWS))
        rows = self.rows.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_hash"), F.lit(buckets)))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        numbered = sums.join(self.sources.select("source", "source_at"), sums["source"].eqNullSafe(self.sources["source"])).select("source_at", sums["source"].alias("of_source"), F.col("bucket").alias("of_bucket"), "words")
        starts = running(numbered, ["source_at"], "of_bucket", "words", "start")
        inside = Window.partitionBy("source", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_hash", "rid").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        placed = placed.join(starts, placed["source"].eqNullSafe(starts["of_source"]) & (F.col("bucket") == F.col("of_bucket"))).withColumn("begin", F.col("start") + F.col("offset"))
        cut = placed.select("source_at", "rid", "size", "begin", F.explode(F.expr(f"sequence(begin div {BLOCK_WORDS}, (begin + size - 1) div {BLOCK_WORDS})")).alias("block"))
        low = F.greatest(F.col("begin"), F.col("block") * BLOCK_WORDS)
        high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
        return cut.select("source_at", "block", "rid", (low - F.col("begin")).alias("first_word"), (high - low).alias("words"))

    def blocks(self) -> DataFrame:
        """A row for each block, with its segments in order: at most BLOCK_WORDS of them."""
        segment = F.struct("rid", "first_word", "words")
        return self.segments().groupBy("source_at", "block").agg(F.collect_list(segment).alias("segments"))

    def numbered(self) -> DataFrame:
        """The slots as stretches: in shard, the source has n slots, its j0-th and those that follow."""
        drawn = self.counts.groupBy("source_at").agg(F.sum("drawn").alias("all_drawn"))
        totals = self.sources.select("source_at", "slots").join(drawn, "source_at", "left").withColumn("all_drawn", F.coalesce("all_drawn", F.lit(0).cast("bigint")))
        before = Window.orderBy("source_at").rowsBetween(Window.unboundedPreceding, -1)
        over, under = F.greatest(F.col("all_drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("all_drawn"), F.lit(0))
        totals = stage(totals.withColumns({"over": over, "under": under}).withColumns({"first_over": F.coalesce(F.sum("over").over(before), F.lit(0)), "low": F.coalesce(F.sum("under").over(before), F.lit(0))}), "mix_totals")
        counts = running(self.counts, ["source_at"], "shard", "drawn", "j0").join(totals.select("source_at", "slots", "first_over"), "source_at")
        own = counts.select("shard", "source_at", "j0", F.least("drawn", F.col("slots") - F.col("j0")).alias("n")).where("n > 0")
        # What the source drew beyond its target, numbered across the sources.
        beyond = counts.withColumn("from", F.greatest("j0", "slots")).where("j0 + drawn > slots")
        spare = spread(beyond.select("shard", (F.col("first_over") + F.col("from") - F.col("slots")).alias("first"), (F.col("j0") + F.col("drawn") - F.col("from")).alias("many")), F.col("many"), "k").select("shard", (F.col("first") + F.col("k")).alias("spare"))
        wanting = totals.select("low", (F.col("low") + F.col("under")).alias("high"), "source_at", (F.col("all_drawn") - F.col("low")).alias("shift"))
        handed = located(spare, "spare", wanting).select("shard", "source_at", (F.col("spare") + F.col("shift")).alias("j0"), F.lit(1).cast("bigint").alias("n"))
        return own.unionByName(handed)

    def slots(self) -> DataFrame:
        """A row for each slot of the mix: shard, source_at, epoch, block."""
        # Staged, as the parts are: the driver plans again after each exchange, at a cost that grows with the whole plan.
        each = spread(stage(self.numbered(), "mix_stretches").join(self.sources.select("source_at", "blocks"), "source_at"), F.col("n"), "k").withColumn("j", F.col("j0") + F.col("k"))
        epoch = F.expr("j div blocks")
        block = permuted(F.expr("j % blocks"), F.col("blocks"), self.seed, F.col("source_at"), epoch)
        return each.select("shard", "source_at", epoch.alias("epoch"), block.alias("block"))

    def mixed(self) -> DataFrame:
        """The mix: every slot, in its shard, with the segments of its block."""
        # The planner can't see how many slots a stretch makes and would broadcast them.
        return self.slots().hint("merge").join(self.blocks(), ["source_at", "block"])

    def taken(self) -> DataFrame:
        """rid, and the words that the mix takes of that row, repeats counted."""
        return self.mixed().select(F.explode("segments").alias("s")).groupBy("s.rid").agg(F.sum("s.words").alias("taken"))

    def by_row(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for every row."""
        of = self.sources.select(F.col("source").alias("of_source"), "source_size", "target")
        rows = self.rows.join(of, F.col("source").eqNullSafe(F.col("of_source")))
        return rows.join(self.taken(), "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``: copy k of a row holds the words of
    those of its blocks that are taken at least k times, with the white space before each; a row none of whose blocks
    is taken goes. A copy that is whole keeps its text as it is."""
    row, parts_at, copy = (fresh(docs, x) for x in ("_mix_row", "_mix_parts", "_mix_copy"))
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "mix_docs")
    mix = Mix(numbered, seed, F.col(row))
    times = mix.mixed().select(F.explode("segments").alias("s")).groupBy("s.rid", "s.first_word", "s.words").agg(F.count("*").alias("times"))
    parts = stage(times.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("first_word", "words", "times"))).alias(parts_at)), "mix_parts")
    copies = numbered.join(parts.withColumnRenamed("rid", row), row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max(F.col(f"{parts_at}.times")))))
    copies = copies.withColumn(parts_at, F.filter(parts_at, lambda p: p["times"] >= F.col(copy)))
    spaced = F.regexp_extract_all("text", F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(parts_at, lambda p: F.slice(spaced, p["first_word"].cast("int") + 1, p["words"].cast("int")))), "")
    whole = F.aggregate(F.col(f"{parts_at}.words"), F.lit(0).cast("bigint"), lambda x, y: x + y) == words_in(F.col("text"))
    text = F.when(whole, F.col("text")).otherwise(cut)
    copies = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return copies.select(*map(quoted, docs.columns))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return Mix(table(spark, sf_dir, "documents")).by_row()
