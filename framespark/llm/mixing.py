"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source has a shuffled stream of its documents, repeated as often as needed. Slot i of the mix maps the golden-
ratio point frac((i + 1/2) / phi) through the cumulative target shares to a source; the rank of the slot among those of its
source names the block of that source's stream that fills it. Any run of slots holds each source in nearly its share.
Golden-ratio counts stay within a few blocks of the target; closing slots bring each source to its target in whole words.

Running sums are taken in two steps, within hash buckets of a source and over the buckets, so no task gets all rows of
a source. Blocks and documents meet in an equi-join on (source, bin of the stream).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.llm.common import WORD, stash, work_dir

MAX_REPEAT = 3
#: Words of a block; smaller in a small corpus, so that it too has so many slots.
BLOCK_WORDS, LEAST_SLOTS = 256, 1 << 14
#: Documents of a hash bucket, slots of a chunk, and bins of the unit interval.
BUCKET_DOCS, CHUNK_SLOTS, GRID = 4096, 1 << 16, 1024
PHI = 0.6180339887498949  # fractional part of the golden ratio
PHI_20 = (PHI * (1 << 20)) % 1.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each text and its hash; null texts have 0 words."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target, lo, hi, n_docs, total): one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... They share 100% of all words by weight; a target
    stops at three times its source's size and the excess is reshared by weight. lo and hi are cumulative shares.
    The common level L with sum(min(3 size, L weight)) = total is found by one pass in order of 3 size / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, no more
    everything = Window.partitionBy()
    per = (
        per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("cap", F.col("source_size") * MAX_REPEAT)
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source below its cap holds for all that follow
    per = per.withColumn("final", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    hi = F.sum(share).over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumn("hi", hi)
    return per.select("source", "source_size", "weight", "target", (F.col("hi") - share).alias("lo"), "hi", "n_docs", "total")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def schedule(targets: DataFrame, total: int) -> DataFrame:
    """(slot, source, rank, begin, end): the slots of the mix and the words of the source's endless stream that fill each.

    Slots from n_slots on are closing slots: what the schedule leaves between a source's blocks and its target.
    """
    spark = targets.sparkSession
    block = block_words(total)
    n = -(-total // block)
    hi, lo = F.floor(F.col("slot") / (1 << 20)), F.col("slot") % (1 << 20)
    # i * phi in two parts, so that the fraction keeps its bits however many slots there are
    u = (F.lit(PHI / 2) + (hi * F.lit(PHI_20)) % 1.0 + (lo * F.lit(PHI)) % 1.0) % 1.0
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", u).withColumn("cell", F.floor(F.col("u") * GRID))
    cells = targets.where("hi > lo").select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.floor(F.col("hi") * GRID))).alias("cell"))
    placed = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "source", F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    counts = placed.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(offsets, _same(ranked["source"], offsets["_s"]) & (ranked["chunk"] == offsets["_c"]))
    ranked = ranked.select("slot", "source", (F.col("nth") + F.col("offset")).alias("rank"))
    goal = targets.select(F.col("source").alias("_s"), F.floor(F.col("target") + 0.5).alias("goal"))
    begin = F.col("rank") * block
    filled = ranked.join(goal, _same(ranked["source"], goal["_s"])).where(begin < F.col("goal"))
    filled = filled.select("slot", "source", "rank", begin.alias("begin"), F.least(begin + block, F.col("goal")).alias("end"))
    got = counts.groupBy("source").agg((F.sum("n") * block).alias("got"))
    got = goal.join(got, _same(goal["_s"], got["source"]), "left").select(F.col("_s").alias("source"), "goal", F.coalesce("got", F.lit(0)).alias("got"))
    more = got.where("goal > got").withColumn("begin", F.explode(F.sequence(F.col("got"), F.col("goal") - 1, F.lit(block).cast("long"))))
    # closing slots are few per source; they follow the schedule in order of source
    closing = more.select(
        (F.lit(n) + F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last(), "begin")) - 1).alias("slot"),
        "source", F.floor(F.col("begin") / block).alias("rank"), "begin", F.least(F.col("begin") + block, F.col("goal")).alias("end"),
    )
    return filled.union(closing)


def block_words(total: int) -> int:
    return max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))


def streams(sizes: DataFrame, n_docs: int) -> DataFrame:
    """sizes plus lo: words of the source before the document, in the source's shuffled order."""
    buckets = -(-n_docs // BUCKET_DOCS) or 1
    order = F.xxhash64(F.lit(20), "doc_id", "h")
    rows = sizes.withColumn("order", order).withColumn("bucket", F.floor((F.shiftrightunsigned("order", 11) / F.lit(2.0**53)) * buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(sums, _same(rows["source"], sums["_s"]) & (rows["bucket"] == sums["_b"]))
    return rows.select("doc_id", "source", "size", "h", (F.col("before") + F.col("upto") - F.col("size")).alias("lo"))


def mixed_sizes(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, taken, lo, first_slot, last_slot): one row per row of docs.

    taken counts repeats; first_slot and last_slot are the slots of the schedule that take the document first and last,
    lo its place in its source's stream; all three are null where nothing is taken.

    Null texts have no words and none are taken; a null source is a source of its own; rows that repeat a doc_id are
    documents of their own; other columns are ignored; an empty table gives no rows. The order of documents and the
    schedule depend on the rows alone, so reruns agree.
    """
    return _mix(docs, folder)[0]


def _mix(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The result of mixed_sizes, the slots of the schedule, and the words of a block."""
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    sizes = stash(sized(docs), folder, "sizes")
    targets = stash(source_targets(sizes), folder, "targets")
    total, n_docs = targets.agg(F.coalesce(F.max("total"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    block = block_words(total)
    placed = stash(streams(sizes.where("size > 0"), n_docs), folder, "streams")
    slots = schedule(targets, total)

    size = targets.select(F.col("source").alias("_s"), F.col("source_size").alias("_n"))
    turns = slots.join(size, _same(slots["source"], size["_s"])).withColumn("turn", F.explode(F.expr("sequence(begin div _n, (end - 1) div _n)")))
    base = F.col("turn") * F.col("_n")
    pieces = turns.select("slot", "source", (F.greatest(F.col("begin"), base) - base).alias("lo"), (F.least(F.col("end"), base + F.col("_n")) - base).alias("hi"))

    def cut(df: DataFrame) -> DataFrame:
        """Split [lo, hi) at the bin borders."""
        df = df.withColumn("bin", F.explode(F.expr(f"sequence(lo div {block}, (hi - 1) div {block})")))
        return df.withColumns({"a": F.greatest(F.col("lo"), F.col("bin") * block), "b": F.least(F.col("hi"), (F.col("bin") + 1) * block)})

    of_docs = cut(placed.withColumn("hi", F.col("lo") + F.col("size"))).select("doc_id", "h", "source", "size", "lo", "bin", "a", "b")
    of_slots = cut(pieces).groupBy("source", "bin", "a", "b").agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    of_slots = of_slots.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), F.col("a").alias("_lo"), F.col("b").alias("_hi"), "times", "first", "last")
    hit = of_docs.join(of_slots, _same(of_docs["source"], of_slots["_s"]) & (of_docs["bin"] == of_slots["_b"]), "left")
    words = F.coalesce(F.greatest(F.least("b", "_hi") - F.greatest("a", "_lo"), F.lit(0)) * F.col("times"), F.lit(0))
    used = lambda c: F.when(words > 0, F.col(c))
    taken = hit.groupBy("source", "lo", "doc_id", "h", "size").agg(F.sum(words).alias("taken"), F.min(used("first")).alias("first_slot"), F.max(used("last")).alias("last_slot"))
    null = F.lit(None).cast("long")
    none = sizes.where("size = 0").select("source", null, "doc_id", "h", "size", F.lit(0).cast("long"), null, null)
    info = targets.select(F.col("source").alias("_s"), "source_size", "target")
    out = taken.union(none)
    out = out.join(info, _same(out["source"], info["_s"]), "left")
    return out.select("doc_id", "h", "source", "size", "source_size", "target", "taken", "lo", "first_slot", "last_slot"), slots, block


def mixed_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of docs as the mix takes them, in order of the schedule: a row for each whole time, and one cut to the words
    taken in part.

    A row stands in the slot that its first word fills. Documents of which nothing is taken go, also those without a
    word. Rows that repeat doc_id and text are one document. The text of a cut document is its first words joined by
    blanks.
    """
    sizes, slots, block = _mix(docs, folder)
    took = sizes.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("source").alias("_source")).agg(
        F.max("size").alias("_size"), F.sum("taken").alias("_taken"), F.min("lo").alias("_lo"), F.max("source_size").alias("_n")
    )
    took = took.where("_taken > 0").withColumn("_turn", F.explode(F.expr("sequence(0L, (_taken - 1) div _size)")))
    took = took.withColumn("_rank", F.expr(f"(_lo + _turn * _n) div {block}"))
    at = slots.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), F.col("slot").alias("_slot"))
    took = took.join(at, _same(took["_source"], at["_s"]) & (took["_rank"] == at["_r"]), "left")
    # columns are numbered meanwhile, so none can clash with a helper
    c = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    one = docs.toDF(*c.values()).withColumn("_key", F.xxhash64(c["text"]))
    first = Window.partitionBy(c["doc_id"], "_key", c["source"]).orderBy(c["text"])
    one = one.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    j = one.join(took, _same(F.col(c["doc_id"]), F.col("_id")) & (F.col("_key") == F.col("_h")) & _same(F.col(c["source"]), F.col("_source")))
    left = F.least(F.col("_taken") - F.col("_turn") * F.col("_size"), F.col("_size"))
    words = F.filter(F.split(c["text"], r"[\x20\x09-\x0D]+"), lambda x: x != "")
    text = F.when(left < F.col("_size"), F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")).otherwise(F.col(c["text"]))
    j = j.orderBy(F.col("_slot").asc_nulls_last(), "_lo", "_turn")
    return j.select(*[(text if name == "text" else F.col(at)).alias(name) for name, at in c.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, size, source_size, target, taken; then source, first_slot, last_slot."""
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "last_slot")
