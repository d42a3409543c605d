"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick five tokens out of a window and ignore the others, so a substituted token spoils only the windows whose
mask uses it. Hashes of all masked windows of the documents meet those of the benchmark; each hit names a document, an
item and a diagonal (where the item would start). Around every diagonal the tokens are compared one to one: an item
counts as contained if, in some run of 16 aligned tokens (or the whole item, if shorter), at least 80% agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.llm.common import stash, work_dir

#: Token offsets that each mask uses (fixed values): 11111, 111011, 1101101.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 6))
RUN = 16
SIMILARITY = 0.8
#: Hashes of the benchmark are broadcast up to this number (about 64 MB); beyond it the join shuffles.
BROADCAST_HASHES = 4_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pos and h: the hash of every masked window of the array column t that lies within it."""
    at = df.select(*keep, "t", F.posexplode("t").alias("pos", "w0"))
    hashes = []
    for i, mask in enumerate(MASKS):
        picked = [F.get("t", F.col("pos") + o) if o else F.col("w0") for o in mask]
        inside = F.col("pos") + mask[-1] < F.size("t")
        hashes.append(F.when(inside, F.xxhash64(F.lit(i), *picked)))
    return at.select(*keep, "pos", F.explode(F.array(*hashes)).alias("h")).where("h is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, matched, compared): per document and item the best diagonal that counts.

    start is the token of the document at which the item's first token would stand (negative if it is cut off), matched
    of compared tokens agree in its best run. Items of fewer than five tokens are too short to tell and match nothing,
    and a substitution in an item of up to eight can leave no mask whole, which hides it;
    null texts have no tokens; rows without a doc_id or item_id are left out; rows that repeat an id count as one with
    the union of their hits. Repeated items give a row each. Other columns are ignored; empty tables give no rows.
    """
    bench = benchmark.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("t"))
    seeds = _windows(bench, ["item_id"]).select("item_id", F.col("pos").alias("item_pos"), "h")
    keys = seeds.select("h").distinct()
    few = seeds.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("v"), "text")
    rows = _windows(texts.select("doc_id", "v", tokens(F.col("text")).alias("t")), ["doc_id", "v"])
    hits = rows.join(F.broadcast(keys) if few else keys, "h", "left_semi")
    diagonal = ["doc_id", "v", "item_id", "start"]
    found = hits.join(seeds, "h").select("doc_id", "v", "item_id", (F.col("pos") - F.col("item_pos")).alias("start")).distinct()
    found = stash(found, work_dir(docs.sparkSession), "diagonals")  # narrow, and read twice

    # every diagonal as rows of (position, token of the item), joined with the tokens at those positions of the few documents
    # that have a hit; a row is a token, so no text is too long or too repetitive
    item = bench.select("item_id", F.xxhash64("t").alias("b"), F.least(F.size("t"), F.lit(RUN)).alias("compared"), F.posexplode("t").alias("j", "token"))
    want = found.join(item, "item_id").withColumn("pos", F.col("start") + F.col("j"))
    of = texts.join(found.select("doc_id", "v").distinct(), ["doc_id", "v"], "left_semi")
    have = of.select("doc_id", "v", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).distinct()
    both = want.join(have.withColumn("agree", F.lit(1)), ["doc_id", "v", "pos", "token"], "left")
    both = both.groupBy(*diagonal, "b", "compared", "j").agg(F.coalesce(F.max("agree"), F.lit(0)).alias("agree"))
    run = Window.partitionBy(*diagonal, "b").orderBy("j")
    # runs that begin before the item end with fewer tokens than compared, so they never agree more than the first whole one
    runs = both.withColumn("matched", F.sum("agree").over(run.rowsBetween(1 - RUN, 0)).cast("int"))
    best = runs.groupBy(*diagonal, "b", "compared").agg(F.max("matched").alias("matched")).where(F.col("matched") >= F.ceil(F.col("compared") * SIMILARITY))
    top = F.max_by(F.struct("start", "matched", "compared"), F.struct("matched", -F.col("start"))).alias("top")
    return best.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.start", "top.matched", "top.compared")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, matched, compared of every benchmark item found in documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
