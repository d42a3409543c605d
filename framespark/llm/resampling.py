"""Importance resampling towards a target distribution, with exact weights by bit-sliced aggregation.

Features are hashed runs of one and two words. A bucket's gain says how much likelier it is in the target than in the
corpus. A document's bucket counts become planes of 10,000 bits, one for each binary digit of the counts, and so do the
gains, in two's complement. The sum of count times gain is then the sum, over each plane of counts and each plane of gains,
of the bits that both have, times a power of two: ANDs and popcounts, in whole numbers. Gumbel noise from a hash of the
doc_id on top of the weights makes the highest scores a weighted sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from framespark.functions.common import global_row_number
from framespark.llm.common import CRC_SQL, CRC_TABLE_SQL, stash, work_dir

BUCKETS = 10_000
#: Gains are natural logarithms in thousandths.
SCALE = 1000
#: Documents of fewer words are never drawn.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of a text that are cut into words at once, however long the text.
PIECE = 1 << 20

#: A-Z to a-z; ASCII other than letters and digits to a blank; the bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _pieces(data: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE bytes that end at a blank."""
    at = 0
    while at < len(data):
        to = data.find(b" ", at + PIECE)
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


def count_features(text: str | None) -> tuple[int, np.ndarray]:
    """(words, occurrences by bucket) of a whole text; null has none."""
    words, counts = 0, np.zeros(BUCKETS, np.int64)
    before = None
    for piece in _pieces((text or "").encode().translate(FOLD)):
        tokens = piece.split()
        if not tokens:
            continue
        single = list(map(crc32, tokens))
        # the hash of "a b" goes on from the hash of a
        starts = single[:-1] if before is None else [before, *single[:-1]]
        pairs = map(crc32, map(b" ".__add__, tokens[1:] if before is None else tokens), starts)
        words += len(tokens)
        before = single[-1]
        for hashes in (single, list(pairs)):
            counts += np.bincount(np.array(hashes, np.int64) % BUCKETS, minlength=BUCKETS)
    return words, counts


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences by bucket over all rows. Every task sends one row a bucket at most, so the result and what is shuffled are bounded."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for value in b.column(0):
                total += count_features(value.as_py())[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = df.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of each bucket's smoothed share of the target over that of the corpus."""
    many, few = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * many / ((s + 1.0) * few))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of each value as rows of packed words: row k holds digit k of all values."""
    digits = (values >> np.arange(bits)[:, None]) & 1
    packed = np.packbits(digits.astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class GainPlanes:
    """Gains in two's complement, bit by bit; the topmost plane counts as negative."""

    def __init__(self, gain: np.ndarray):
        bits = max(int(gain.max()), -int(gain.min()) - 1, 0).bit_length() + 1
        self.bits = planes(gain, bits)
        self.power = [1 << j for j in range(bits - 1)] + [-(1 << (bits - 1))]

    def total(self, counts: np.ndarray) -> int:
        """Sum of counts times gains."""
        mine = planes(counts, int(counts.max()).bit_length())
        both = np.bitwise_count(mine[:, None, :] & self.bits).sum(axis=2, dtype=np.int64)
        return sum((1 << k) * p * n for k, row in enumerate(both.tolist()) for p, n in zip(self.power, row, strict=True))


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, plus n_words, n_features and weight (columns of these names are replaced): the floored mean of the gains of a document's features, 0 without any."""
    names = ["n_words", "n_features", "weight"]
    rest = [c for c in docs.columns if c != text and c not in names]
    table = GainPlanes(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for value in b.column(text):
                words, counts = count_features(value.as_py())
                many = max(2 * words - 1, 0)
                rows.append((words, many, table.total(counts) // many if many else 0))
            new = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *new], names=[*rest, *names])

    return docs.select(*rest, text).mapInArrow(run, StructType([*(docs.schema[c] for c in rest), *(StructField(c, LongType()) for c in names)]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from the first 32 bits of the SHA-256 of "seed:doc_id"; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS, folder: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of docs(doc_id, text); target has a column text.

    rank numbers the drawn rows by falling score, then doc_id (nulls last); it is null for the others. Drawn are ``percent``
    of the rows of at least ``min_words`` words. Null and empty texts weigh 0 and are too short; rows that repeat a doc_id
    are judged one by one; other columns are ignored. An empty corpus gives an empty table; without a target every
    bucket counts once there. The scores (no texts) are written to the shared folder, and the ranks come from a range
    partitioning, so no task sorts all rows.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs.select("doc_id", "text"), gain).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    scored = stash(scored, folder or work_dir(docs.sparkSession), "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    keys = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long")
    ranked = global_row_number(able, keys, "_at").withColumn("rank", rank).drop("_at")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resampled_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of docs with all their columns, whose doc_ids must be distinct, in no order; columns may have any names."""
    ranks = importance_ranks(docs, target, percent, seed, min_words).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ranks, docs["doc_id"].eqNullSafe(ranks["_drawn"]), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: doc_id, n_features, weight, score, rank; then n_words."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_ranks(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


SQL = f"""
with recursive {CRC_TABLE_SQL},
texts as (
  select 'd' as side, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), words as (
  select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts
), feats as (
  select side, id, unnest(w) as f from words
  union all
  select side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words where len(w) > 1
), n as (select side, id, f, count(*) as n from feats group by all),
hashed as (
  select f, {CRC_SQL} % 10000 as bucket from (select distinct f from n), tab
), cells as (select side, id, bucket, sum(n)::bigint as n from n join hashed using (f) group by all),
sides as (select bucket, coalesce(sum(n) filter (side = 'd'), 0)::double as s, coalesce(sum(n) filter (side = 'b'), 0)::double as t from cells group by bucket),
totals as (select sum(s) as s_all, sum(t) as t_all from sides),
gain as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from sides, totals),
sums as (select id, sum(n)::bigint as n_features, sum(n * gain)::hugeint as total from cells join gain using (bucket) where side = 'd' group by id),
scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features,
    coalesce(case when total >= 0 then total // n_features else -((n_features - 1 - total) // n_features) end, 0)::bigint as weight
  from documents join words on words.side = 'd' and words.id = doc_id left join sums on sums.id = doc_id
), noisy as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from scored
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as many from noisy where n_words >= 20
)
select noisy.doc_id, n_features, weight, score, case when r <= (25 * many) // 100 then r end as rank, n_words::bigint as n_words
from noisy left join ranked using (doc_id)
"""
