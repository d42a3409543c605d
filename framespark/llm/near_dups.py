"""Near-duplicate documents: BagMinHash signatures of shingle multisets, banded candidates, exact multiset overlap.

A document is the multiset of its runs of five words. BagMinHash lets every shingle of weight w emit the points of a
Poisson process on [0, w): dyadic blocks of the weight axis have a process each, whose points are placed by hash bits,
and those at or above w are thinned out, so equal parts of two weights share their points whatever the rest. Each point
falls on one signature component; the earliest stays. Equal components estimate the weighted Jaccard similarity.

Bands of the signature name candidates. Documents linked through buckets form loose families. A family of up to a block
of documents is compared in one task. A larger one is dealt into blocks by a hash of the id, and once more by another
hash if it still falls in several classes; each time a document goes to one block only, and pairs whose classes are joined
already are skipped. What is left is settled by family, or by bucket if many are left: documents outside its largest class
meet all of it, block by block.
Pairs that could reach the similarity are verified on the multisets, and a task returns one link for two classes that it
joins, so links and what is shuffled grow with the size of a family. Exact copies are set aside first and share their
representative's class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.llm.common import Words, bound_batches, components, mix, ragged, runs_of, salted_join, slices, stash, text_bytes, work_dir

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
#: A pair is verified if so many components agree: 4.5 standard deviations below the similarity asked for.
AGREE = math.floor(M * SIMILARITY - 4.5 * math.sqrt(M * SIMILARITY * (1 - SIMILARITY)))
#: Documents, and shingles, of a block of a family.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20
#: Times that a large family is dealt into blocks anew before its buckets are settled.
MIX_ROUNDS = 1
KEY_BITS = np.uint64(44)
KEY_MASK = np.uint64((1 << 44) - 1)
_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def shingle_multisets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document row, shingle key, count), sorted; a document of one to four words has one shingle, all of them."""
    data, off = text_bytes(col)
    w = Words(data, off)
    n = len(off) - 1
    at, h = w.windows(SHINGLE)
    docs, keys = [w.doc[at]], [h]
    for k in range(1, SHINGLE):
        if (w.per_doc == k).any():
            at, h = w.windows(k)
            own = w.per_doc[w.doc[at]] == k
            docs.append(w.doc[at][own])
            keys.append(h[own])
    key = (np.concatenate(docs).astype(np.uint64) << KEY_BITS) | (np.concatenate(keys) & KEY_MASK)
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    return (key[new] >> KEY_BITS).astype(np.int64), key[new] & KEY_MASK, count, n


def bag_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m) uint32 signatures of n weighted sets given as (doc, key, integer weight); rows without elements are 0."""
    total = np.bincount(doc, weights=weight, minlength=n)
    blocks = np.ceil(np.log2(weight)).astype(np.int64) + 1
    of = np.repeat(np.arange(len(key)), blocks)
    level = ragged(np.zeros(len(key), np.int64), blocks)
    seed = mix(key[of] * _C1 + level.astype(np.uint64) * _C2)
    width = np.where(level > 0, 2 ** np.maximum(level - 1, 0), 1)
    low = np.where(level > 0, width, 0)
    top, d = weight[of], doc[of]
    # by this time all components of a document have a point, but for a chance of e**-4
    horizon = (math.log(m) + 4) * m / np.maximum(total, 1)
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    todo = total > 0
    while todo.any():
        act = np.flatnonzero(todo[d])
        t = np.zeros(len(act))
        j = 0
        while len(act):
            many = 1 if len(act) > 20_000 else 32
            step = (np.arange(j, j + many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * _C3
            r = mix(seed[act][:, None] + step)
            gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width[act][:, None]
            times = t[:, None] + np.cumsum(gap, axis=1)
            row, c = np.nonzero(times <= horizon[d[act]][:, None])
            s = act[row]
            p = mix(r[row, c] ^ _C1)
            lev = low[s] + (p & np.uint64(0xFFFFFFFF)).astype(np.int64) % width[s]
            ok = lev < top[s]
            s, p, when = s[ok], p[ok], times[row, c][ok]
            slot = d[s] * m + ((p >> np.uint64(40)) % np.uint64(m)).astype(np.int64)
            early = np.minimum(when / horizon[d[s]] * 2.0**32, 2.0**32 - 1).astype(np.uint64)
            np.minimum.at(best, slot, (early << np.uint64(32)) | (p & np.uint64(0xFFFFFFFF)))
            on = times[:, -1] <= horizon[d[act]]
            act, t = act[on], times[on, -1]
            j += many
        open_ = (best.reshape(n, m) == np.iinfo(np.uint64).max).any(axis=1) & todo
        best.reshape(n, m)[open_] = np.iinfo(np.uint64).max
        horizon[open_] *= 3
        todo = open_
    sig = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, m)
    sig[total == 0] = 0
    return sig


def _binary(parts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds the next counts[i] items of parts."""
    off = np.concatenate(([0], np.cumsum(counts * parts.dtype.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(parts))])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) int64 keys; the band's number is part of the hash."""
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _C2 + np.zeros((len(sig), 1), np.uint64)
    for i in range(ROWS):
        h = mix(h ^ (x[:, :, i] * _C1))
    return h.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        doc, key, count, n = shingle_multisets(b.column("text"))
        size = np.bincount(doc, minlength=n)
        bands = band_keys(bag_min_hash(doc, key, count, n))
        has = size > 0  # texts without a word are only ever exact copies
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * BANDS))), pa.int32()), pa.array(bands[has].ravel()))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), lists], names=["id", "size", "bands"])


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        doc, key, count, n = shingle_multisets(b.column("text"))
        size = np.bincount(doc, minlength=n)
        sig = bag_min_hash(doc, key, count, n)
        cols = [_binary(sig.ravel(), np.full(n, M)), _binary(key, size), _binary(count.astype(np.uint32), size)]
        yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", "sig", "keys", "counts"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted multisets (keys, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    both = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _pairs(rows: dict[str, list], sig: np.ndarray, weight: np.ndarray, across: bool) -> np.ndarray:
    """(i, j, equal components) of the rows worth verifying: classes differ and signatures and sizes are near.

    Across, stragglers (side 0) meet members (side 1); in a bucket (number nth, else -1) a pair counts if no earlier one
    holds it.
    """
    cls, side = np.array(rows["cls"]), np.array(rows["side"])
    found = []
    inner = np.flatnonzero(side == 1) if across else np.arange(len(cls))
    for n, i in enumerate(np.flatnonzero(side == 0)):
        other = inner if across else inner[n + 1 :]
        other = other[cls[other] != cls[i]]
        other = other[np.minimum(weight[other], weight[i]) >= SIMILARITY * np.maximum(weight[other], weight[i]) - 1e-9]
        equal = sig[other] == sig[i]
        same = equal.sum(axis=1)
        near = same >= AGREE
        if across and rows["nth"][i] >= 0:
            near &= equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == rows["nth"][i]
        other, same = other[near], same[near]
        found.append(np.stack([np.full(len(other), i), other, same], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return pairs[np.argsort(-pairs[:, 2], kind="stable")]


def _links(rows: dict[str, list], across: bool) -> list[tuple[int, int]]:
    """Pairs of classes that similar rows join; as few as join what belongs together."""
    cls = rows["cls"]
    if len(set(cls)) < 2:
        return []
    sets = [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32)) for k, c in zip(rows["keys"], rows["counts"], strict=True)]
    weight = np.array([int(c.sum()) for _, c in sets])
    sig = np.stack([np.frombuffer(s, np.uint32) for s in rows["sig"]])
    up = {c: c for c in cls}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j, _ in _pairs(rows, sig, weight, across).tolist():
        a, b = top(cls[i]), top(cls[j])
        if a != b and overlap(sets[i], sets[j]) >= SIMILARITY - 1e-12:
            up[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


_PAYLOAD = "id long, sig binary, keys binary, counts binary"
_TASK = ("group", "i", "j")


def _verify(across: bool):
    """Links (a, b) between classes, found in tasks: runs of rows with equal (group, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, _TASK):
            links = _links(rows, across)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(tasks: DataFrame, across: bool = False) -> DataFrame:
    n = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return tasks.repartition(n, *_TASK).sortWithinPartitions(*_TASK, "id").mapInArrow(_verify(across), "a long, b long")


def _joined(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """labels (id, cls) after the classes that links name have been joined."""
    comp = components(links, folder, name).withColumnRenamed("id", "cls")
    return stash(labels.join(comp, "cls", "left").select("id", F.coalesce("comp", "cls").alias("cls")), folder, f"{name}-labels")


def _blocks(n: Column, size: Column) -> Column:
    """Number of blocks for n documents with so many shingles."""
    return F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("long")


def _large_families(payload: DataFrame, placed: DataFrame, labels: DataFrame, sizes: DataFrame, bands: DataFrame, folder: str) -> DataFrame:
    """labels after the links between the blocks of families of several blocks.

    payload, sizes (id, size) and bands (id, nth, band) hold the documents of such families, placed their comp and parts.
    Stragglers come in lots of a block. With more lots than bands a family is settled bucket by bucket, so that no
    document goes out more often than that, or than its buckets have lots.
    """
    one = F.lit(0).cast("long")

    def still_open() -> DataFrame:
        """(id, comp, parts, cls) of families that fall in several classes."""
        now = placed.join(labels, "id")
        several = now.groupBy("comp").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("comp")
        return salted_join(now, several, "comp", "id")

    for r in range(1, MIX_ROUNDS + 1):
        rows = still_open().select("id", "cls", F.col("comp").alias("group"), F.pmod(F.xxhash64(F.lit(r), "id"), "parts").alias("i"), one.alias("j"), F.lit(0).alias("side"), F.lit(0).alias("nth"))
        labels = _joined(labels, _linked(payload.join(rows, "id")), folder, f"mixed-{r}")

    def with_sides(rows: DataFrame) -> DataFrame:
        """rows (id, cls, group, size) and for each group its largest class and the number of lots and of member blocks."""
        per_class = rows.groupBy("group", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        groups = per_class.groupBy("group").agg(F.max_by("cls", F.struct("n", "cls")).alias("most"), F.max("n").alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        lone = F.col("n") - F.col("top")
        groups = groups.where(lone > 0).select("group", "most", _blocks(F.col("n"), F.col("size")).alias("members"), _blocks(lone, F.col("size") * lone / F.col("n")).alias("lots"))
        return salted_join(rows, groups, "group", "id")

    def deal(rows: DataFrame) -> DataFrame:
        spread = lambda c: F.explode(F.sequence(one, F.col(c) - 1))
        own = lambda c: F.pmod(F.xxhash64(F.lit(0), "id"), c)
        lone = rows.where("cls <> most").select("id", "cls", "nth", "group", own("lots").alias("i"), spread("members").alias("j"), F.lit(0).alias("side"))
        return lone.union(rows.select("id", "cls", "nth", "group", spread("lots").alias("i"), own("members").alias("j"), F.lit(1).alias("side")))

    families = with_sides(still_open().select("id", "cls", F.col("comp").alias("group")).join(sizes, "id"))
    few = deal(families.where(F.col("lots") <= BANDS).withColumn("nth", F.lit(-1)))
    in_buckets = families.where(F.col("lots") > BANDS).select("id", "cls", "size").join(bands, "id").select("id", "cls", "nth", F.col("band").alias("group"), "size")
    return _joined(labels, _linked(payload.join(few.union(deal(with_sides(in_buckets))), "id"), across=True), folder, "last")


def near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, class_id): one row per distinct non-null doc_id; class_id is the smallest doc_id of its class.

    Classes are the connected components of exact equality and weighted Jaccard similarity >= 0.8 of five-word
    shingles. Null texts count as empty; texts without a word match only equal texts. Rows without a doc_id are left
    out; rows that repeat a doc_id count as one document. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or work_dir(spark)
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    same = base.select("id", F.unhex(F.md5("text")).alias("h"))
    rep = same.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    alike = salted_join(same, rep, "h", "id").select("id", "rep")
    member = stash(same.select("id", F.col("id").alias("rep")).union(alike).groupBy("id").agg(F.min("rep").alias("rep")), folder, "members")

    signed = base.mapInArrow(_signed, "id long, size long, bands array<long>")
    reps = member.where("id = rep").select("id")
    signed = stash(signed.join(reps, "id", "left_semi"), folder, "signed")
    rows = signed.select("id", F.explode("bands").alias("band"))
    lead = rows.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "lead")
    # a document's leads are joined through the least of them, so a large family has few edges besides one a document
    leads = salted_join(rows, lead, "band", "id").groupBy("id").agg(F.collect_set("lead").alias("leads")).withColumn("least", F.array_min("leads"))
    stars = leads.select(F.col("id").alias("a"), F.col("least").alias("b")).union(leads.select(F.explode("leads").alias("a"), F.col("least").alias("b")).distinct())
    family = components(stars, folder, "families")

    sized = family.join(signed.select("id", "size").groupBy("id").agg(F.max("size").alias("size")), "id")
    parts = sized.groupBy("comp").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("parts"))
    placed = stash(salted_join(family, parts, "comp", "id").select("id", "comp", "parts"), folder, "placed")
    payload = base.join(placed.select("id"), "id").mapInArrow(_payload, _PAYLOAD)
    one = F.lit(0).cast("long")
    rows = placed.select("id", F.col("id").alias("cls"), F.col("comp").alias("group"), F.pmod(F.xxhash64(F.lit(0), "id"), "parts").alias("i"), one.alias("j"), F.lit(0).alias("side"), F.lit(0).alias("nth"))
    labels = _joined(placed.select("id", F.col("id").alias("cls")), _linked(payload.join(rows, "id")), folder, "classes")
    large = placed.where("parts > 1")
    if not large.isEmpty():
        own = stash(base.join(large.select("id"), "id").mapInArrow(_payload, _PAYLOAD), folder, "large")
        rows = signed.join(large.select("id"), "id")
        sizes = rows.groupBy("id").agg(F.max("size").alias("size"))
        labels = _large_families(own, large, labels, sizes, rows.select("id", F.posexplode("bands").alias("nth", "band")).distinct(), folder)
    of_rep = labels.withColumnRenamed("id", "rep")
    return salted_join(member, of_rep, "rep", "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("cls", "rep").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of docs without those of which a document of the same class with a smaller doc_id exists.

    Of rows that repeat a doc_id one stays (the least text). Rows without a doc_id are kept; they can't be compared.
    """
    keep = near_duplicates(docs, folder).where("doc_id = class_id").select(F.col("doc_id").alias("keep"))
    # columns are numbered meanwhile, so none can clash with a helper
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key, text = at["doc_id"], at["text"]
    rows = docs.toDF(*at.values())
    one = Window.partitionBy("keep").orderBy(F.col(text).asc_nulls_last())
    kept = rows.join(keep, F.col(key) == F.col("keep")).withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*at.values())
    return kept.union(rows.where(F.col(key).isNull())).toDF(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size, kept (the one document of its class that stays)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    sizes = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    return salted_join(found, sizes, "class_id", "doc_id").select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
