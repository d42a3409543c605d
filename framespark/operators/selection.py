"""Choosing frames to label: gates, anomaly, fingerprints, clusters, quotas, diverse picks; samples, splits and patch plans."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions.common import EPS, clip, global_row_number, stash, total, work_dir

#: Weights and limits (fixed values).
QUALITY = {"contrast": 0.20, "edges": 0.20, "entropy": 0.15, "range": 0.15, "sharpness": 0.15}
PRIORITY = {"anomaly": 0.30, "rarity": 0.25, "edges": 0.20, "objects": 0.15, "structure": 0.10}
PRIORITY_UNCERTAIN = {"anomaly": 0.25, "rarity": 0.20, "edges": 0.20, "objects": 0.15, "structure": 0.10, "uncertainty": 0.10}
COVERAGE = (0.0, 0.001, 0.01, 0.05, 0.2, 1.0)


def quality_gate_frames(df: DataFrame) -> DataFrame:
    """Frames of at least 24 pixels a side, contrast .01 and range .05, with their quality."""
    good = sum(F.col(k) * w for k, w in QUALITY.items()) + 0.15 * (1 - F.col("saturation"))
    return df.where("least(h, w) >= 24 and contrast >= 0.01 and range >= 0.05").withColumn("quality", good)


def anomaly_score(df: DataFrame) -> DataFrame:
    """df with anomaly: weighted clipped penalties for blur, low contrast, noise, saturation, low entropy, extreme brightness and small range."""
    lack = lambda c, t: clip((t - F.col(c)) / t)
    parts = [
        (0.30, lack("sharpness", 0.10)), (0.20, lack("contrast", 0.08)), (0.15, clip((F.col("noise") - 0.04) / 0.12)), (0.15, clip((F.col("saturation") - 0.10) / 0.40)),
        (0.08, lack("entropy", 0.35)), (0.07, clip((F.abs(F.col("brightness") - 0.5) - 0.25) / 0.25)), (0.05, lack("range", 0.25)),
    ]
    return df.withColumn("anomaly", sum(w * p for w, p in parts))


def fingerprint(px: Column, h: Column, w: Column, side: int = 16) -> Column:
    """Bits of a side x side sample of the raster against its mean, as text."""
    at = F.sequence(F.lit(0), F.lit(side * side - 1))
    y, x = lambda i: F.floor(F.floor(i / side) * h / side), lambda i: F.floor((i % side) * w / side)
    sample = F.transform(at, lambda i: F.get(px, (y(i) * w + x(i)).cast("int")))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / (side * side)
    # lists of one bind the sample and its mean to variables, so each is taken once a raster and not once a pixel
    bits = F.transform(F.array(sample), lambda s: F.transform(F.array(mean(s)), lambda m: F.array_join(F.transform(s, lambda v: F.when(v >= m, "1").otherwise("0")), "")))
    return F.get(F.get(bits, F.lit(0)), F.lit(0))


def dedupe_fingerprint(df: DataFrame, key: str = "fingerprint", quality: str = "quality", order: str = "path") -> DataFrame:
    """The row of best quality of each fingerprint, the first by path of equals. Blank frames share one key; both steps combine before the shuffle."""
    first = df.groupBy(key).agg(F.max(quality).alias("_q"))
    top = df.join(first, key).where(F.col(quality) == F.col("_q")).groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), order).alias("_r"))
    return top.select("_r.*")


def pack_bits(text: Column) -> Column:
    """A text of 0 and 1 as an array of longs of 64 bits, the last one filled with 0."""
    words = F.sequence(F.lit(0), ((F.length(text) - 1) / 64).cast("int"))
    word = lambda i: F.rpad(F.substring(text, i * 64 + 1, F.lit(64)), 64, "0")
    return F.transform(words, lambda i: F.conv(word(i), 2, -10).cast("long"))


#: Least bits of a band (four a character of text) that tells pairs apart.
MIN_BAND = 8


#: Distances that are taken at once.
NEAR_BLOCK = 1 << 20


def _bit_rows(col: pa.Array, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    """bits as a matrix of characters or words, filled with 0, and the number of each row's, -1 for null."""
    if packed:
        lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy().astype(np.int64)
        out = np.zeros((len(col), max(lengths.max(initial=1), 1)), np.uint64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    else:
        lengths = pc.fill_null(pc.utf8_length(col), -1).to_numpy().astype(np.int64)
        wide = max(int(lengths.max(initial=1)), 1)
        out = np.array(col.fill_null("").to_pylist(), dtype=f"U{wide}").view(np.uint32).reshape(len(col), wide)
    return out, lengths


def _near_pairs(keys: list[str], packed: bool, length: int, distance: float, wide: float, similarity: float):
    """Pairs (id, b, distance, similarity) of rows of a cell, and of its rows with visitors, which come after them; rows come sorted by keys and _visits."""

    def compare(xs: tuple, ys: tuple, own: bool) -> Iterator[pa.RecordBatch]:
        (ids, f, bits, sizes), (names, g, others, widths) = xs, ys
        step, w = max(NEAR_BLOCK // max(len(g), 1), 1), min(bits.shape[1], others.shape[1])
        for i in range(0, len(f), step):
            sq = np.zeros((len(f[i : i + step]), len(g)))
            for k in range(f.shape[1]):
                apart = f[i : i + step, k, None] - g[None, :, k]
                sq += apart * apart
            hit = sq <= wide * wide * (1 + 1e-9)
            if own:
                hit &= np.arange(len(g)) > np.arange(i, i + len(sq))[:, None]
            x, y = np.nonzero(hit)
            d, x = np.sqrt(sq[x, y]), x + i
            known = (sizes[x] == widths[y]) & (sizes[x] > 0)
            if packed:
                same = 1 - np.bitwise_count(bits[x, :w] ^ others[y, :w]).sum(axis=1) / length
            else:
                n = np.maximum(sizes[x], 1)
                same = ((bits[x, :w] == others[y, :w]).sum(axis=1) - (w - n)) / n
            near = np.flatnonzero((d <= distance) | ((d <= wide) & known & (same >= similarity)))
            if len(near):
                x, y, d = x[near], y[near], d[near]
                out = pa.RecordBatch.from_arrays([ids.take(pa.array(x)), names.take(pa.array(y)), pa.array(d), pa.array(same[near], mask=~known[near])], names=["id", "b", "distance", "similarity"])
                yield out.filter(pc.not_equal(out.column("id"), out.column("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for b in batches:
            cell = [b.column(c) for c in (*keys, "_visits")]
            new = np.ones(b.num_rows, bool)
            if b.num_rows:
                new[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False) for c in cell], axis=0)
            at = np.flatnonzero(new).tolist()
            for lo, hi in zip(at, [*at[1:], b.num_rows], strict=True):
                *key, visits = (c[lo].as_py() for c in cell)
                if key != now:
                    now, own = key, []
                part = b.slice(lo, hi - lo)
                f = part.column("features")
                rows = (part.column("id"), f.flatten().to_numpy(zero_copy_only=False).reshape(len(f), -1), *_bit_rows(part.column("bits"), packed))
                for ys in own:
                    yield from compare(rows, ys, False)
                if not visits:
                    yield from compare(rows, rows, True)
                    own.append(rows)

    return run


def near_duplicates(df: DataFrame, max_distance: float, min_similarity: float = 0.9, length: int | None = None) -> DataFrame:
    """(a, b, distance, similarity) of rows df(id, features array<double>, bits, cluster) of one cluster that are near.

    Near: distance <= d, or Hamming similarity >= s and distance <= 1.8 d. bits is text, compared by characters, or an array of longs
    as of pack_bits(), compared by bit_count of xor; ``length`` is its number of bits then. Pairs meet in a cell of width d of the first
    feature (its own or the next), or in one of width 1.8 d and a band of the bits: of one band more than may differ, one is equal
    (pigeonholes), so no pair is missed, and the wider cells don't compare everything. Bands of fewer than MIN_BAND characters or bits would let most pairs
    meet, many times over: then each pair meets once, in cells of width 1.8 d of the first two features. Null bits have no band; rows without features are left out.
    """
    kind = df.schema["bits"].dataType.simpleString()
    packed = kind.startswith("array")
    if packed and not length:
        raise ValueError("packed bits need their length")
    df = df.select("id", "features", "bits", "cluster").where("size(features) > 0")
    if not packed:
        length = df.agg(F.max(F.length("bits"))).head()[0] or 1
    differ = math.floor((1 - min_similarity) * length + 1e-9)
    bands = min(differ + 1, length)
    borders = [round(i * length / bands) for i in range(bands + 1)]
    if packed:
        bit = lambda k: F.getbit(F.get("bits", F.lit(k // 64)), F.lit(63 - k % 64)).cast("string")
        values = [F.concat(*[bit(k) for k in range(x, y)]) for x, y in zip(borders, borders[1:], strict=False)]
    else:
        values = [F.substring("bits", x + 1, y - x) for x, y in zip(borders, borders[1:], strict=False)]
    keys = F.array(*[F.xxhash64(F.lit(i), v) for i, v in enumerate(values)])
    first = F.get("features", F.lit(0))

    def meet(left: DataFrame, width: float, by: list[str]) -> DataFrame:
        """Pairs of rows of one cluster whose cells of a width are equal or follow each other."""
        cell = F.floor(first / width) if width > 0 else first
        l = left.withColumn("_c", F.explode(F.array(cell, cell + 1)) if width > 0 else cell)
        r = left.select(*by, "cluster", (cell + 1 if width > 0 else cell).alias("_c"), F.col("id").alias("b"), F.col("features").alias("fb"), F.col("bits").alias("bb"))
        return l.join(r, [*by, "cluster", "_c"]).where("id <> b").select("id", "b", "features", "fb", "bits", "bb")

    dist = F.sqrt(F.aggregate(F.zip_with("features", "fb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    if packed:
        same = 1 - F.aggregate(F.zip_with("bits", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v) / length
    else:
        same = F.aggregate(F.zip_with(F.split("bits", ""), F.split("bb", ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.length("bits")
    scored = lambda j: j.withColumns({"distance": dist, "similarity": same})
    pair = lambda j: j.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), "distance", "similarity")
    if length < bands * MIN_BAND * (1 if packed else 0.25) and max_distance > 0:
        wide = 1.8 * max_distance
        cell = [F.floor(F.coalesce(F.get("features", F.lit(i)), F.lit(0.0)) / wide) for i in (0, 1)]
        # a row stands in its own cell and visits half of those around it, where it meets their rows a batch at a time
        places = F.array(*[F.struct((cell[0] + i).alias("_c"), (cell[1] + j).alias("_e"), F.lit(bool(i or j)).alias("_visits")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
        rows = df.where("cluster is not null and forall(features, x -> x is not null)").select("id", F.col("features").cast("array<double>").alias("features"), "bits", "cluster", F.size("features").alias("_n"), F.explode(places).alias("_at")).select("*", "_at.*").drop("_at")
        keys = ["cluster", "_n", "_c", "_e"]
        typ = df.schema["id"].dataType.simpleString()
        near = rows.repartition(*keys).sortWithinPartitions(*keys, "_visits").mapInArrow(_near_pairs(keys, packed, length, max_distance, wide, min_similarity), f"id {typ}, b {typ}, distance double, similarity double")
        # without repeated ids every pair is met once
        again = not df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        return pair(near).dropDuplicates(["a", "b"]) if again else pair(near)
    by_distance = scored(meet(df, max_distance, [])).where(F.col("distance") <= max_distance)
    banded = df.where("bits is not null").withColumn("_k", F.explode(keys))
    by_bits = scored(meet(banded, 1.8 * max_distance, ["_k"])).where((F.col("similarity") >= min_similarity) & (F.col("distance") <= 1.8 * max_distance))
    return pair(by_distance).union(pair(by_bits)).dropDuplicates(["a", "b"])


def minmax_features(df: DataFrame, column: str = "features") -> DataFrame:
    """df with each dimension of an array column scaled to [0, 1] over all rows; what isn't finite is 0, flat dimensions are 0."""
    ok = F.transform(column, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), 0.0).otherwise(x))
    d = df.withColumn(column, ok)
    b = d.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = b.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("_b"))
    scaled = F.zip_with(column, "_b", lambda x, b: (x - b["lo"]) / F.greatest(b["hi"] - b["lo"], F.lit(EPS)))
    return d.crossJoin(F.broadcast(b)).withColumn(column, scaled).drop("_b")


def normalize_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with columns scaled to [0, 1] over all rows; flat columns become 0."""
    b = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    j = df.crossJoin(F.broadcast(b))
    j = j.withColumns({c: F.when(F.col(f"_hi_{c}") - F.col(f"_lo_{c}") > EPS, (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in columns})
    return j.drop(*[f"_{s}_{c}" for c in columns for s in ("lo", "hi")])


def cluster_count(n: int, target: int | None = None) -> int:
    """2 sqrt(target), or 1.45 sqrt(n), rounded and from 1 to 10."""
    return int(np.clip(round(2 * target**0.5 if target else 1.45 * n**0.5), 1, min(10, max(n, 1))))


def cluster_frames(df: DataFrame, k: int, column: str = "features", seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """(df with cluster, centres) by k-means of 30 iterations."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.withColumn("_v", array_to_vector(column))
    model = KMeans(k=k, seed=seed, maxIter=30, featuresCol="_v", predictionCol="cluster").fit(v)
    return model.transform(v).drop("_v"), [c.tolist() for c in model.clusterCenters()]


def assign_clusters(df: DataFrame, centres: list[list[float]], column: str = "features") -> DataFrame:
    """df with cluster, the number of the nearest centre (the first of equals)."""
    dist = lambda c: total(F.zip_with(column, F.array(*[F.lit(float(x)) for x in c]), lambda x, y: (x - y) * (x - y)))
    d = F.array(*[F.struct(dist(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return df.withColumn("cluster", F.array_min(d)["i"])


def label_clusters(profiles: DataFrame) -> DataFrame:
    """profiles(cluster, sharpness, contrast, noise, saturation, entropy, brightness) with a name by the first rule that fits."""
    c = F.col
    name = (
        F.when((c("sharpness") < 0.10) | (c("contrast") < 0.06), "blur_or_low_detail").when(c("noise") > 0.12, "noisy_artifacts").when((c("saturation") > 0.30) | (F.abs(c("brightness") - 0.5) > 0.35), "exposure")
        .when(c("entropy") < 0.30, "low_information").when((c("contrast") >= 0.12) & (c("noise") <= 0.06), "normal_clean").otherwise("mixed")
    )
    return profiles.withColumn("name", name)


Cell = tuple[np.ndarray, np.ndarray]


def _cells_of(column: pa.Array) -> Iterator[Cell]:
    """Ids and features(row, dimension) of each list of (id, f), one list at a time and without an object a row."""
    for i in range(len(column)):
        rows = column.slice(i, 1).flatten()
        f = rows.field("f").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        yield rows.field("id").to_numpy(zero_copy_only=False), f.reshape(len(rows), -1)


def _pack_nearest(xs: Cell, ys: Cell, k: int) -> list[np.ndarray]:
    """Distances of each of xs to the k nearest of ys with another id, in order."""
    (ids, a), (names, b) = xs, ys
    sq = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        sq += (a[:, i, None] - b[None, :, i]) ** 2
    sq[ids[:, None] == names[None, :]] = np.inf
    near = np.sort(np.partition(sq, min(k, len(b)) - 1, axis=1)[:, :k], axis=1)
    return [np.sqrt(r[np.isfinite(r)]) for r in near]


def nearest_distances(df: DataFrame, column: str = "features", k: int = 5, block: int = 256) -> DataFrame:
    """(id, distances): of each row of df(id) the exact distances to the k nearest rows with another id, in order.

    Rows are cut into cells of at most block rows, by the first and then the second feature. A cell is compared with those
    cells whose box is nearer than the farthest k-th neighbour within itself, two cells at a time, so no task holds more.
    """
    out = f"id {df.schema['id'].dataType.simpleString()}, d array<double>"
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(bound, str(4 << 20))  # two cells are some 20 kB, and a worker holds a batch of them
    folder = work_dir(df.sparkSession)
    n = global_row_number(df.where(F.col(column).isNotNull()).select("id", F.col(column).cast("array<double>").alias("f")), [F.get("f", F.lit(0))], "_n")
    n = n.withColumn("_slab", F.floor(F.col("_n") / (16 * block)))
    place = F.row_number().over(Window.partitionBy("_slab").orderBy(F.get("f", F.lit(1)), "id")) - 1
    cells = n.withColumn("cell", F.col("_slab") * 16 + F.floor(place / block)).groupBy("cell").agg(F.collect_list(F.struct("id", "f")).alias("rows"))
    cells = stash(cells, f"{folder}/cells")

    def boxes(batches):
        for batch in batches:
            for cell, own in zip(batch.column("cell"), _cells_of(batch.column("rows")), strict=True):
                reach = max(r[-1] if len(r) == k else np.inf for r in _pack_nearest(own, own, k))
                lo, hi = (pa.array([x.tolist()], pa.list_(pa.float64())) for x in (own[1].min(0), own[1].max(0)))
                yield pa.RecordBatch.from_arrays([pa.array([cell.as_py()], pa.int64()), lo, hi, pa.array([float(reach)])], names=["cell", "lo", "hi", "reach"])

    box = stash(cells.mapInArrow(boxes, "cell long, lo array<double>, hi array<double>, reach double"), f"{folder}/boxes")
    other = box.select(F.col("cell").alias("_cell"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    apart = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    gap = F.sqrt(total(F.zip_with(apart("_lo", "hi"), apart("lo", "_hi"), lambda x, y: x * x + y * y)))
    # one row a cell on both sides
    pairs = box.crossJoin(F.broadcast(other)).where((F.col("cell") == F.col("_cell")) | (gap < F.col("reach"))).select("cell", "_cell")
    pairs = pairs.join(cells, "cell").join(cells.select(F.col("cell").alias("_cell"), F.col("rows").alias("_rows")), "_cell").select("rows", "_rows")

    def compare(batches):
        for batch in batches:
            ids = batch.column("rows").type.value_type.field("id").type
            for xs, ys in zip(_cells_of(batch.column("rows")), _cells_of(batch.column("_rows")), strict=True):
                near = _pack_nearest(xs, ys, k)
                ends = np.cumsum([0, *map(len, near)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(xs[0], ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(near)))], names=["id", "d"])

    d = pairs.mapInArrow(compare, out).groupBy("id").agg(F.flatten(F.collect_list("d")).alias("d"))
    return d.select("id", F.slice(F.array_sort("d"), 1, k).alias("distances"))


def rarity(df: DataFrame, column: str = "features") -> DataFrame:
    """df(id) with rarity in [0, 1]: mean distance to the five nearest, min-max scaled; 0 for a row without others."""
    r = nearest_distances(df, column).select("id", F.when(F.size("distances") > 0, total(F.col("distances")) / F.size("distances")).alias("rarity"))
    return normalize_scores(df.join(r, "id", "left").na.fill(0.0, ["rarity"]), ["rarity"])


def priority_scores(df: DataFrame, uncertainty: bool = False) -> DataFrame:
    """df with priority: weighted parts, each min-max scaled over all rows."""
    w = PRIORITY_UNCERTAIN if uncertainty else PRIORITY
    return normalize_scores(df, list(w)).withColumn("priority", sum(F.col(k) * v for k, v in w.items()))


def explain(df: DataFrame) -> DataFrame:
    """df with reasons (which scaled parts are high), category (the first) and normal_reference."""
    limits = {"anomaly": 0.65, "rarity": 0.65, "edges": 0.70, "objects": 0.70, "structure": 0.70}
    reasons = F.filter(F.array(*[F.when(F.col(k) >= t, F.lit(k)) for k, t in limits.items()]), lambda x: x.isNotNull())
    d = df.withColumn("reasons", reasons).withColumn("category", F.coalesce(F.get("reasons", F.lit(0)), F.lit("representative")))
    return d.withColumn("normal_reference", (F.col("anomaly") <= 0.25) & (F.col("rarity") <= 0.35))


def cluster_quotas(stats: DataFrame, target: int, share_cap: float = 0.5, significant: int = 1) -> DataFrame:
    """(cluster, quota) from stats(cluster, n, mean_priority, max_priority, structure).

    hardness = .45 mean + .25 max + .30 structure; every cluster of enough rows gets one place; the other places go one by
    one to the greatest (.65 hardness + .35 size share) / (q + 1) ** .70, up to a share of the target. The marginal values of
    a cluster fall, so the places are simply the greatest marginal values of all clusters (at most ten, each at most target).
    """
    cap = F.greatest(F.least(F.ceil(F.lit(target * share_cap)), F.col("n")), F.lit(1))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    d = stats.withColumn("hardness", 0.45 * F.col("mean_priority") + 0.25 * F.col("max_priority") + 0.30 * F.col("structure")).withColumn("_w", 0.65 * F.col("hardness") + 0.35 * share)
    q = d.select("cluster", "n", "_w", F.explode(F.sequence(F.lit(0), cap.cast("int") - 1)).alias("q"))
    must = (F.col("q") == 0) & (F.col("n") >= significant)
    q = q.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(must.cast("int")), F.desc(F.col("_w") / F.pow(F.col("q") + 1, F.lit(0.70))), "cluster", "q")))
    return d.select("cluster", "hardness").join(q.where(F.col("_r") <= target).groupBy("cluster").agg(F.count(F.lit(1)).alias("quota")), "cluster", "left").na.fill(0, ["quota"])


def candidate_pool(df: DataFrame, size: int) -> DataFrame:
    """Rows df(id, priority, rarity) among the top size by priority, rarity or their mean."""
    top = [df.orderBy(F.desc(c) if isinstance(c, str) else c.desc(), "id").limit(size).select("id") for c in ("priority", "rarity", (F.col("priority") + F.col("rarity")) / 2)]
    ids = top[0].union(top[1]).union(top[2]).distinct()
    return df.join(ids, "id", "left_semi")


def select_diverse(pool: DataFrame, quotas: DataFrame, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """(id, cluster, pick): per cluster its quota of pool(id, cluster, priority, structure, features) picked greedily.

    Each pick has the greatest alpha * priority + beta * distance to the picked + .10 * structure - .20 if it (nearly) repeats one.
    A round picks one row of every cluster, by a maximum that is taken on the map side first; only the picks are broadcast,
    so a cluster may be of any size. Of equal values the smallest id is taken.
    """
    folder = work_dir(pool.sparkSession)
    dist = lambda a, b: F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    j = pool.join(F.broadcast(quotas.select("cluster", "quota")), "cluster").where("quota > 0")
    side = j.select("cluster", F.posexplode("features").alias("_i", "x")).groupBy("cluster", "_i").agg((F.max("x") - F.min("x")).alias("x"))
    scale = side.groupBy("cluster").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(EPS)).alias("_scale"))
    j = stash(j.join(F.broadcast(scale), "cluster").select("id", "cluster", "features", "quota", "_scale", (alpha * F.col("priority") + 0.10 * F.col("structure")).alias("_base")), f"{folder}/pool")
    picks = stash(j.limit(0).select("id", "cluster", "features", F.lit(0).alias("pick")), f"{folder}/pick-0")
    for n in range(1, (j.agg(F.max("quota")).first()[0] or 0) + 1):
        seen = picks.groupBy(F.col("cluster").alias("_c")).agg(F.collect_list("id").alias("_ids"), F.collect_list("features").alias("_picked"))
        d = j.where(F.col("quota") >= n).join(F.broadcast(seen), F.col("cluster") == F.col("_c"), "left").where("_ids is null or not array_contains(_ids, id)")
        near = F.array_min(F.transform("_picked", lambda p: dist(F.col("features"), p)))
        value = F.col("_base") + beta * F.coalesce(near / F.col("_scale"), F.lit(1.0)) - F.when(near < 1e-6, 0.20).otherwise(0.0)
        best = d.withColumn("_v", value).groupBy("cluster").agg(F.min_by(F.struct("id", "features"), F.struct(-F.col("_v"), F.col("id"))).alias("_b"))
        new = stash(best.select("_b.id", "cluster", "_b.features", F.lit(n).alias("pick")), f"{folder}/pick-{n}")
        if new.isEmpty():
            break
        picks = picks.union(new)
    return picks.select("id", "cluster", "pick")


def uniform_sample(df: DataFrame, n: int, order: str = "path") -> DataFrame:
    """n rows at even places (first and last among them) of the rows in order."""
    d = global_row_number(df, [F.col(order)], "idx")
    size = d.count()
    n = min(n, size)
    if not n:
        return d.limit(0)
    places = df.sparkSession.range(n).select(F.rint(F.col("id") * float(size - 1) / max(n - 1, 1)).cast("long").alias("idx")).distinct()
    return d.join(places, "idx", "left_semi")


def round_robin_sample(df: DataFrame, n: int) -> DataFrame:
    """The n first rows by (rank in cluster by quality, cluster)."""
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("quality"), "path"))
    return df.withColumn("_r", r).orderBy("_r", "cluster").limit(n).drop("_r")


def bootstrap_sample(df: DataFrame, n: int, uniform_share: float = 0.7) -> DataFrame:
    """n rows: the uniform part by order of path, and the rest by farthest point from what is picked (one small round each)."""
    picked = uniform_sample(df, round(n * uniform_share)).select(*df.columns)
    folder = work_dir(df.sparkSession)
    dist = lambda a, b: F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    seen = picked.select(F.col("features").alias("_p"))
    # every row carries its distance to the nearest picked row; a round looks at one new point only
    near = df.join(picked.select("path"), "path", "left_anti").crossJoin(F.broadcast(seen)).groupBy("path").agg(F.min(dist(F.col("features"), F.col("_p"))).alias("_d"))
    rest = stash(df.join(near, "path"), f"{folder}/near")
    out = [r.path for r in picked.select("path").collect()]  # at most n paths
    for i in range(n - len(out)):
        best = rest.where("_d >= 0").orderBy(F.desc("_d"), "path").select("path", "features").first()
        if best is None:
            break
        out.append(best.path)
        new = F.array(*[F.lit(float(x)) for x in best.features])
        rest = rest.withColumn("_d", F.when(F.col("path") == best.path, -1.0).otherwise(F.least("_d", dist(F.col("features"), new))))
        if i % 8 == 7:
            rest = stash(rest, f"{folder}/near-{i}")
    chosen = df.sparkSession.createDataFrame([(p,) for p in out], "path string")
    return df.join(F.broadcast(chosen), "path", "left_semi")


def unit_features(df: DataFrame) -> DataFrame:
    """df with every feature moved and scaled to 0..1 over all rows; one that never varies becomes 0."""
    span = df.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()  # a row a feature
    lows, spans = F.array(*[F.lit(float(r.lo)) for r in span]), F.array(*[F.lit(max(float(r.hi) - float(r.lo), EPS)) for r in span])
    return df.withColumn("features", F.zip_with(F.zip_with("features", lows, lambda x, lo: x - lo), spans, lambda x, width: x / width))


#: Candidates that a round of picks looks at.
LOOK = 128
#: (whether only picks of the row's own cluster count, distance, similarity)
NearRule = tuple[bool, float, float]


def _near_pick(picks: list[Row], rules: list[NearRule], length: int) -> Column:
    """Whether a row is near one of the picks: distance <= d, or similarity of the bits >= s and distance <= 1.8 d."""
    text = json.dumps([{"cluster": str(p.cluster), "features": p.features, "bits": p.bits} for p in picks])
    given = F.from_json(F.lit(text), "array<struct<cluster: string, features: array<double>, bits: array<bigint>>>")

    def near(p: Column) -> Column:
        far = F.sqrt(total(F.zip_with("features", p["features"], lambda x, y: (x - y) * (x - y))))
        same = 1 - total(F.zip_with("bits", p["bits"], lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double"))) / length
        tests = [(F.lit(True) if not own else F.col("cluster").cast("string") == p["cluster"]) & ((far <= d) | ((F.coalesce(same, F.lit(0.0)) >= s) & (far <= 1.8 * d))) for own, d, s in rules]
        return reduce(lambda a, b: a | b, tests)

    return F.exists(given, near)


def _pick_apart(rest: DataFrame, order: list[Column], n: int, picks: list[Row], rules: list[NearRule], length: int, folder: str) -> list[Row]:
    """picks and rows of rest after them, up to n: in order, those that are not near one picked before.

    A round holds all rows against the newest picks, where they lie, and brings only the next LOOK of those that are left here.
    """
    picks, fresh, i = list(picks), list(picks), 0
    while len(picks) < n:
        for at in range(0, len(fresh), LOOK):
            rest = rest.where(~_near_pick(fresh[at : at + LOOK], rules, length))
        rest = stash(rest, f"{folder}-{i}")
        look = rest.orderBy(*order).limit(LOOK).collect()
        if not look:
            break
        fresh = []
        for r in look:
            if len(picks) < n and not any(_near_rows(r, p, rules, length) for p in fresh):
                fresh.append(r)
                picks.append(r)
        rest = rest.where(~F.col("path").isin([r.path for r in look]))
        i += 1
    return picks


def _near_rows(a: Row, b: Row, rules: list[NearRule], length: int) -> bool:
    far = math.sqrt(sum((x - y) * (x - y) for x, y in zip(a.features, b.features, strict=True)))
    same = 0.0 if a.bits is None or b.bits is None else 1 - sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a.bits, b.bits, strict=True)) / length
    return any((not own or a.cluster == b.cluster) and (far <= d or (same >= s and far <= 1.8 * d)) for own, d, s in rules)


def clustered_sample(df: DataFrame, n: int, own: tuple[float, float] = (0.12, 0.94), every: tuple[float, float] = (0.05, 0.98), relax: float = 0.6, length: int = 256, rotate: bool = False) -> DataFrame:
    """(path, pick): up to n rows of df(path, cluster, score, quality, features, bits) that don't repeat each other.

    First the row of best score of every cluster, in order of the clusters. Then rows by quality (with ``rotate`` by turns: the
    second of each cluster by score, the third, and so on) that are neither near a pick of their own cluster nor near any other, as (distance, similarity)
    say. If there are too few, rows by quality that keep relax times the distance of ``every``. Features are brought to one scale first;
    bits are longs as of pack_bits(), ``length`` of them, null ones are like no others. Ties go by path. n is small, rows may be many.
    """
    folder = work_dir(df.sparkSession)
    rows = stash(unit_features(df).select("path", "cluster", "score", "quality", "features", "bits"), f"{folder}/rows")
    best = rows.groupBy("cluster").agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col("score"), F.col("path"))).alias("r")).orderBy("cluster").limit(n)
    picks = best.select("r.*").collect()  # at most n
    by_quality = [F.desc("quality"), F.col("path")]
    left = lambda: rows.where(~F.col("path").isin([p.path for p in picks]))
    rules = [(True, *own), (False, *every)]
    if rotate:
        turn = global_row_number(rows.select("path", "cluster", "score"), [F.col("cluster"), -F.col("score"), F.col("path")], "_at")
        first = turn.groupBy("cluster").agg(F.min("_at").alias("_first"))
        turn = turn.join(first, "cluster").select("path", (F.col("_at") - F.col("_first")).alias("turn"))
        picks = _pick_apart(left().join(turn, "path"), [F.col("turn"), F.col("cluster"), F.col("path")], n, picks, rules, length, f"{folder}/turns")
    else:
        picks = _pick_apart(left(), by_quality, n, picks, rules, length, f"{folder}/apart")
    picks = _pick_apart(left(), by_quality, n, picks, [(False, relax * every[0], every[1])], length, f"{folder}/relaxed")
    kind = df.schema["path"].dataType.simpleString()
    return df.sparkSession.createDataFrame([(p.path, i) for i, p in enumerate(picks, 1)], f"path {kind}, pick int")


def author_sample(frames: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """Distinct frames: per author ceil(n * percent / 100) of author_frames(author, frame) in a seeded hash order."""
    d = frames.select("author", "frame").distinct()
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("author"), F.col("frame").cast("string")))
    n = d.groupBy("author").agg(F.ceil(F.count(F.lit(1)) * percent / 100).alias("_n"))
    r = F.row_number().over(Window.partitionBy("author").orderBy(key, "frame"))
    return d.withColumn("_r", r).join(n, "author").where("_r <= _n").select("frame").distinct()


def stratified_split(df: DataFrame, val_count: int, seed: int = 42) -> DataFrame:
    """df(stem, coverage) with part train or val: places of val by largest remainder over coverage classes, first in sha1 order."""
    cls = sum((F.col("coverage") > t).cast("int") for t in COVERAGE[:-1])
    d = df.withColumn("_k", F.sha1(F.concat(F.lit(f"{seed}:"), "stem", F.lit(":"), "stem"))).withColumn("bucket", cls)
    n = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most seven rows
    every = Window.partitionBy()
    want = F.least(F.lit(val_count), F.sum("_n").over(every) - 1)
    n = n.withColumn("_e", F.col("_n") * want / F.sum("_n").over(every)).withColumn("_f", F.floor("_e"))
    n = n.withColumn("_left", want - F.sum("_f").over(every)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.col("_e") - F.col("_f")), "bucket")))
    n = n.select("bucket", (F.col("_f") + (F.col("_r") <= F.col("_left")).cast("int")).alias("_take"))
    r = F.row_number().over(Window.partitionBy("bucket").orderBy("_k", "stem"))
    return d.withColumn("_r", r).join(F.broadcast(n), "bucket").withColumn("part", F.when(F.col("_r") <= F.col("_take"), "val").otherwise("train")).drop("_k", "_r", "_take")


def patch_steps(dim: Column, size: int, step: int) -> Column:
    """Patches along a side: (dim - size) / step cut to whole, plus 1."""
    return F.expr("1") + ((dim - size) / step).cast("long")


def patch_counts(df: DataFrame, size: int, step: int, half_turn: bool = False, quarter_turns: bool = False, flip_h: bool = False, flip_v: bool = False, scale: bool = False, augment: bool = False) -> DataFrame:
    """df(h, w) with n_patches: places times variants, doubled by scaling and by augmentation."""
    variants = 1 + half_turn + 2 * quarter_turns + flip_h + flip_v
    return df.withColumn("n_patches", patch_steps(F.col("h"), size, step) * patch_steps(F.col("w"), size, step) * variants * (2 if scale else 1) * (2 if augment else 1))


def patch_table(df: DataFrame, size: int, step: int, variants: list[str], repeat_rare: int = 1, keys: tuple[str, ...] = ("frame_key",)) -> DataFrame:
    """(keys, part, top, left, bottom, right, variant, copy) of label rasters df(px, h, w): patches whose label is all one side of .5 are dropped, the others repeated."""
    d = df.select(*keys, "px", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), patch_steps(F.col("h"), size, step) - 1)).alias("r"))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), patch_steps(F.col("w"), size, step) - 1)).alias("c"))
    d = d.withColumns({"top": F.col("r") * step, "left": F.col("c") * step})
    v = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.get("px", ((F.col("top") + F.floor(i / size)) * F.col("w") + F.col("left") + i % size).cast("int")))
    d = d.withColumn("_v", v).where(F.exists("_v", lambda x: x >= 0.5) & F.exists("_v", lambda x: x < 0.5))
    d = d.withColumn("part", F.col("r") * patch_steps(F.col("w"), size, step) + F.col("c"))
    d = d.select("*", F.explode(F.array(*[F.lit(x) for x in variants])).alias("variant")).select("*", F.explode(F.sequence(F.lit(0), F.lit(repeat_rare - 1))).alias("copy"))
    return d.select(*keys, "part", "top", "left", (F.col("top") + size).alias("bottom"), (F.col("left") + size).alias("right"), "variant", "copy")


def global_index(df: DataFrame, length: str = "n", order: str = "frame_key") -> DataFrame:
    """df with lo and hi of each row in the cumulative length, by a two-pass running sum over ranges."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stash(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), f"{work_dir(spark)}/placed")
    sums = placed.groupBy("_part").agg(F.sum(length).alias("_s"))
    sums = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum(length).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = placed.withColumn("_u", upto).join(F.broadcast(sums), "_part").withColumn("hi", F.col("_before") + F.col("_u"))
    return j.withColumn("lo", F.col("hi") - F.col(length)).drop("_part", "_u", "_before")


def locate(index: DataFrame, idx: DataFrame, width: int = 1024) -> DataFrame:
    """idx(idx) with the frame_key and part that holds it; an index out of range has nulls. Ranges meet indices by bins of a fixed width."""
    r = index.where("hi > lo").withColumn("_bin", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})"))).select("frame_key", "lo", "hi", "_bin")
    j = idx.withColumn("_b", F.expr(f"idx div {width}")).join(r, (F.col("_b") == F.col("_bin")) & (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")), "left")
    return j.select("idx", "frame_key", (F.col("idx") - F.col("lo")).alias("part"))


def loss_weights(log: DataFrame, alpha: float = 0.2, strength: float = 1.0) -> DataFrame:
    """(sample, difficulty, weight) of log(sample, batch, loss, lam): loss over the batch mean, smoothed from 1 in order of batch, lam scaling each step (mixed samples)."""
    m = log.groupBy("batch").agg(F.avg("loss").alias("_m"))
    j = log.join(m, "batch").withColumn("_r", F.when(F.col("_m") > EPS, F.col("loss") / F.col("_m")).otherwise(1.0))
    g = j.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("batch", "_r", "lam"))).alias("_x"))
    g = g.withColumn("difficulty", F.aggregate("_x", F.lit(1.0), lambda d, x: d + alpha * x["lam"] * (x["_r"] - d)))
    return g.select("sample", "difficulty", (1 + strength * F.greatest(F.col("difficulty") - 1, F.lit(0.0))).alias("weight"))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int = 1, key: str = "id", replacement: bool = False) -> DataFrame:
    """n rows drawn by weight. Without replacement: the greatest log(u) / w, u from a seeded hash of the key. With: n points on the cumulative weight, found by bins."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 1) / F.lit(2.0**52 + 2)
    d = df.where(F.col(weight) > 0)
    if not replacement:
        return d.withColumn("_k", F.log(u) / F.col(weight)).orderBy(F.desc("_k"), key).limit(n).drop("_k")
    unit = d.agg(F.sum(weight)).first()[0]
    if not unit:
        return d.limit(0)
    # weights become whole lengths on a line of 2**40
    line = global_index(d.select(F.col(key).alias("frame_key"), F.greatest(F.floor(F.col(weight) / unit * (1 << 40)), F.lit(1)).alias("n")))
    points = df.sparkSession.range(n).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 40)).alias("idx"))
    hit = locate(line, points, 1 << 30).where("frame_key is not null").select(F.col("frame_key").alias(key))
    return hit.join(d, key)
