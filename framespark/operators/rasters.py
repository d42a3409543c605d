"""Raster columns: metrics of masks and probability maps kept as row-major arrays, tiles, patches, labelled components.

Everything that folds pixels stays in array functions of the row; NumPy helpers in Arrow batches do what needs
neighbouring pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framespark.functions.common import EPS, clip, total

#: Weights (fixed values).
AGREEMENT = {"soft_dice": 0.20, "soft_iou": 0.15, "ssim": 0.15, "dice": 0.20, "iou": 0.15, "centroid": 0.10, "count": 0.05}
RISK = {"mean": 0.15, "fraction": 0.25, "top": 0.35, "region": 0.25}
C1, C2 = 0.01**2, 0.03**2


def unit_map(px: Column) -> Column:
    """Pixels in [0, 1]: NaN and -inf become 0, +inf 1, values are divided by 255 if any exceeds 1, then clipped."""
    clean = F.transform(px, lambda x: F.when(F.isnan(x) | (x == float("-inf")), 0.0).when(x == float("inf"), 1.0).otherwise(x.cast("double")))
    scale = F.when(F.array_max(clean) > 1, 255.0).otherwise(1.0)
    return F.transform(clean, lambda x: clip(x / scale))


def graded_uncertainty(px: Column) -> Column:
    """1 - 2 |p - .5| per pixel."""
    return F.transform(px, lambda p: 1 - 2 * F.abs(p - 0.5))


def border_distance(mask: np.ndarray, reach: int) -> np.ndarray:
    """Exact distance of every pixel of a mask to the nearest pixel of the other kind, as far as ``reach``, beyond it infinite.

    First along columns, by counting from the last change, then along rows: the nearest over all columns within reach.
    """
    h, w = mask.shape
    out = np.full((h, w), np.inf)
    for kind in (False, True):
        y = np.arange(h)[:, None]
        other = mask != kind
        before = np.maximum.accumulate(np.where(other, y, -10 * h - 10), axis=0)
        after = np.minimum.accumulate(np.where(other, y, 11 * h + 10)[::-1], axis=0)[::-1]
        column = np.minimum(y - before, after - y).astype(float) ** 2
        column[column > (h + w) ** 2] = np.inf
        best = column.copy()
        for dx in range(1, min(reach, w - 1) + 1):
            best[:, dx:] = np.minimum(best[:, dx:], column[:, :-dx] + dx * dx)
            best[:, :-dx] = np.minimum(best[:, :-dx], column[:, dx:] + dx * dx)
        out = np.where(mask == kind, np.sqrt(best), out)
    return out


def algorithmic_uncertainty(df: DataFrame, px: str = "px", radius: float = 4.0, tolerance: float = 1e-4) -> DataFrame:
    """df(h, w, px) with u: for maps of 0 and 1 within the tolerance 1 - distance to the nearest border pixel / radius, else the graded uncertainty.

    Maps of one kind only have no border and no uncertainty; empty maps give an empty array, a null map null. Each raster is worked on by itself.
    """
    edge = F.forall(px, lambda p: F.least(F.abs(p), F.abs(p - 1)) <= tolerance)

    @F.pandas_udf("array<double>")
    def near_border(values: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(values, width, strict=True):
            if v is None or not len(v):
                out.append(v)
                continue
            mask = np.asarray(v, float).reshape(-1, int(w)) >= 0.5
            out.append(np.clip(1 - border_distance(mask, math.ceil(radius)) / radius, 0, 1).ravel())
        return pd.Series(out)

    # the array is handed over only where the branch needs it
    given = F.when(edge, F.col(px))
    return df.withColumn("u", F.when(edge, near_border(given, F.col("w"))).otherwise(graded_uncertainty(F.col(px))))


def bad_area(u: Column, threshold: float = 0.8, gamma: float = 0.65) -> Column:
    """((u - t) / (1 - t)) ** gamma above the threshold, else 0."""
    return F.transform(u, lambda x: F.when(x > threshold, F.pow((x - threshold) / (1 - threshold), F.lit(gamma))).otherwise(0.0))


def combine_maps(a: Column, b: Column) -> dict[str, Column]:
    """agreement (the lesser), and what only one of both has (clipped differences)."""
    return {
        "agreement": F.zip_with(a, b, lambda x, y: F.least(x, y)),
        "only_a": F.zip_with(a, b, lambda x, y: clip(x - y)),
        "only_b": F.zip_with(a, b, lambda x, y: clip(y - x)),
    }


def _sum2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return total(F.zip_with(a, b, f))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den <= EPS, 1.0).otherwise(num / den)


def mask_agreement(df: DataFrame, a: str = "a", b: str = "b", threshold: float = 0.5, width: str = "w") -> DataFrame:
    """df with agreement of two probability maps: soft dice and iou, global ssim, dice and iou of the masks, centroid distance and similarity, mae, rmse, symmetric bce, pixel-count agreement, score.

    Sums are folded once into columns of their own, so each array is passed over once per sum and no pixel leaves its row.
    """
    A, B = F.col(a), F.col(b)
    n = F.size(A)
    m = lambda x: (x >= threshold).cast("double")
    lim = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    ce = lambda x, y: -(y * F.log(lim(x)) + (1 - y) * F.log(1 - lim(x)))
    at = lambda px, f: total(F.transform(px, lambda p, i: m(p) * f(i)))
    sums = {
        "_sa": total(A), "_sb": total(B), "_min": _sum2(A, B, lambda x, y: F.least(x, y)), "_max": _sum2(A, B, lambda x, y: F.greatest(x, y)),
        "_aa": _sum2(A, A, lambda x, y: x * y), "_bb": _sum2(B, B, lambda x, y: x * y), "_ab": _sum2(A, B, lambda x, y: x * y),
        "_ma": total(F.transform(A, m)), "_mb": total(F.transform(B, m)), "_mm": _sum2(A, B, lambda x, y: m(x) * m(y)),
        "mae": _sum2(A, B, lambda x, y: F.abs(x - y)) / n, "rmse": F.sqrt(_sum2(A, B, lambda x, y: (x - y) * (x - y)) / n), "bce": (_sum2(A, B, ce) + _sum2(B, A, ce)) / (2 * n),
        "_ax": at(A, lambda i: i % F.col(width)), "_ay": at(A, lambda i: F.floor(i / F.col(width))), "_bx": at(B, lambda i: i % F.col(width)), "_by": at(B, lambda i: F.floor(i / F.col(width))), "_n": n,
    }
    d = df.withColumns(sums)
    c = F.col
    ma, mb = c("_sa") / c("_n"), c("_sb") / c("_n")
    va, vb, cov = c("_aa") / c("_n") - ma * ma, c("_bb") / c("_n") - mb * mb, c("_ab") / c("_n") - ma * mb
    both, none = (c("_ma") > 0) & (c("_mb") > 0), (c("_ma") == 0) & (c("_mb") == 0)
    dist = F.when(both, F.sqrt(F.pow(c("_ax") / c("_ma") - c("_bx") / c("_mb"), 2) + F.pow(c("_ay") / c("_ma") - c("_by") / c("_mb"), 2)))
    diag = F.sqrt(F.pow(c(width), F.lit(2.0)) + F.pow(c("_n") / c(width), F.lit(2.0)))
    d = d.withColumns({
        "soft_dice": _ratio(2 * c("_min"), c("_sa") + c("_sb")), "soft_iou": _ratio(c("_min"), c("_max")),
        "ssim": ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2)),
        "dice": _ratio(2 * c("_mm"), c("_ma") + c("_mb")), "iou": _ratio(c("_mm"), c("_ma") + c("_mb") - c("_mm")),
        "centroid": F.when(none, 1.0).when(~both, 0.0).otherwise(clip(1 - dist / diag)), "count": F.when(none, 1.0).otherwise(F.least("_ma", "_mb") / F.greatest("_ma", "_mb")),
    })
    d = d.withColumn("score", sum(clip(c(k)) * w for k, w in AGREEMENT.items()))
    return d.drop(*[k for k in sums if k.startswith("_")])


def mask_quality(df: DataFrame, pred: str = "pred", gt: str = "gt", threshold: float = 0.5) -> DataFrame:
    """df with precision, recall, dice, iou and error (1 - mean of dice and iou) of masks against the truth; empty against empty scores 1."""
    m = lambda x: (x >= threshold).cast("double")
    d = df.withColumns({"_p": total(F.transform(pred, m)), "_t": total(F.transform(gt, m)), "_tp": _sum2(F.col(pred), F.col(gt), lambda x, y: m(x) * m(y))})
    p, t, tp = F.col("_p"), F.col("_t"), F.col("_tp")
    empty = (p == 0) & (t == 0)
    part = lambda n: F.when(empty, 1.0).when(n == 0, 0.0).otherwise(tp / n)
    d = d.withColumns({"precision": part(p), "recall": part(t), "dice": _ratio(2 * tp, p + t), "iou": _ratio(tp, p + t - tp)})
    return d.withColumn("error", 1 - (F.col("dice") + F.col("iou")) / 2).drop("_p", "_t", "_tp")


def compare_masks(a: Column, b: Column, mode: str, threshold: float = 0.5) -> Column:
    """Share of pixels: xor (either alone), a_minus_b, b_minus_a; gray: mean absolute difference; overlay: 0."""
    m = lambda x: x >= threshold
    tests = {"xor": lambda x, y: (m(x) != m(y)).cast("double"), "a_minus_b": lambda x, y: (m(x) & ~m(y)).cast("double"), "b_minus_a": lambda x, y: (m(y) & ~m(x)).cast("double"), "gray": lambda x, y: F.abs(x - y)}
    if mode == "overlay":
        return F.lit(0.0)
    return _sum2(a, b, tests[mode]) / F.size(a)


def consensus(rasters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(frame_key, entropy, variance, disagreement) over the models of each frame.

    entropy: mean binary entropy in bits of the mean map; disagreement = .6 mean(1 - dice over pairs(frame_key, dice)) + .4 mean(clip(4 var)).
    Maps of a frame are folded as arrays, so one row per model is shuffled and no pixels.
    """
    g = rasters.groupBy("frame_key").agg(F.collect_list("px").alias("_m"))
    zero = F.transform(F.get("_m", F.lit(0)), lambda x: F.lit(0.0))
    n = F.size("_m")
    g = g.withColumns({"_s": F.aggregate("_m", zero, lambda s, x: F.zip_with(s, x, lambda u, v: u + v)), "_q": F.aggregate("_m", zero, lambda s, x: F.zip_with(s, x, lambda u, v: u + v * v))})
    mean = F.transform("_s", lambda s: s / n)
    h = lambda p: F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    var = F.zip_with("_s", "_q", lambda s, q: F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    size = F.size("_s")
    g = g.select("frame_key", (total(F.transform(mean, h)) / size).alias("entropy"), (total(var) / size).alias("variance"), (total(F.transform(var, lambda v: clip(4 * v))) / size).alias("_v"))
    d = pairs.groupBy("frame_key").agg(F.avg(1 - F.col("dice")).alias("_d"))
    return g.join(d, "frame_key", "left").withColumn("disagreement", 0.6 * F.coalesce("_d", F.lit(0.0)) + 0.4 * F.col("_v")).drop("_d", "_v")


def frame_uncertainty(df: DataFrame, u: str = "u", region: str | None = None, limit: float = 0.15) -> DataFrame:
    """df with mean, fraction above the limit, mean of the top tenth, and risk; region, the column of uncertain_region(), counts as 0 without one."""
    U = F.col(u)
    k = F.ceil(F.size(U) * 0.1).cast("int")
    top = F.slice(F.sort_array(U, asc=False), F.lit(1), k)
    d = df.withColumns({"mean": total(U) / F.size(U), "fraction": F.size(F.filter(U, lambda x: x > limit)) / F.size(U), "top": total(top) / k})
    parts = {"mean": F.col("mean"), "fraction": F.col("fraction"), "top": F.col("top"), "region": F.col(region) if region else F.lit(0.0)}
    return d.withColumn("risk", sum(v * RISK[k] for k, v in parts.items()))


def uncertain_region(df: DataFrame, u: str = "u", width: str = "w", limit: float = 0.15) -> DataFrame:
    """df(u, w) with region: pixels of the largest 8-connected part above the limit, over all pixels; 0 for an empty map, null for a null one."""

    @F.pandas_udf("double")
    def share(maps: pd.Series, widths: pd.Series) -> pd.Series:
        def one(values, w) -> float | None:
            if values is None:
                return None
            if not len(values):
                return 0.0
            over = np.asarray(values, float).reshape(-1, int(w)) > limit
            return float(np.bincount(label_mask(over).ravel())[1:].max(initial=0) / over.size)

        return pd.Series([one(v, w) for v, w in zip(maps, widths, strict=True)], dtype=float)

    return df.withColumn("region", share(F.col(u), F.col(width)))


#: Weights of the quality of a mask against the truth (fixed values).
SUPERVISED = {"soft_dice": 0.20, "soft_iou": 0.15, "ssim": 0.15, "dice": 0.20, "iou": 0.10, "hausdorff_term": 0.12, "centroid": 0.08}


def boundary_terms(df: DataFrame, a: str = "a", b: str = "b", radius: int = 1, threshold: float = 0.5) -> DataFrame:
    """df(h, w, a, b) with boundary_f1, hausdorff, hausdorff_term and count_error of mask a against the true mask b.

    Boundaries are pixels with a 4-neighbour outside the mask or the frame. boundary_f1 lets them differ by ``radius`` pixels in either
    direction; hausdorff is the greatest distance from one boundary to the nearest pixel of the other, hausdorff_term 1 - it over the diagonal. Two
    masks without pixels agree; if one has none, they differ by the diagonal. count_error is the difference of the numbers of 8-connected parts,
    over that of the truth, at most 1.
    """
    names = ["boundary_f1", "hausdorff", "hausdorff_term", "count_error"]

    def edge(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, 1)
        return m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])

    def grown(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, radius)
        h, w = m.shape
        return np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(2 * radius + 1) for j in range(2 * radius + 1)])

    def one(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
        ex, ey = edge(x), edge(y)
        far = math.hypot(*x.shape)
        parts = [int(label_mask(m).max(initial=0)) for m in (x, y)]
        count = min(abs(parts[0] - parts[1]) / max(parts[1], 1), 1.0)
        if not ex.any() or not ey.any():
            same = ex.any() == ey.any()
            return float(same), 0.0 if same else far, float(same), count
        p, r = (ex & grown(ey)).sum() / ex.sum(), (ey & grown(ex)).sum() / ey.sum()
        # the distance to a boundary's nearest pixel, from every pixel that isn't on it
        reach = max(x.shape)
        away = max(float(np.where(f, 0.0, border_distance(f, reach))[e].max()) for e, f in ((ex, ey), (ey, ex)))
        return float(2 * p * r / (p + r)) if p + r > EPS else 0.0, away, 1 - min(away / far, 1.0), count

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [one(*(np.asarray(v, float).reshape(int(h), int(w)) >= threshold for v in (x, y))) for h, w, x, y in zip(pdf["h"], pdf["w"], pdf[a], pdf[b], strict=True)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=float)], axis=1)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInPandas(run, ", ".join(fields + [f"{n} double" for n in names]))


def supervised_quality(df: DataFrame, pred: str = "pred", gt: str = "gt", threshold: float = 0.5) -> DataFrame:
    """df(h, w, pred, gt) with the terms of mask_agreement() and boundary_terms(), quality by the weights SUPERVISED, and error = 1 - quality."""
    truth = df.withColumn(gt, F.transform(gt, lambda x: F.when(x >= threshold, 1.0).otherwise(0.0)))
    d = boundary_terms(mask_agreement(truth, pred, gt, threshold).drop("score"), pred, gt, 1, threshold)
    quality = sum(w * F.col(k) for k, w in SUPERVISED.items())
    return d.withColumn("quality", quality).withColumn("error", 1 - F.col("quality"))


def tile_plan(df: DataFrame, tw: int, th: int, overlap: int = 0) -> DataFrame:
    """df(h, w) with a row (tile_y, tile_x, left, top, right, bottom) per tile; the last tile of a row or column ends at the edge."""
    def starts(dim: Column, size: int) -> Column:
        s = F.least(F.lit(size), dim)
        stride = F.greatest(s - F.least(F.lit(overlap), s - 1), F.lit(1))
        last = dim - s
        return F.array_union(F.sequence(F.lit(0).cast(dim_type), last, stride), F.array(last))

    dim_type = df.schema["w"].dataType.simpleString()
    d = df.select("*", F.posexplode(starts(F.col("h"), th)).alias("tile_y", "top")).select("*", F.posexplode(starts(F.col("w"), tw)).alias("tile_x", "left"))
    return d.withColumns({"right": F.least(F.col("left") + tw, F.col("w")), "bottom": F.least(F.col("top") + th, F.col("h"))})


def subgrid(df: DataFrame, rows: int, cols: int, keys: list[str]) -> DataFrame:
    """(keys, sub_row, sub_col, value, confidence): cell means and 1 - min(1, 1.75 std) of each raster(px, h, w) on a rows x cols grid."""
    edge = lambda i, n, dim: F.rint(i * dim / n)
    p = df.select(*keys, "h", "w", F.posexplode("px").alias("i", "p"))
    p = p.withColumns({"y": F.floor(F.col("i") / F.col("w")), "x": F.col("i") % F.col("w")})

    def cell(at: Column, n: int, dim: Column) -> Column:
        """Number of inner edges at or before the pixel."""
        return sum((edge(F.lit(float(i)), n, dim) <= at).cast("int") for i in range(1, n)) if n > 1 else F.lit(0)

    p = p.withColumns({"sub_row": cell(F.col("y"), rows, F.col("h")), "sub_col": cell(F.col("x"), cols, F.col("w"))})
    g = p.groupBy(*keys, "sub_row", "sub_col").agg(F.avg("p").alias("value"), F.stddev_pop("p").alias("_s"))
    return g.withColumn("confidence", 1 - F.least(F.lit(1.0), 1.75 * F.col("_s"))).drop("_s")


def cut_patches(rasters: DataFrame, size: int, overlap: int, keys: list[str]) -> DataFrame:
    """(keys, part, top, left, patch): square patches at a stride of size - overlap; the last ones are shifted inside, small images padded with 0."""
    stride = size - overlap
    d = rasters.withColumns({c: F.col(c).cast("long") for c in ("h", "w")})
    starts = lambda dim: F.when(dim <= size, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((dim - 1) / stride)), lambda i: F.least(i * stride, dim - size))))
    d = d.select("*", F.explode(starts(F.col("h"))).alias("top")).select("*", F.explode(starts(F.col("w"))).alias("left"))
    at = F.sequence(F.lit(0), F.lit(size * size - 1))
    y, x = lambda i: F.col("top") + F.floor(i / size), lambda i: F.col("left") + i % size
    px = F.transform(at, lambda i: F.when((y(i) < F.col("h")) & (x(i) < F.col("w")), F.get("px", (y(i) * F.col("w") + x(i)).cast("int"))).otherwise(F.lit(0.0)))
    return d.select(*keys, "h", "w", "top", "left", px.alias("patch"))


def stitch_patches(patches: DataFrame, size: int, overlap: int, keys: list[str], threshold: float | None = None) -> DataFrame:
    """(keys, px): weighted mean of patches over each image, NaN as 0, clipped; weights fall from 1 to .2 over half the overlap at borders inside the image.

    Pixels meet by (image, position) with sums on the map side.
    """
    half = overlap // 2
    ramp = lambda near: F.when(near >= half, 1.0).otherwise(0.2 + 0.8 * near / max(half, 1)) if half else F.lit(1.0)
    p = patches.select(*keys, "h", "w", "top", "left", F.posexplode("patch").alias("i", "v"))
    py, px = F.floor(F.col("i") / size), F.col("i") % size
    p = p.withColumns({"y": F.col("top") + py, "x": F.col("left") + px}).where("y < h and x < w")
    side = lambda at, start, dim: F.least(F.when(F.col(start) > 0, ramp(at)).otherwise(1.0), F.when(F.col(start) + size < F.col(dim), ramp(size - 1 - at)).otherwise(1.0))
    weight = side(py, "top", "h") * side(px, "left", "w")
    p = p.withColumns({"wt": weight, "v": F.when(F.isnan("v"), 0.0).otherwise(F.col("v"))})
    g = p.groupBy(*keys, "h", "w", "y", "x").agg((F.sum(F.col("wt") * F.col("v")) / F.sum("wt")).alias("v"))
    v = clip(F.col("v")) if threshold is None else (F.col("v") >= threshold).cast("double")
    rows = g.groupBy(*keys, "h", "w").agg(F.array_sort(F.collect_list(F.struct((F.col("y") * F.col("w") + F.col("x")).alias("i"), v.alias("v")))).alias("_r"))
    return rows.select(*keys, "h", "w", F.transform("_r", lambda r: r["v"]).alias("px"))


def object_confidence(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, area, mean_confidence, median, min, max, p25, mean_probability, uncertain_share, cx, cy) of each label in rasters(px, labels, w).

    Confidence of a pixel is 2 |p - .5|; pixels within .10 of .5 are uncertain.
    """
    z = rasters.select(*keys, "w", F.posexplode(F.arrays_zip("px", "labels")).alias("i", "z")).select(*keys, "w", "i", F.col("z.px").alias("p"), F.col("z.labels").alias("label")).where("label > 0")
    c = 2 * F.abs(F.col("p") - 0.5)
    q = lambda x: F.percentile(c, F.lit(x))
    return z.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.avg(c).alias("mean_confidence"), q(0.5).alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), q(0.25).alias("p25"),
        F.avg("p").alias("mean_probability"), F.avg((F.abs(F.col("p") - 0.5) < 0.1).cast("double")).alias("uncertain_share"), F.avg(F.col("i") % F.col("w")).alias("cx"), F.avg(F.floor(F.col("i") / F.col("w"))).alias("cy"),
    )


def point_confidence(points: DataFrame, rasters: DataFrame, keys: list[str], radius: int = 3) -> DataFrame:
    """points(keys, x, y) with probability and confidence at the rounded pixel (0 outside), the mean confidence of the patch around it, and their difference as contrast."""
    j = points.join(rasters.select(*keys, "h", "w", "px"), keys)
    x, y = F.rint("x").cast("int"), F.rint("y").cast("int")
    inside = lambda a, b: (a >= 0) & (b >= 0) & (a < F.col("w")) & (b < F.col("h"))
    at = lambda a, b: F.when(inside(a, b), F.get("px", (b * F.col("w") + a).cast("int")))
    side = 2 * radius + 1
    patch = F.filter(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: at(F.col("_x") + i % side - radius, F.col("_y") + F.floor(i / side).cast("int") - radius)), lambda p: p.isNotNull())
    j = j.withColumns({"_x": x, "_y": y}).withColumns({"probability": F.coalesce(at(F.col("_x"), F.col("_y")), F.lit(0.0)), "_p": patch})
    conf = lambda p: 2 * F.abs(p - 0.5)
    j = j.withColumn("confidence", F.when(inside(F.col("_x"), F.col("_y")), conf(F.col("probability"))).otherwise(0.0))
    j = j.withColumn("patch_confidence", F.when(F.size("_p") > 0, total(F.transform("_p", conf)) / F.size("_p")).otherwise(0.0))
    return j.withColumn("contrast", F.col("confidence") - F.col("patch_confidence")).drop("_x", "_y", "_p", "px", "h", "w")


# ---------------------------------------------------------------- helpers on neighbouring pixels


def _images(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    for i, (px, h, w) in enumerate(zip(pdf["px"], pdf["h"], pdf["w"], strict=True)):
        yield i, np.nan_to_num(np.asarray(px, np.float64)).reshape(h, w)


def label_mask(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the 8-connected components in order of their first pixel: least neighbour label, to a fixed point."""
    h, w = mask.shape
    big = h * w + 1
    lab = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), big)
    while True:
        pad = np.pad(lab, 1, constant_values=big)
        new = np.minimum.reduce([pad[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        new = np.where(mask, new, big)
        flat = new.ravel()
        jump = np.where(mask.ravel(), flat[np.minimum(flat, h * w) - 1], big).reshape(h, w)
        if (jump == lab).all():
            break
        lab = jump
    out = np.zeros((h, w), np.int64)
    if mask.any():
        out[mask] = np.unique(lab[mask], return_inverse=True)[1] + 1
    return out


def label_components(rasters: DataFrame, keys: str, threshold: float = 0.5) -> DataFrame:
    """(keys, component, area, left, top, right, bottom, cx, cy, radius, tiny) of each component of px >= threshold."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, img in _images(pdf):
                lab = label_mask(img >= threshold)
                for c in range(1, lab.max() + 1):
                    y, x = np.nonzero(lab == c)
                    key = [pdf[k].iloc[i] for k in names]
                    out.append((*key, c, len(x), x.min(), y.min(), x.max(), y.max(), x.mean(), y.mean(), math.sqrt(len(x) / math.pi), len(x) <= 12))
            yield pd.DataFrame(out, columns=[*names, "component", "area", "left", "top", "right", "bottom", "cx", "cy", "radius", "tiny"])

    schema = f"{keys}, component long, area long, left long, top long, right long, bottom long, cx double, cy double, radius double, tiny boolean"
    return rasters.select(*names, "px", "h", "w").mapInPandas(run, schema)


def frame_features(rasters: DataFrame, keys: str) -> DataFrame:
    """(keys, brightness, contrast, entropy, sharpness, noise, edges, peaks, range, saturation) of gray images in 0..255."""
    names = [k.split()[0] for k in keys.split(", ")]
    fields = ["brightness", "contrast", "entropy", "sharpness", "noise", "edges", "peaks", "range", "saturation"]

    def one(g: np.ndarray) -> list[float]:
        pad = np.pad(g, 1, mode="edge")
        h, w = g.shape
        near = [pad[i : i + h, j : j + w] for i in range(3) for j in range(3)]
        lap = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * g
        hist = np.bincount(np.clip(g, 0, 255).astype(np.int64).ravel(), minlength=256) / g.size
        some = hist[hist > 0]
        grad = np.hypot(pad[1:-1, 2:] - pad[1:-1, :-2], pad[2:, 1:-1] - pad[:-2, 1:-1]) / 2
        others = np.maximum.reduce([n for k, n in enumerate(near) if k != 4])
        inner = g[1:-1, 1:-1] > others[1:-1, 1:-1] if h > 2 and w > 2 else np.zeros((0, 0))
        return [g.mean() / 255, g.std() / 255, -(some * np.log2(some)).sum() / 8, lap.var(), np.abs(g - np.mean(near, axis=0)).mean() / 255, (grad >= 20).mean(), inner.sum() / g.size, (np.percentile(g, 99) - np.percentile(g, 1)) / 255, ((g <= 5) | (g >= 250)).mean()]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [[pdf[k].iloc[i] for k in names] + [float(v) for v in one(g)] for i, g in _images(pdf)]
            yield pd.DataFrame(rows, columns=[*names, *fields])

    return rasters.select(*names, "px", "h", "w").mapInPandas(run, keys + ", " + ", ".join(f"{f} double" for f in fields))


def hausdorff(df: DataFrame, keys: str, threshold: float = 0.5) -> DataFrame:
    """(keys, hausdorff, boundary_f1) of masks a and b (h x w): greatest nearest distance both ways; agreement of boundary pixels within 2 pixels. Empty against empty is 0 and 1; one empty is the diagonal and 0."""
    names = [k.split()[0] for k in keys.split(", ")]

    def edge(m: np.ndarray) -> np.ndarray:
        p = np.pad(m, 1)
        return m & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])

    def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distance from each point of a to b, in chunks so that memory stays small."""
        return np.concatenate([np.sqrt(((a[i : i + 256, None] - b) ** 2).sum(-1).min(1)) for i in range(0, len(a), 256)])

    def one(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
        if not a.any() or not b.any():
            return (0.0, 1.0) if a.any() == b.any() else (math.hypot(*a.shape), 0.0)
        pa, pb = np.argwhere(a), np.argwhere(b)
        ea, eb = np.argwhere(edge(a)), np.argwhere(edge(b))
        p, r = (nearest(ea, eb) <= 2).mean(), (nearest(eb, ea) <= 2).mean()
        return float(max(nearest(pa, pb).max(), nearest(pb, pa).max())), float(2 * p * r / (p + r) if p + r else 0.0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i in range(len(pdf)):
                h, w = int(pdf["h"].iloc[i]), int(pdf["w"].iloc[i])
                a, b = (np.asarray(pdf[c].iloc[i], np.float64).reshape(h, w) >= threshold for c in ("a", "b"))
                rows.append([pdf[k].iloc[i] for k in names] + list(one(a, b)))
            yield pd.DataFrame(rows, columns=[*names, "hausdorff", "boundary_f1"])

    return df.select(*names, "h", "w", "a", "b").mapInPandas(run, f"{keys}, hausdorff double, boundary_f1 double")


def _window(img: np.ndarray, r: int, f: Callable) -> np.ndarray:
    p = np.pad(img, r, mode="edge")
    h, w = img.shape
    return f.reduce([p[i : i + h, j : j + w] for i in range(2 * r + 1) for j in range(2 * r + 1)])


def _otsu(img: np.ndarray) -> float:
    hist = np.bincount((np.clip(img, 0, 1) * 255).astype(np.int64).ravel(), minlength=256).astype(float)
    n, level = hist.cumsum(), np.arange(256)
    s = (hist * level).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n))
    return float(np.nan_to_num(between).argmax()) / 255


def _fill(img: np.ndarray) -> np.ndarray:
    lab = label_mask(np.pad(img < 0.5, 1, constant_values=True))
    return np.where((lab != lab[0, 0])[1:-1, 1:-1], 1.0, 0.0)


def _components(img: np.ndarray, least: int = 1, most: int = 1 << 30) -> np.ndarray:
    lab = label_mask(img >= 0.5)
    size = np.bincount(lab.ravel())
    ok = (size >= least) & (size <= most)
    ok[0] = False
    return ok[lab].astype(float)


#: Named steps on one image in [0, 1].
STEPS: dict[str, Callable] = {
    "threshold": lambda g, t=0.5: (g >= t).astype(float), "otsu": lambda g: (g > _otsu(g)).astype(float), "invert": lambda g: 1 - g,
    "brightness_contrast": lambda g, brightness=0.0, contrast=1.0: np.clip((g - 0.5) * contrast + 0.5 + brightness, 0, 1), "gamma": lambda g, gamma=1.0: np.clip(g, 0, 1) ** gamma,
    "crop": lambda g, top=0, left=0, height=None, width=None: g[top : None if height is None else top + height, left : None if width is None else left + width],
    "erode": lambda g, radius=1: _window(g, radius, np.minimum), "dilate": lambda g, radius=1: _window(g, radius, np.maximum),
    "open": lambda g, radius=1: _window(_window(g, radius, np.minimum), radius, np.maximum), "close": lambda g, radius=1: _window(_window(g, radius, np.maximum), radius, np.minimum),
    "fill_holes": _fill, "component_area": _components,
}


def apply_steps(rasters: DataFrame, steps: list[dict], keys: str, registry: dict[str, Callable] | None = None) -> DataFrame:
    """(keys, h, w, px) after the steps ({name, skip, ...parameters}) in order; an unknown or failing step is an error that names its number."""
    known = STEPS | (registry or {})
    for i, s in enumerate(steps):
        if s["name"] not in known:
            raise ValueError(f"step {i}: unknown name {s['name']!r}")
    names = [k.split()[0] for k in keys.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i, g in _images(pdf):
                for k, s in enumerate(steps):
                    if s.get("skip"):
                        continue
                    try:
                        g = known[s["name"]](g, **{a: v for a, v in s.items() if a not in ("name", "skip")})
                    except Exception as e:
                        raise ValueError(f"step {k} ({s['name']}) failed: {e}") from e
                rows.append([pdf[c].iloc[i] for c in names] + [*g.shape, g.ravel().tolist()])
            yield pd.DataFrame(rows, columns=[*names, "h", "w", "px"])

    return rasters.select(*names, "px", "h", "w").mapInPandas(run, f"{keys}, h int, w int, px array<double>")


def score_patches(patches: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int, keys: str, flip: bool = False) -> DataFrame:
    """patches with the model's output (batch, size, size) in place of each patch, averaged with the mirrored patch's if flip; what isn't finite becomes 0."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(p, np.float64).reshape(size, size) for p in pdf["patch"]])
            y = np.asarray(model(x), np.float64)
            if flip:
                y = (y + np.asarray(model(x[:, :, ::-1]), np.float64)[:, :, ::-1]) / 2
            y = np.clip(np.nan_to_num(y, posinf=1.0, neginf=0.0), 0, 1)
            yield pdf.assign(patch=[v.ravel().tolist() for v in y])

    cols = [*names, "h", "w", "top", "left"]
    return patches.select(*cols, "patch").mapInPandas(run, f"{keys}, h long, w long, top long, left long, patch array<double>")
