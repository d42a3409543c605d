"""How hard a gray frame is to label, and what pattern it shows: one vector each, from pixels, per frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 1e-8
#: Edge threshold, longest side of the component grid, components that count as many.
EDGE, GRID_SIDE, MANY = 0.16, 96, 24

#: Numbers of both vectors, in order; the pattern begins with eight histogram bins (fixed values).
HARDNESS = ("noise", "laplacian", "stripes", "saturation", "edges", "gradient", "density", "mean_area", "merged", "active", "entropy")
PATTERN = (
    "edges", "gradient", "many", "mean_area", "area_var", "small", "merged", "active", "turns_x", "turns_y", "entropy", "quadrants", "saturation", "stripes", "noise",
    "row_std", "col_std", "row_delta", "col_delta", "row_period", "col_period", "gradient_x", "gradient_y", "axis_bias", "balance",
)
#: Raw scores: weight, number, factor; each term is clipped to 0..1 (fixed values).
RAW = {
    "artifact": ((0.26, "noise", 6.0), (0.22, "laplacian", 2.2), (0.18, "saturation", 2.6), (0.18, "stripes", 2.2), (0.16, "off_middle", 2.0)),
    "edge": ((0.55, "edges", 1.0), (0.45, "gradient", 1.0)),
    "object": ((0.35, "density", 1 / 2.1), (0.20, "small", 2.0), (0.20, "turns", 0.9), (0.15, "merged", 2.0), (0.10, "active", 1.4)),
    "saturation_or_noise": ((0.65, "noise", 6.0), (0.35, "saturation", 2.6)),
}


def otsu(levels: np.ndarray) -> int:
    """The gray level that parts 256 counts into two classes of the greatest variance between them."""
    p = levels / max(levels.sum(), 1)
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight - mean) ** 2 / (weight * (1 - weight))
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 0


def component_areas(mask: np.ndarray) -> np.ndarray:
    """Pixels of each 4-connected component: every pixel takes the least label of its row run and column run until none changes."""
    big = mask.size + 1
    lab = np.where(mask, np.arange(mask.size).reshape(mask.shape), big)
    while True:
        was = lab
        for axis in (0, 1):
            pad = np.pad(lab, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], constant_values=big)
            before, after = (pad[:-2], pad[2:]) if axis == 0 else (pad[:, :-2], pad[:, 2:])
            lab = np.where(mask, np.minimum(np.minimum(lab, before), after), big)
        # jump to the label of the label
        lab = np.where(mask, lab.ravel()[np.where(mask, lab, 0)], big)
        if (lab == was).all():
            return np.unique(lab[mask], return_counts=True)[1].astype(np.float64)


def _profile(values: np.ndarray) -> dict[str, float]:
    """Spread, mean step, stripes (spread of steps, the first being 0) and the share of the strongest frequency."""
    steps = np.diff(values)
    power = np.abs(np.fft.rfft(values - values.mean()))[1:] if len(values) > 2 else np.zeros(0)
    return {
        "std": values.std(),
        "delta": np.abs(steps).mean() if len(steps) else 0.0,
        "stripes": np.append(0.0, steps).std(),
        "period": power.max() / power.sum() if power.sum() > EPS else 0.0,
    }


def frame_numbers(gray: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """(histogram of eight bins, named numbers) of an image of 0..255."""
    g = np.clip(np.rint(gray), 0, 255).astype(np.int64)
    levels = np.bincount(g.ravel(), minlength=256)
    x = g / 255
    pad = np.pad(x, 1, mode="edge")
    h, w = x.shape
    near = [pad[i : i + h, j : j + w] for i in range(3) for j in range(3)]
    left, right, up, down = near[3], near[5], near[1], near[7]
    grad = np.hypot(right - left, down - up)
    share = levels[levels > 0] / g.size

    on = g > otsu(levels)
    step = [-(-side // GRID_SIDE) if max(h, w) > GRID_SIDE else 1 for side in (h, w)]
    grid = on[:: step[0], :: step[1]]
    area = component_areas(grid)
    part = area / grid.size
    turns = [np.abs(np.diff(grid.astype(int), axis=a)).mean() if grid.shape[a] > 1 else 0.0 for a in (1, 0)]
    cut = [max(1, n // 2) for n in grid.shape]
    quarters = [q.mean() for half in (grid[: cut[0]], grid[cut[0] :]) for q in (half[:, : cut[1]], half[:, cut[1] :])] if min(grid.shape) > 1 else [0.0]
    rows, cols = _profile(x.mean(axis=1)), _profile(x.mean(axis=0))
    gx, gy = np.abs(right - left).mean(), np.abs(down - up).mean()
    n = {
        "noise": np.abs(x - np.mean(near, axis=0)).mean(),
        "laplacian": (left + right + up + down - 4 * x).var(),
        "stripes": min(1.0, (rows["stripes"] + cols["stripes"]) / (x.std() + 0.01)),
        "saturation": (levels[:6].sum() + levels[250:].sum()) / g.size,
        "edges": (grad >= EDGE).mean(),
        "gradient": np.minimum(grad, 1).mean(),
        "density": len(area) / max(1.0, grid.size / 1024),
        "many": min(len(area) / MANY, 1.0),
        "mean_area": part.mean() if len(part) else 0.0,
        "area_var": part.var() if len(part) else 0.0,
        "small": (area <= np.percentile(area, 35)).mean() if len(area) else 0.0,
        "merged": (part >= np.percentile(part, 85)).mean() if len(part) else 0.0,
        "active": on.mean(),
        "turns_x": turns[0], "turns_y": turns[1], "turns": sum(turns),
        "entropy": -(share * np.log2(share)).sum() / 8,
        "quadrants": np.std(quarters),
        "gradient_x": gx, "gradient_y": gy, "axis_bias": abs(gx - gy) / max(EPS, gx + gy),
        "balance": abs(rows["std"] - cols["std"]) / max(EPS, rows["std"] + cols["std"]),
        "off_middle": abs(x.mean() - 0.5),
    }
    n |= {f"{side}_{k}": p[k] for side, p in (("row", rows), ("col", cols)) for k in ("std", "delta", "period")}
    return np.bincount(np.repeat(np.arange(8), 32), weights=levels) / g.size, n


def pattern_vectors(rasters: DataFrame, keys: str) -> DataFrame:
    """(keys, hardness, pattern, artifact, edge, object, saturation_or_noise): 11 and 33 numbers of each gray image px (h x w, 0..255).

    Frames stand alone, so there is no shuffle; missing pixels count as 0.
    """
    names = [k.split()[0] for k in keys.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = {c: [] for c in ("hardness", "pattern", *RAW)}
            for px, h, w in zip(pdf["px"], pdf["h"], pdf["w"], strict=True):
                bins, n = frame_numbers(np.nan_to_num(np.asarray(px, np.float64)).reshape(h, w))
                out["hardness"].append([float(n[k]) for k in HARDNESS])
                out["pattern"].append([*bins.tolist(), *(float(n[k]) for k in PATTERN)])
                for name, terms in RAW.items():
                    out[name].append(float(sum(weight * min(max(n[k] * times, 0.0), 1.0) for weight, k, times in terms)))
            yield pdf[names].assign(**out)

    return rasters.select(*names, "px", "h", "w").mapInPandas(run, keys + ", hardness array<double>, pattern array<double>, " + ", ".join(f"{k} double" for k in RAW))
