"""Greedy, random and stateful operators that SQL can't check, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framespark.operators import polygons as pg
from framespark.operators import rasters as ra
from framespark.operators import selection
from framespark.plans import registry, sources
from tests.conftest import SF


def test_match_points(spark):
    rng = random.Random(1)
    sides = [[(k, i, rng.randrange(30) / 2, rng.randrange(30) / 2) for k in range(3) for i in range(60)] for _ in range(2)]
    want = set()
    for k in range(3):
        pairs = sorted((math.dist(p[2:], q[2:]), p[1], q[1]) for p in sides[0] for q in sides[1] if p[0] == q[0] == k and math.dist(p[2:], q[2:]) <= 2)
        used = set()
        for _, i, j in pairs:
            if ("a", i) not in used and ("b", j) not in used:
                used |= {("a", i), ("b", j)}
                want.add((k, i, j))
    got = pg.match_points(*[spark.createDataFrame(s, "k int, id int, x double, y double") for s in sides], 2.0, ["k"]).collect()
    assert {(r.k, r.ia, r.ib) for r in got} == want and len(got) == len(want)


def brute_nms(rows, kind, limit, inclusive=False):
    area = lambda r: r[4] * r[5]
    by_row = lambda r: (r[3] + r[5] / 2, r[2] + r[4] / 2, r[1])
    order = sorted(rows, key=(lambda r: (area(r), r[4] + r[5], r[2], r[3], r[1])) if kind == "via" else by_row if kind == "grid" else (lambda r: (-r[6], r[1])))

    def foes(a, b):
        w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        both = max(w, 0) * max(h, 0)
        if kind == "via":
            return both > 0
        if kind == "iou":
            return both > 0 and both / (area(a) + area(b) - both) >= limit
        apart = math.dist((a[2] + a[4] / 2, a[3] + a[5] / 2), (b[2] + b[4] / 2, b[3] + b[5] / 2))
        return apart <= limit if inclusive else apart < limit

    kept, out = [], {}
    for r in order:
        by = [s[1] for s in kept if s[0] == r[0] and foes(r, s)]
        out[r[0], r[1]] = min(by) if by else None
        if not by:
            kept.append(r)
    return out


@pytest.mark.parametrize(("kind", "limit"), [("via", 0.0), ("iou", 0.2), ("distance", 4.0), ("grid", 4.0)])
def test_suppression(spark, kind, limit):
    rng = random.Random(2)
    rows = [(k, i, float(rng.randrange(40)), float(rng.randrange(40)), float(rng.randrange(2, 8)), float(rng.randrange(2, 8)), rng.randrange(20) / 20) for k in range(2) for i in range(80)]
    got = pg.suppress_nms(spark.createDataFrame(rows, "k int, id int, x double, y double, w double, h double, score double"), ["k"], kind, limit)
    assert {(r.k, r.id): r.suppressed_by for r in got.collect()} == brute_nms(rows, kind, limit)


def test_suppression_with_hard_rejects(spark):
    """Hard rejects stay and suppress nothing; the limit itself counts."""
    rng = random.Random(5)
    rows = [(0, i, float(rng.randrange(30)), float(rng.randrange(30)), 2.0, 2.0, rng.randrange(20) / 20, rng.choice([True, False, None])) for i in range(120)]
    got = pg.suppress_nms(spark.createDataFrame(rows, "k int, id int, x double, y double, w double, h double, score double, hard boolean"), ["k"], "distance", 3.0, inclusive=True, always="hard").collect()
    want = brute_nms([r[:7] for r in rows if not r[7]], "distance", 3.0, inclusive=True)
    assert {(r.k, r.id): r.suppressed_by for r in got} == want | {(0, r[1]): None for r in rows if r[7]}
    assert any(want.values())


def shapes(spark, rows):
    """rows (id, x, y, w, h, is_hole, category) as rectangles of frame 1."""
    df = spark.createDataFrame(rows, "id long, x double, y double, w double, h double, is_hole boolean, category string")
    p = lambda u, v: F.struct(F.expr(u).alias("x"), F.expr(v).alias("y"))
    ring = F.array(p("x", "y"), p("x + w", "y"), p("x + w", "y + h"), p("x", "y + h"))
    return df.select(F.lit(1).alias("k"), "id", ring.alias("points"), "is_hole", "category").withColumn("m", pg.polygon_metrics(F.col("points"))).select("*", "m.*").drop("m")


def test_trace_vias(spark):
    """Two conductors that overlap are one long trace; a square, a hole and a trace that is small beside the via drop nothing."""
    conductors = [(1, 0.0, 0.0, 30.0, 5.0, False, "c"), (2, 25.0, 0.0, 30.0, 5.0, False, "c"), (3, 0.0, 50.0, 40.0, 40.0, False, "c"), (4, 100.0, 0.0, 90.0, 3.0, True, "c")]
    vias = [(1, 10.0, 1.0, 2.0, 2.0, False, "v"), (2, 50.0, 1.0, 2.0, 2.0, False, "v"), (3, 20.0, 60.0, 2.0, 2.0, False, "v"), (4, 120.0, 0.0, 2.0, 2.0, False, "v"), (5, 20.0, 0.0, 5.0, 3.0, False, "v"), (6, 300.0, 0.0, 2.0, 2.0, False, "v")]
    got = pg.drop_trace_vias(shapes(spark, vias), shapes(spark, conductors), ["k"])
    assert sorted(r.id for r in got.collect()) == [3, 4, 5, 6]
    assert got.columns == shapes(spark, vias).columns
    assert pg.drop_trace_vias(shapes(spark, vias), shapes(spark, conductors).limit(0), ["k"]).count() == 6


def test_metadata_transfer(spark):
    given = shapes(spark, [(1, 0.0, 0.0, 50.0, 50.0, False, "large"), (2, 10.0, 10.0, 10.0, 10.0, False, "small"), (3, 10.0, 10.0, 6.0, 6.0, True, "hole")])
    mine = shapes(spark, [(7, 12.0, 12.0, 2.0, 2.0, False, "a"), (8, 40.0, 40.0, 2.0, 2.0, False, "b"), (9, 12.0, 12.0, 2.0, 2.0, True, "c"), (10, 90.0, 0.0, 2.0, 2.0, False, "d"), (11, 40.0, 40.0, 2.0, 2.0, True, "e")])
    empty = mine.where("id = 7").withColumns({"id": F.lit(12).cast("long"), "points": F.slice("points", 1, 0)})
    got = {r.id: r.category for r in pg.transfer_metadata(mine.union(empty), given, ["k"], ("category",)).collect()}
    assert got == {7: "small", 8: "large", 9: "hole", 10: "d", 11: "e", 12: "a"}


def brute_clustered(rows, n, rotate):
    low, high = ([f([r[4][i] for r in rows]) for i in range(2)] for f in (min, max))
    rows = [(*r[:4], [(x - a) / max(b - a, 1e-8) for x, a, b in zip(r[4], low, high, strict=True)], r[5]) for r in rows]

    def near(a, b, d, s):
        far = math.dist(a[4], b[4])
        same = 0 if a[5] is None or b[5] is None else 1 - ((a[5][0] ^ b[5][0]) & (2**64 - 1)).bit_count() / 64
        return far <= d or (same >= s and far <= 1.8 * d)

    groups = {c: sorted((r for r in rows if r[1] == c), key=lambda r: (-r[2], r[0])) for c in {r[1] for r in rows}}
    picks = [groups[c][0] for c in sorted(groups)][:n]
    by_quality = sorted(rows, key=lambda r: (-r[3], r[0]))
    order = sorted(rows, key=lambda r: (groups[r[1]].index(r), r[1])) if rotate else by_quality
    for r in order:
        if len(picks) < n and r not in picks and not any((r[1] == p[1] and near(r, p, 0.12, 0.9)) or near(r, p, 0.05, 0.98) for p in picks):
            picks.append(r)
    for r in by_quality:
        if len(picks) < n and r not in picks and not any(near(r, p, 0.6 * 0.05, 0.98) for p in picks):
            picks.append(r)
    return [r[0] for r in picks]


@pytest.mark.parametrize("rotate", [False, True])
def test_clustered_sample(spark, monkeypatch, rotate):
    monkeypatch.setattr(selection, "LOOK", 8)
    rng = random.Random(6)
    rows = [(f"f{i:03}", rng.randrange(4), rng.randrange(9) / 9, rng.randrange(30) / 30, [rng.randrange(40) / 4, rng.randrange(40) / 2], rng.choice([None, [-1], [-2], [rng.getrandbits(62)]])) for i in range(150)]
    df = spark.createDataFrame(rows, "path string, cluster int, score double, quality double, features array<double>, bits array<bigint>")
    for n in (3, 40, 150):
        got = selection.clustered_sample(df, n, own=(0.12, 0.9), length=64, rotate=rotate).orderBy("pick").collect()
        assert [r.path for r in got] == brute_clustered(rows, n, rotate)
    assert selection.clustered_sample(df.limit(0), 5, length=64).count() == 0


def test_weighted_sample(spark):
    """The share of draws follows the weight, nothing of weight 0 is drawn, and reruns agree."""
    df = spark.range(4000).withColumn("w", (F.col("id") % 4).cast("double"))
    got = selection.weighted_sample(df, "w", 600).collect()
    assert len({r.id for r in got}) == 600 and got == selection.weighted_sample(df.repartition(3), "w", 600).collect()
    counts = np.bincount([r.id % 4 for r in got], minlength=4)
    assert counts[0] == 0 and counts[1] < counts[2] < counts[3]
    again = selection.weighted_sample(df, "w", 3000, replacement=True).collect()
    counts = np.bincount([r.id % 4 for r in again], minlength=4) / 3000
    assert len(again) == 3000 and counts == pytest.approx([0, 1 / 6, 2 / 6, 3 / 6], abs=0.04)
    assert selection.weighted_sample(df.where("w = 0"), "w", 5, replacement=True).count() == 0


def test_stream_early_stopping(spark):
    log = sources.train_log(spark, SF).groupBy("run", "epoch").agg(F.avg("loss").alias("loss")).collect()
    want = {}
    for run in {r.run for r in log}:
        best, at, bad, stop = math.inf, -1, 0, None
        for r in sorted((r for r in log if r.run == run), key=lambda r: r.epoch):
            if best - r.loss > 0.01:
                best, at, bad = r.loss, r.epoch, 0
            else:
                bad += 1
                if bad >= 4:
                    stop = r.epoch
                    break
        want[run] = (at, pytest.approx(best), stop)
    got = registry.queries()["st3_stream_early_stopping"](spark, SF).collect()
    assert {r.run: (r.best_epoch, r.best_loss, r.stop_epoch) for r in got} == want


def test_clusters_of_apart_groups(spark):
    rng = random.Random(3)
    rows = [(i, [10.0 * (i % 3) + rng.random(), rng.random()]) for i in range(90)]
    out, centres = selection.cluster_frames(spark.createDataFrame(rows, "id int, features array<double>"), 3)
    groups = {}
    for r in out.collect():
        groups.setdefault(r.cluster, set()).add(r.id % 3)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values()) and len(centres) == 3


def test_hausdorff(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 6, 7, (rng.random(42) < 0.3).astype(float).tolist(), (rng.random(42) < 0.3).astype(float).tolist()) for i in range(20)]
    got = {r.id: r.hausdorff for r in ra.hausdorff(spark.createDataFrame(rows, "id int, h int, w int, a array<double>, b array<double>"), "id int").collect()}
    for i, h, w, a, b in rows:
        p, q = ([(k // w, k % w) for k, v in enumerate(m) if v] for m in (a, b))
        assert got[i] == pytest.approx(max(max(min(math.dist(x, y) for y in v) for x in u) for u, v in ((p, q), (q, p))))


def test_frame_features(spark):
    flat, ramp = [128.0] * 64, [float(8 * (i % 8)) for i in range(64)]
    got = {r.k: r for r in ra.frame_features(spark.createDataFrame([(0, 8, 8, flat), (1, 8, 8, ramp)], "k int, h int, w int, px array<double>"), "k int").collect()}
    r = got[0]
    assert r.brightness == pytest.approx(128 / 255) and (r.contrast, r.entropy, r.sharpness, r.noise, r.edges, r.peaks, r.range, r.saturation) == (0, 0, 0, 0, 0, 0, 0, 0)
    r = got[1]
    assert r.brightness == pytest.approx(28 / 255) and r.entropy == pytest.approx(3 / 8) and r.saturation == pytest.approx(1 / 8) and r.contrast == pytest.approx(np.std(range(0, 64, 8)) / 255)
