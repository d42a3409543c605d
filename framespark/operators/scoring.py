"""Scores of frames, pairs and models: weighting, ranking, percentiles, selection, training statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framespark.functions.common import EPS, clip, stash, total, work_dir

#: Weights and limits (fixed values).
POINT_QUALITY = {"f1": 0.40, "localization": 0.30, "count": 0.30}
POINT_AGREEMENT = {"f1": 0.50, "localization": 0.30, "count": 0.20}
BANDS = (15.0, 35.0, 60.0)
#: Metrics of which more is better; families (before "::") of which it is; all others are better when lower (fixed values).
HIGHER = (
    "labeled_best_quality", "labeled_mean_quality", "model_model_score", "model_labeled_score", "iou", "dice", "iou_score", "dice_score",
    "polygon_bce_score", "overall_polygon_score", "precision", "recall", "f1", "precision_score", "recall_score", "f1_score", "localization_score",
    "overall_point_score",
)
HIGHER_FAMILIES = ("model_point_contrast",)
#: Metrics in percent (fixed values).
PERCENT = (
    "overall_polygon_score", "iou_score", "dice_score", "polygon_bce_score", "overall_point_score", "precision_score", "recall_score", "f1_score", "localization_score",
)
CONFIDENCE_FAMILIES = ("model_confidence", "model_output_confidence")


def point_scores(matches: DataFrame, counts: DataFrame, radius: float, weights: dict[str, float] = POINT_QUALITY, keys: tuple[str, ...] = ("frame_key",)) -> DataFrame:
    """Precision, recall, f1, localisation and count agreement of matched points.

    matches(keys, distance) against counts(keys, n_pred, n_true); both sides empty scores 1.
    """
    m = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"), F.avg("distance").alias("mean_error"))
    j = counts.join(m, list(keys), "left").na.fill(0, ["tp"])
    p, t, tp = F.col("n_pred"), F.col("n_true"), F.col("tp")
    empty = (p == 0) & (t == 0)
    part = lambda n: F.when(empty, 1.0).when(n == 0, 0.0).otherwise(tp / n)
    j = j.withColumns({"fp": p - tp, "fn": t - tp, "precision": part(p), "recall": part(t)})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    loc = F.when(empty, 1.0).when(tp == 0, 0.0).otherwise(clip(1 - F.col("mean_error") / radius))
    agree = F.when(empty, 1.0).otherwise(1 - F.abs(p - t) / F.greatest(p, t))
    j = j.withColumns({"f1": f1, "localization": loc, "count": agree})
    return j.withColumn("score", sum(F.col(k) * w for k, w in weights.items()))


def pair_scores(pairwise: DataFrame) -> DataFrame:
    """(frame_key, dice, iou, bce, overall): means over pairs times 100; overall .4 dice, .4 iou, .2 of 1 - min(bce, 1)."""
    g = pairwise.groupBy("frame_key").agg(F.avg("dice").alias("d"), F.avg("iou").alias("i"), F.avg("bce").alias("b"))
    b = 1 - F.least("b", F.lit(1.0))
    return g.select("frame_key", (F.col("d") * 100).alias("dice"), (F.col("i") * 100).alias("iou"), (b * 100).alias("bce"), ((0.4 * F.col("d") + 0.4 * F.col("i") + 0.2 * b) * 100).alias("overall"))


def frame_summary(frames: DataFrame, pairwise: DataFrame, quality: DataFrame) -> DataFrame:
    """(frame_key, disagreement, model_score, best_quality, mean_quality, export_priority)."""
    p = pairwise.groupBy("frame_key").agg(F.avg(1 - F.col("agreement")).alias("_d"), F.avg("agreement").alias("_a"))
    q = quality.groupBy("frame_key").agg(F.max("quality").alias("best_quality"), F.avg("quality").alias("mean_quality"))
    j = frames.join(p, "frame_key", "left").join(q, "frame_key", "left")
    j = j.withColumns({"disagreement": F.coalesce("_d", F.lit(0.0)), "model_score": F.coalesce("_a", F.lit(1.0))}).drop("_d", "_a")
    return j.withColumn("export_priority", F.coalesce(1 - F.col("best_quality"), F.col("disagreement")))


def model_ranking(quality: DataFrame) -> DataFrame:
    """(model_id, n, mean, median, rank) by (mean, median, n) descending, then model_id."""
    g = quality.groupBy("model_id").agg(F.count("quality").alias("n"), F.avg("quality").alias("mean"), F.percentile("quality", F.lit(0.5)).alias("median"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), F.desc("median"), F.desc("n"), "model_id")))


def _family(key: Column) -> Column:
    return F.element_at(F.split(key, "::"), 1)


def higher_is_better(key: Column) -> Column:
    """Direction of a metric by its key."""
    return key.isin(*HIGHER) | (F.contains(key, F.lit("::")) & _family(key).isin(*HIGHER_FAMILIES))


def relative_scores(metrics: DataFrame) -> DataFrame:
    """metrics(frame, metric_key, value) with relative (min-max over the metric, 0 when flat) and display (1 - relative if lower is better).

    Bounds are one row per metric, joined back; no window over all rows of a metric.
    """
    b = metrics.groupBy("metric_key").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = metrics.join(b, "metric_key")
    rel = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    j = j.withColumn("relative", rel).drop("_lo", "_hi")
    return j.withColumn("display", F.when(higher_is_better(F.col("metric_key")), F.col("relative")).otherwise(1 - F.col("relative")))


def metric_percentiles(metrics: DataFrame, badness: bool = False) -> DataFrame:
    """metrics with percentile: 100 * (n - 1 - i) / (n - 1) in order from good to bad (100 for a single row), finite values only.

    A metric may have a row per frame, so ranks are taken in two steps: rows are range-partitioned by (metric, order) once,
    numbered inside (metric, partition) and shifted by the counts of earlier partitions. Ties go by frame.
    """
    finite = metrics.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    sign = F.when(higher_is_better(F.col("metric_key")), -F.col("value")).otherwise(F.col("value"))
    spark = metrics.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = finite.withColumn("_o", sign).repartitionByRange(n, "metric_key", "_o", "frame").withColumn("_part", F.spark_partition_id())
    placed = stash(placed, f"{work_dir(spark)}/placed")
    counts = placed.groupBy("metric_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("metric_key").orderBy("_part")
    counts = counts.select("metric_key", "_part", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("metric_key")).alias("_all"))
    local = placed.withColumn("_i", F.row_number().over(Window.partitionBy("metric_key", "_part").orderBy("_o", "frame")) - 1)
    j = local.join(counts, ["metric_key", "_part"]).withColumn("_i", F.col("_i") + F.col("_before"))
    good = F.when(F.col("_all") == 1, 100.0).otherwise(100.0 * (F.col("_all") - 1 - F.col("_i")) / (F.col("_all") - 1))
    pct = F.when(F.col("_all") == 1, 100.0).otherwise(100.0 - good) if badness else good
    return j.withColumn("percentile", pct).drop("_o", "_part", "_i", "_before", "_all")


def select_candidates(metrics: DataFrame, metric_key: str, top: int | None = None, percent: float | None = None, badness: float | None = None) -> DataFrame:
    """Worst frames of a metric first: the top ones, the top percent (rounded up), or those whose badness percentile reaches a limit."""
    own = metrics.where(F.col("metric_key") == metric_key)
    if badness is not None:
        ranked = metric_percentiles(own, badness=True)
        best = ranked.agg(F.max("percentile").alias("_m"))
        # at least one row: the worst one also if the limit is above its percentile
        return ranked.crossJoin(F.broadcast(best)).where((F.col("percentile") >= badness) | (F.col("percentile") == F.col("_m"))).drop("_m")
    if percent is not None:
        n = own.count()
        top = max(1, -(-int(n * percent * 1000) // 100_000)) if n else 0
    bad = F.when(higher_is_better(F.col("metric_key")), F.col("value")).otherwise(-F.col("value"))
    return own.orderBy(bad, "frame").limit(int(top or 0))


def add_neighbors(selected: DataFrame, frames: DataFrame, radius: int) -> DataFrame:
    """(frame, reason): selected frames are primary; frames within radius places in their sequence are neighbors.

    frames(sequence_id, frame, pos) with a dense pos in natural order. Every selected frame names the places around it, so
    the join has a key and no sequence is sorted as a whole.
    """
    own = frames.join(selected.select("frame").distinct(), "frame", "left_semi")
    near = own.select("sequence_id", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos")).distinct()
    around = frames.join(near, ["sequence_id", "pos"]).join(selected.select("frame"), "frame", "left_anti")
    return own.select("frame", F.lit("primary").alias("reason")).union(around.select("frame", F.lit("neighbor")))


def band(pct: Column) -> Column:
    """0 to 3 for the bands [0, 15), [15, 35), [35, 60), [60, 100]."""
    return sum((pct >= x).cast("int") for x in BANDS)


def percentile_histogram(pct: DataFrame) -> DataFrame:
    return pct.groupBy("metric_key", band(F.col("percentile")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def repeated_extremes(pct: DataFrame, kind: str = "bad", top: int = 25) -> DataFrame:
    """(frame, hits, mean_percentile, metrics): frames that lie in the bad (< 15) or good (>= 60) band most often."""
    some = pct.where(F.col("percentile") < BANDS[0]) if kind == "bad" else pct.where(F.col("percentile") >= BANDS[2])
    g = some.groupBy("frame").agg(F.count(F.lit(1)).alias("hits"), F.avg("percentile").alias("mean_percentile"), F.array_join(F.array_sort(F.collect_list("metric_key")), ",").alias("metrics"))
    mean = F.col("mean_percentile") if kind == "bad" else -F.col("mean_percentile")
    return g.orderBy(F.desc("hits"), mean, "frame").limit(top)


def metric_levels(df: DataFrame, radius: float = 1.0, bce_cap: float = 1.0) -> DataFrame:
    """df(metric_key, value) with ratio in [0, 1] and level.

    Percent metrics go by 100, bce by its cap, localisation distance by the match radius, all others as they are. Confidence
    families have four levels by the risk bands; others three by thirds, named by their direction.
    """
    k, v = F.col("metric_key"), F.col("value")
    ratio = F.when(k.isin(*PERCENT), v / 100).when(k == "bce", v / max(bce_cap, 1e-9)).when(k == "mean_localization_distance", v / max(radius, 1e-9)).otherwise(v)
    df = df.withColumn("ratio", clip(ratio))
    r = F.col("ratio")
    confidence = F.when(r < 0.15, "low").when(r < 0.35, "moderate").when(r < 0.60, "elevated").otherwise("high")
    good = F.when(r < 0.33, "poor").when(r < 0.66, "fair").otherwise("good")
    low = F.when(r < 0.33, "low").when(r < 0.66, "medium").otherwise("high")
    level = F.when(_family(k).isin(*CONFIDENCE_FAMILIES), confidence).when(higher_is_better(k), good).otherwise(low)
    return df.withColumn("level", F.when(v.isNotNull(), level))


def robust_anomaly(features: DataFrame) -> DataFrame:
    """(frame, anomaly): mean over features(frame, feature, value) of clip(|z| / 3) with z by median and MAD (deviation if MAD is 0)."""
    c = features.groupBy("feature").agg(F.percentile("value", F.lit(0.5)).alias("_m"), F.stddev_pop("value").alias("_s"))
    d = features.join(c, "feature").withColumn("_d", F.abs(F.col("value") - F.col("_m")))
    mad = d.groupBy("feature").agg(F.percentile("_d", F.lit(0.5)).alias("_mad"))
    j = d.join(mad, "feature")
    scale = F.when(F.col("_mad") > EPS, F.col("_mad") * 1.4826).otherwise(F.col("_s") + EPS)
    return j.groupBy("frame").agg(F.avg(clip(F.col("_d") / scale / 3)).alias("anomaly"))


def threshold_sweep(scores: DataFrame, start: float = 0.10, stop: float = 0.90, step: float = 0.05) -> DataFrame:
    """(threshold, tp, fp, fn, tn, accuracy, iou, dice) of scores(score, label) at each threshold; 1 where nothing is positive."""
    n = round((stop - start) / step) + 1
    t = scores.sparkSession.range(n).select(F.round(F.lit(start) + F.col("id") * step, 2).alias("threshold"))
    # thresholds are a fixed handful; each row meets all of them and is summed on the map side
    x = scores.crossJoin(F.broadcast(t)).select("threshold", (F.col("score") >= F.col("threshold")).alias("p"), (F.col("label") == 1).alias("y"))
    c = lambda e: F.count(F.when(e, 1))
    g = x.groupBy("threshold").agg(c(F.col("p") & F.col("y")).alias("tp"), c(F.col("p") & ~F.col("y")).alias("fp"), c(~F.col("p") & F.col("y")).alias("fn"), c(~F.col("p") & ~F.col("y")).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    union = tp + fp + fn
    return g.withColumns({"accuracy": (tp + tn) / (union + tn), "iou": F.when(union == 0, 1.0).otherwise(tp / union), "dice": F.when(union == 0, 1.0).otherwise(2 * tp / (union + tp))})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The one row by (dice, iou, closeness to .5)."""
    return sweep.orderBy(F.desc("dice"), F.desc("iou"), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)


def overlap_losses(pred: Column, label: Column, eps: float = 1e-6) -> Column:
    """struct(dice_loss, iou_loss) of two arrays; without a target the mean predicted mass."""
    both = total(F.zip_with(pred, label, lambda p, y: p * y))
    p, y = total(pred), total(label)
    mass = clip(p / F.size(pred))
    return F.struct(
        F.when(y <= 0, mass).otherwise(clip(1 - (2 * both + eps) / (p + y + eps))).alias("dice_loss"), F.when(y <= 0, mass).otherwise(clip(1 - (both + eps) / (p + y - both + eps))).alias("iou_loss")
    )


def epoch_stats(log: DataFrame) -> DataFrame:
    """(run, epoch, loss, n_samples, load_time, compute_time, load_share, dominant, skipped) of log(run, epoch, batch, loss, n, load_time, compute_time, uniform)."""
    g = log.groupBy("run", "epoch").agg(
        F.sum(F.when(~F.col("uniform"), F.col("loss") * F.col("n"))).alias("_l"), F.sum(F.when(~F.col("uniform"), F.col("n"))).alias("n_samples"),
        F.sum("load_time").alias("load_time"), F.sum("compute_time").alias("compute_time"), F.count(F.when(F.col("uniform"), 1)).alias("skipped"),
    )
    t = F.col("load_time") + F.col("compute_time")
    g = g.withColumns({"loss": F.col("_l") / F.col("n_samples"), "load_share": F.when(t > 0, F.col("load_time") / t).otherwise(0.0)}).drop("_l")
    return g.withColumn("dominant", F.when(F.col("load_time") >= F.col("compute_time"), "load").otherwise("compute"))


def early_stopping(log: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """(run, best_epoch, best_loss, stop_epoch) of log(run, epoch, loss): one fold over the epochs of each run.

    A loss improves iff best - loss > min_delta; the run stops at the first epoch with so many epochs without improvement.
    """
    inf = F.lit(float("inf"))
    start = F.struct(inf.alias("best"), F.lit(None).cast("long").alias("best_epoch"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        better = s["best"] - x["loss"] > min_delta
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        moved = F.struct(
            F.when(better, x["loss"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            bad.alias("bad"), F.when((bad >= patience) & (bad > 0), x["epoch"]).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    g = log.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss")))).alias("_x"))
    return g.withColumn("_s", F.aggregate("_x", start, step)).select("run", F.col("_s.best_epoch").alias("best_epoch"), F.col("_s.best").alias("best_loss"), F.col("_s.stop").alias("stop_epoch"))


#: gate -> (limit, whether a value must not be below it), in order of report (fixed values).
GATES = {
    "via_precision": (0.88, True), "via_recall": (0.82, True), "conductor_recall": (0.90, True), "via_false_positives_per_frame": (1.2, False), "via_center_shift_px": (2.0, False),
}


def quality_gates(df: DataFrame, gates: dict[str, tuple[float, bool]] = GATES) -> DataFrame:
    """df with failures (names of failed gates in order) and passed."""
    tests = [F.when(F.col(k) < v if least else F.col(k) > v, F.lit(k)) for k, (v, least) in gates.items()]
    return df.withColumn("failures", F.filter(F.array(*tests), lambda x: x.isNotNull())).withColumn("passed", F.size("failures") == 0)


def corrective_candidates(df: DataFrame, k: int) -> DataFrame:
    """The k frames of greatest risk .85 (1 - clip(score)) + .15 clip(priority)."""
    risk = 0.85 * (1 - clip(F.col("score"))) + 0.15 * clip(F.col("priority"))
    return df.withColumn("risk", risk).orderBy(F.desc("risk"), "frame").limit(k)


def mask_tuning_score(df: DataFrame, keep: int = 12) -> DataFrame:
    """Best configuration per frame from df(frame, config, iou, boundary_f1, topology, poly_score, count_ratio).

    mask = .55 iou + .30 boundary + .15 topology; the keep best by mask are scored (.85 poly + .15 mask) * count penalty.
    """
    d = df.withColumn("mask_score", 0.55 * F.col("iou") + 0.30 * F.col("boundary_f1") + 0.15 * F.col("topology"))
    first = d.withColumn("_r", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("mask_score"), "config"))).where(F.col("_r") <= keep)
    final = (0.85 * F.col("poly_score") + 0.15 * F.col("mask_score")) * F.least(F.col("count_ratio"), 1 / F.col("count_ratio"))
    last = first.withColumn("final_score", final).withColumn("_r", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("final_score"), "config")))
    return last.where("_r = 1").drop("_r")
