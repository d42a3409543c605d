"""Queries of scores, rankings, selection and training statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.common import r6
from framespark.operators import scoring as op
from framespark.plans.tables import METRICS_SQL, metrics, table

Q, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


R = lambda e: f"floor(({e}) * 1e6 + 0.5) / 1e6"
GOOD = "(metric_key = 'dice')"

# points: line items of an order against a frame; distance from the discount, pairs of an order as matches
_MATCH = "select l_orderkey as frame_key, l_discount * 100 as distance from lineitem where l_discount < 0.06"
_COUNT = "select l_orderkey as frame_key, count(*) as n_pred, count(*) filter (where l_discount < 0.06) + count(*) filter (where l_returnflag = 'A' and l_discount >= 0.06) as n_true from lineitem group by 1"


@query("sc1_point_quality", f"""with j as (select c.*, coalesce(m.tp, 0) as tp, m.e from ({_COUNT}) c left join (select frame_key, count(*) tp, avg(distance) e from ({_MATCH}) group by 1) m on c.frame_key = m.frame_key),
 k as (select *, case when n_pred = 0 and n_true = 0 then 1.0 when n_pred = 0 then 0.0 else tp / n_pred end as p, case when n_pred = 0 and n_true = 0 then 1.0 when n_true = 0 then 0.0 else tp / n_true end as r from j),
 s as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f, case when n_pred = 0 and n_true = 0 then 1.0 when tp = 0 then 0.0 else least(greatest(1 - e / 8.0, 0), 1) end as l,
  case when n_pred = 0 and n_true = 0 then 1.0 else 1 - abs(n_pred - n_true) / greatest(n_pred, n_true) end as a from k)
 select frame_key, n_pred - tp as fp, n_true - tp as fn, {R("p")} as "precision", {R("r")} as recall, {R("0.4 * f + 0.3 * l + 0.3 * a")} as score from s""")
def sc1(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "frame_key")
    m = li.where("l_discount < 0.06").select("frame_key", (F.col("l_discount") * 100).alias("distance"))
    true = (F.col("l_discount") < 0.06) | (F.col("l_returnflag") == "A")
    c = li.groupBy("frame_key").agg(F.count(F.lit(1)).alias("n_pred"), F.count(F.when(true, 1)).alias("n_true"))
    return rounded(op.point_scores(m, c, 8.0), "precision", "recall", "score").select("frame_key", "fp", "fn", "precision", "recall", "score")


_PAIRS = "select l_orderkey as frame_key, l_discount * 10 as dice, l_tax * 10 as iou, l_quantity / 40 as bce, 1 - l_discount as agreement, l_suppkey as model_id, 1 - l_tax * 10 as quality from lineitem"


def _pairs(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("frame_key"), (c("l_discount") * 10).alias("dice"), (c("l_tax") * 10).alias("iou"), (c("l_quantity") / 40).alias("bce"), (1 - c("l_discount")).alias("agreement"), c("l_suppkey").alias("model_id"), (1 - c("l_tax") * 10).alias("quality"))


@query("sc2_pair_scores", f"""select frame_key, {R("avg(dice) * 100")} as dice, {R("avg(iou) * 100")} as iou, {R("(1 - least(avg(bce), 1)) * 100")} as bce,
 {R("(0.4 * avg(dice) + 0.4 * avg(iou) + 0.2 * (1 - least(avg(bce), 1))) * 100")} as overall from ({_PAIRS}) group by 1""")
def sc2(spark, d):
    return rounded(op.pair_scores(_pairs(spark, d)), "dice", "iou", "bce", "overall")


@query("sc3_frame_summary", f"""with f as (select o_orderkey as frame_key from orders), p as (select frame_key, avg(1 - agreement) as d, avg(agreement) as a from ({_PAIRS}) where frame_key % 3 <> 0 group by 1),
 q as (select frame_key, max(quality) as b, avg(quality) as m from ({_PAIRS}) where frame_key % 2 = 0 group by 1)
 select f.frame_key, {R("coalesce(d, 0.0)")} as disagreement, {R("coalesce(a, 1.0)")} as model_score, {R("b")} as best_quality, {R("m")} as mean_quality, {R("coalesce(1 - b, d, 0.0)")} as export_priority
 from f left join p on f.frame_key = p.frame_key left join q on f.frame_key = q.frame_key""")
def sc3(spark, d):
    p = _pairs(spark, d)
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_key"))
    out = op.frame_summary(f, p.where("frame_key % 3 <> 0"), p.where("frame_key % 2 = 0"))
    return rounded(out, "disagreement", "model_score", "best_quality", "mean_quality", "export_priority")


@query("sc4_model_ranking", f"""select model_id, n, {R("mean")} as mean, {R("median")} as median from (select model_id, count(*) as n, avg(quality) as mean, median(quality) as median from ({_PAIRS}) group by 1)""")
def sc4(spark, d):
    return rounded(op.model_ranking(_pairs(spark, d)), "mean", "median").drop("rank")


@query("sc5_relative_scores", f"""with b as (select metric_key, min(value) lo, max(value) hi from {METRICS_SQL} group by 1), j as (select m.*, case when hi > lo then (value - lo) / (hi - lo) else 0.0 end as rel from {METRICS_SQL} m join b on m.metric_key = b.metric_key)
 select frame, metric_key, {R("rel")} as relative, {R(f"case when {GOOD} then rel else 1 - rel end")} as display from j""")
def sc5(spark, d):
    return rounded(op.relative_scores(metrics(spark, d)), "relative", "display").drop("value")


_PCT = f"""(select frame, metric_key, value, case when n = 1 then 100.0 else 100.0 * (n - 1 - i) / (n - 1) end as percentile from (select *, row_number() over (partition by metric_key order by case when {GOOD} then -value else value end, frame) - 1 as i,
 count(*) over (partition by metric_key) as n from {METRICS_SQL}))"""


@query("sc6_metric_percentiles", f"select frame, metric_key, {R('percentile')} as percentile from {_PCT}")
def sc6(spark, d):
    return rounded(op.metric_percentiles(metrics(spark, d)), "percentile").drop("value")


@query("sc7_select_candidates", f"select frame, value from {METRICS_SQL} where metric_key = 'dice' order by value, frame limit 20")
def sc7(spark, d):
    return op.select_candidates(metrics(spark, d), "dice", top=20).select("frame", "value")


@query("sc7_select_badness", f"select frame, value from {_PCT} where metric_key = 'dice' and 100 - percentile >= 90")
def sc7b(spark, d):
    return op.select_candidates(metrics(spark, d), "dice", badness=90).select("frame", "value")


@query("sc8_add_neighbors", """with s as (select conv_id, turn from conversations where length(text) % 13 = 0), f as (select conv_id, turn from conversations)
 select f.conv_id, f.turn, case when exists (select 1 from s where s.conv_id = f.conv_id and s.turn = f.turn) then 'primary' else 'neighbor' end as reason
 from f where exists (select 1 from s where s.conv_id = f.conv_id and f.turn between s.turn - 1 and s.turn + 1)""")
def sc8(spark, d):
    c = table(spark, d, "conversations")
    frames = c.select(F.col("conv_id").alias("sequence_id"), F.struct("conv_id", "turn").alias("frame"), F.col("turn").alias("pos"))
    out = op.add_neighbors(c.where("length(text) % 13 = 0").select(F.struct("conv_id", "turn").alias("frame")), frames, 1)
    return out.select("frame.conv_id", "frame.turn", "reason")


@query("sc9_percentile_histogram", f"select metric_key, case when percentile < 15 then 0 when percentile < 35 then 1 when percentile < 60 then 2 else 3 end as band, count(*) as n from {_PCT} group by 1, 2")
def sc9(spark, d):
    return op.percentile_histogram(op.metric_percentiles(metrics(spark, d)))


@query("sc10_repeated_extremes", f"""select frame, hits, {R('m')} as mean_percentile, metrics from (select frame, count(*) as hits, avg(percentile) as m, string_agg(metric_key, ',' order by metric_key) as metrics
 from {_PCT} where percentile < 15 group by 1) order by hits desc, m, frame limit 25""")
def sc10(spark, d):
    return rounded(op.repeated_extremes(op.metric_percentiles(metrics(spark, d))), "mean_percentile")


@query("sc11_metric_levels", f"""select frame, metric_key, {R('r')} as ratio, case when metric_key = 'dice' then case when r < 0.33 then 'poor' when r < 0.66 then 'fair' else 'good' end
 when r < 0.15 then 'low' when r < 0.35 then 'moderate' when r < 0.6 then 'elevated' else 'high' end as level from (select *, least(greatest(value / 100, 0), 1) as r from {METRICS_SQL})""")
def sc11(spark, d):
    m = metrics(spark, d).withColumn("value", F.col("value") / 100)
    return rounded(op.metric_levels(m), "ratio").drop("value")


@query("sc12_robust_anomaly", f"""with m as {METRICS_SQL}, c as (select metric_key, median(value) as c, stddev_pop(value) as s from m group by 1), dd as (select m.frame, m.metric_key, abs(value - c) as d, s from m join c on m.metric_key = c.metric_key),
 mad as (select metric_key, median(d) as mad from dd group by 1) select frame, {R("avg(least(dd.d / (case when mad > 1e-8 then mad * 1.4826 else s + 1e-8 end) / 3, 1))")} as anomaly from dd join mad on dd.metric_key = mad.metric_key group by 1""")
def sc12(spark, d):
    return rounded(op.robust_anomaly(metrics(spark, d).withColumnRenamed("metric_key", "feature")), "anomaly")


_SWEEP = """select t.t as threshold, count(*) filter (where s >= t.t and y) as tp, count(*) filter (where s >= t.t and not y) as fp, count(*) filter (where s < t.t and y) as fn, count(*) filter (where s < t.t and not y) as tn
 from (select least(n_chars / 6000, 1) as s, quality = 1 as y from documents d join labels l on d.doc_id = l.doc_id) x, (select round(0.1 + i * 0.05, 2) as t from range(17) r(i)) t group by 1"""


@query("sc14_threshold_sweep", f"select threshold, tp, fp, fn, tn, {R('(tp + tn) / (tp + fp + fn + tn)')} as accuracy, {R('case when tp + fp + fn = 0 then 1 else tp / (tp + fp + fn) end')} as iou, {R('case when tp + fp + fn = 0 then 1 else 2 * tp / (2 * tp + fp + fn) end')} as dice from ({_SWEEP})")
def sc14(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(op.threshold_sweep(j.select(F.least(F.col("n_chars") / 6000, F.lit(1.0)).alias("score"), F.col("quality").alias("label"))), "accuracy", "iou", "dice")


@query("sc15_overlap_losses", f"""with v as (select vec_id, list_transform(embedding, lambda x: least(greatest(0.5 + x::double, 0), 1)) as p, list_transform(embedding, lambda x: case when x > 0 then 1.0 else 0.0 end) as y from embeddings),
 w as (select vec_id, list_sum(p) as sp, list_sum(y) as sy, list_sum(list_transform(range(1, 65), lambda i: p[i] * y[i])) as b from v)
 select vec_id, {R("case when sy <= 0 then sp / 64 else 1 - (2 * b + 1e-6) / (sp + sy + 1e-6) end")} as dice_loss, {R("case when sy <= 0 then sp / 64 else 1 - (b + 1e-6) / (sp + sy - b + 1e-6) end")} as iou_loss from w""")
def sc15(spark, d):
    e = table(spark, d, "embeddings")
    p = F.transform("embedding", lambda x: F.least(F.greatest(F.lit(0.5) + x.cast("double"), F.lit(0.0)), F.lit(1.0)))
    y = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return rounded(e.select("vec_id", op.overlap_losses(p, y).alias("l")).select("vec_id", "l.*"), "dice_loss", "iou_loss")


_LOG = "(select event_type as run, cast(extract(day from ts) as bigint) as epoch, cast(extract(hour from ts) as bigint) as batch, value as loss, event_id % 5 + 1 as n, value / 10 as load_time, (event_id % 7) / 2 as compute_time, event_id % 11 = 0 as uniform from events where value is not null)"


def train_log(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.select(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch"), F.hour("ts").cast("long").alias("batch"), F.col("value").alias("loss"), (F.col("event_id") % 5 + 1).alias("n"), (F.col("value") / 10).alias("load_time"), (F.col("event_id") % 7 / 2).alias("compute_time"), (F.col("event_id") % 11 == 0).alias("uniform"))


@query("sc16_epoch_stats", f"""select run, epoch, {R("sum(case when not uniform then loss * n end) / sum(case when not uniform then n end)")} as loss, cast(sum(case when not uniform then n end) as bigint) as n_samples, {R("sum(load_time) / (sum(load_time) + sum(compute_time))")} as load_share,
 case when sum(load_time) >= sum(compute_time) then 'load' else 'compute' end as dominant, count(*) filter (where uniform) as skipped from {_LOG} group by 1, 2""")
def sc16(spark, d):
    return rounded(op.epoch_stats(train_log(spark, d)), "loss", "load_share").drop("load_time", "compute_time")


# runs: users; epochs: their events in order
_RUNS = "(select user_id as run, row_number() over (partition by user_id order by event_id) as epoch, value as loss from events where value is not null)"


@query("sc17_early_stopping", f"""with recursive x as (select * from {_RUNS}), s as (select run, epoch, loss as best, epoch as best_epoch, 0 as bad, cast(null as bigint) as stop from x where epoch = 1
 union all select s.run, x.epoch, case when s.best - x.loss > 0.5 then x.loss else s.best end, case when s.best - x.loss > 0.5 then x.epoch else s.best_epoch end, case when s.best - x.loss > 0.5 then 0 else s.bad + 1 end,
  case when s.best - x.loss > 0.5 then null when s.bad + 1 >= 4 then x.epoch end from s join x on x.run = s.run and x.epoch = s.epoch + 1 where s.stop is null)
 select run, best_epoch, {R("best")} as best_loss, stop as stop_epoch from (select *, row_number() over (partition by run order by epoch desc) as n from s) where n = 1""")
def sc17(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").where("value is not null")
    log = e.select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("epoch"), F.col("value").alias("loss"))
    return rounded(op.early_stopping(log, 4, 0.5), "best_loss")


@query("sc18_quality_gates", """select p_partkey, array_to_string(list_filter([case when p_size / 50 < 0.88 then 'via_precision' end, case when (p_partkey % 100) / 100 < 0.82 then 'via_recall' end, case when (p_partkey % 37) / 37 < 0.9 then 'conductor_recall' end,
 case when (p_partkey % 13) / 10 > 1.2 then 'via_false_positives_per_frame' end, case when p_size / 20 > 2.0 then 'via_center_shift_px' end], lambda x: x is not null), ',') as failures,
 not (p_size / 50 < 0.88 or (p_partkey % 100) / 100 < 0.82 or (p_partkey % 37) / 37 < 0.9 or (p_partkey % 13) / 10 > 1.2 or p_size / 20 > 2.0) as passed from part""")
def sc18(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, (F.col("p_size") / 50).alias("via_precision"), (k % 100 / 100).alias("via_recall"), (k % 37 / 37).alias("conductor_recall"), (k % 13 / 10).alias("via_false_positives_per_frame"), (F.col("p_size") / 20).alias("via_center_shift_px"))
    return op.quality_gates(p).select("p_partkey", F.array_join("failures", ",").alias("failures"), "passed")


@query("sc19_corrective_candidates", f"select frame, {R('risk')} as risk from (select o_orderkey as frame, 0.85 * (1 - least(o_totalprice / 400000, 1)) + 0.15 * (o_orderkey % 10) / 10 as risk from orders) order by risk desc, frame limit 50")
def sc19(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_totalprice") / 400000).alias("score"), (F.col("o_orderkey") % 10 / 10).alias("priority"))
    return rounded(op.corrective_candidates(o, 50), "risk").select("frame", "risk")


_TUNE = "(select l_orderkey as frame, min(l_linenumber) as config, l_partkey as part, avg(l_discount) * 10 as iou, avg(l_tax) * 12 as b, avg(l_quantity) / 50 as t, avg(l_tax) * 10 as p, 0.5 + avg(l_quantity) / 50 as c from lineitem group by 1, 3)"


@query("sc20_mask_tuning_score", f"""select frame, part as config, {R("f")} as final_score from (select *, row_number() over (partition by frame order by f desc, part) as r2 from (select *, (0.85 * p + 0.15 * m) * least(c, 1 / c) as f from (
 select *, row_number() over (partition by frame order by m desc, part) as r from (select *, 0.55 * iou + 0.30 * b + 0.15 * t as m from {_TUNE})) where r <= 3)) where r2 = 1""")
def sc20(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("config")).agg(
        (F.avg("l_discount") * 10).alias("iou"), (F.avg("l_tax") * 12).alias("boundary_f1"), (F.avg("l_quantity") / 50).alias("topology"), (F.avg("l_tax") * 10).alias("poly_score"), (0.5 + F.avg("l_quantity") / 50).alias("count_ratio")
    )
    return rounded(op.mask_tuning_score(li, 3), "final_score").select("frame", "config", "final_score")
