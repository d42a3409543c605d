"""Queries of raster operators: embeddings stand for 8 x 8 probability maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.common import r6
from framespark.operators import patterns
from framespark.operators import rasters as op
from framespark.plans.tables import table

Q, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = lambda e: f"floor(({e}) * 1e6 + 0.5) / 1e6"
RASTERS = "(select vec_id, vec_id // 3 as frame_key, vec_id % 3 as model_id, list_transform(embedding, lambda x: least(greatest(0.5 + x::double, 0), 1)) as px from embeddings)"
PAIRS = f"(select a.vec_id, a.frame_key, a.model_id as ma, b.model_id as mb, a.px as a, b.px as b from {RASTERS} a join {RASTERS} b on a.frame_key = b.frame_key and a.model_id < b.model_id)"
ZIP = lambda f, a="a", b="b": f"list_sum(list_transform(range(1, 65), lambda i: {f}))".replace("A_", f"{a}[i]").replace("B_", f"{b}[i]")


def rasters(spark, d):
    """rasters(vec_id, frame_key, model_id, h, w, px) from embeddings."""
    e = table(spark, d, "embeddings")
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.lit(0.5) + x.cast("double"), F.lit(0.0)), F.lit(1.0)))
    return e.select("vec_id", F.expr("vec_id div 3").alias("frame_key"), (F.col("vec_id") % 3).alias("model_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), px.alias("px"))


def pairs(spark, d):
    r = rasters(spark, d)
    a = r.select("vec_id", "frame_key", F.col("model_id").alias("ma"), "h", "w", F.col("px").alias("a"))
    b = r.select("frame_key", F.col("model_id").alias("mb"), F.col("px").alias("b"))
    return a.join(b, "frame_key").where("ma < mb")


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query("ra1_unit_map", f"select vec_id, {R('list_sum(list_transform(embedding, lambda x: least(greatest(x::double * 300 / 255, 0), 1)))')} as mass from embeddings")
def ra1(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", op.unit_map(F.transform("embedding", lambda x: x.cast("double") * 300)).alias("px"))
    return rounded(e.select("vec_id", op.total(F.col("px")).alias("mass")), "mass")


@query("ra2_graded_uncertainty", f"select vec_id, {R('list_sum(list_transform(px, lambda p: 1 - 2 * abs(p - 0.5)))')} as mass from {RASTERS}")
def ra2(spark, d):
    return rounded(rasters(spark, d).select("vec_id", op.total(op.graded_uncertainty(F.col("px"))).alias("mass")), "mass")


@query("ra2_border_uncertainty", f"""with m as (select vec_id, i, (i - 1) // 8 as y, (i - 1) % 8 as x, case when vec_id % 4 = 0 then px[i] else (px[i] >= 0.5)::int end as p from {RASTERS}, range(1, 65) t(i)),
 n as (select a.vec_id, a.i, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as d from m a join m b on a.vec_id = b.vec_id and a.p <> b.p where a.vec_id % 4 <> 0 group by 1, 2)
 select vec_id, {R('sum(case when vec_id % 4 = 0 then 1 - 2 * abs(p - 0.5) else greatest(1 - coalesce(d, 1e9) / 4, 0) end)')} as mass from m left join n using (vec_id, i) group by 1""")
def ra2_border(spark, d):
    r = rasters(spark, d)
    mask = F.transform("px", lambda p: F.when(p >= 0.5, 1.0).otherwise(0.0))
    r = r.withColumn("px", F.when(F.col("vec_id") % 4 == 0, F.col("px")).otherwise(mask))
    return rounded(op.algorithmic_uncertainty(r).select("vec_id", op.total(F.col("u")).alias("mass")), "mass")


@query("ra3_bad_area", f"select vec_id, {R('list_sum(list_transform(px, lambda p: case when 1 - 2 * abs(p - 0.5) > 0.8 then pow((1 - 2 * abs(p - 0.5) - 0.8) / 0.2, 0.65) else 0.0 end))')} as mass from {RASTERS}")
def ra3(spark, d):
    return rounded(rasters(spark, d).select("vec_id", op.total(op.bad_area(op.graded_uncertainty(F.col("px")))).alias("mass")), "mass")


@query("ra3_combine_maps", f"select vec_id, mb, {R(ZIP('least(A_, B_)'))} as agreement, {R(ZIP('greatest(A_ - B_, 0)'))} as only_a, {R(ZIP('greatest(B_ - A_, 0)'))} as only_b from {PAIRS}")
def ra3b(spark, d):
    p = pairs(spark, d)
    return rounded(p.select("vec_id", "mb", *[op.total(c).alias(k) for k, c in op.combine_maps(F.col("a"), F.col("b")).items()]), "agreement", "only_a", "only_b")


_M = lambda x: f"(case when {x} >= 0.5 then 1.0 else 0.0 end)"
_AGREE = f"""with s as (select vec_id, mb, list_sum(a) as sa, list_sum(b) as sb, {ZIP('least(A_, B_)')} as mn, {ZIP('greatest(A_, B_)')} as mx, {ZIP('A_ * A_')} as aa, {ZIP('B_ * B_')} as bb, {ZIP('A_ * B_')} as ab,
 {ZIP(_M('A_'))} as na, {ZIP(_M('B_'))} as nb, {ZIP(_M('A_') + '*' + _M('B_'))} as nn, {ZIP('abs(A_ - B_)')} / 64 as mae, sqrt({ZIP('(A_ - B_) * (A_ - B_)')} / 64) as rmse from {PAIRS}),
 t as (select *, sa / 64 as ua, sb / 64 as ub, aa / 64 - (sa / 64) * (sa / 64) as va, bb / 64 - (sb / 64) * (sb / 64) as vb, ab / 64 - (sa / 64) * (sb / 64) as cv from s)
 select vec_id, mb, {R('2 * mn / (sa + sb)')} as soft_dice, {R('mn / mx')} as soft_iou, {R('((2 * ua * ub + 0.0001) * (2 * cv + 0.0009)) / ((ua * ua + ub * ub + 0.0001) * (va + vb + 0.0009))')} as ssim,
 {R('case when na + nb <= 1e-8 then 1 else 2 * nn / (na + nb) end')} as dice, {R('case when na + nb - nn <= 1e-8 then 1 else nn / (na + nb - nn) end')} as iou, {R('mae')} as mae, {R('rmse')} as rmse from t"""


@query("ra4_mask_agreement", _AGREE)
def ra4(spark, d):
    names = ("soft_dice", "soft_iou", "ssim", "dice", "iou", "mae", "rmse")
    return rounded(op.mask_agreement(pairs(spark, d)), *names).select("vec_id", "mb", *names)


@query("ra4_hausdorff")
def ra4b(spark, d):
    return op.hausdorff(pairs(spark, d), "vec_id long, mb long")


@query("ra5_mask_quality", f"""with s as (select vec_id, mb, {ZIP(_M('A_'))} as p, {ZIP(_M('B_'))} as t, {ZIP(_M('A_') + '*' + _M('B_'))} as tp from {PAIRS})
 select vec_id, mb, {R('case when p = 0 and t = 0 then 1 when p = 0 then 0 else tp / p end')} as "precision", {R('case when p = 0 and t = 0 then 1 when t = 0 then 0 else tp / t end')} as recall,
 {R('1 - ((case when p + t <= 1e-8 then 1 else 2 * tp / (p + t) end) + (case when p + t - tp <= 1e-8 then 1 else tp / (p + t - tp) end)) / 2')} as error from s""")
def ra5(spark, d):
    return rounded(op.mask_quality(pairs(spark, d), "a", "b"), "precision", "recall", "error").select("vec_id", "mb", "precision", "recall", "error")


@query("ra6_compare_masks", f"""select vec_id, mb, {R(ZIP('case when (A_ >= 0.5) <> (B_ >= 0.5) then 1.0 else 0.0 end') + ' / 64')} as "xor", {R(ZIP('case when A_ >= 0.5 and B_ < 0.5 then 1.0 else 0.0 end') + ' / 64')} as a_minus_b, {R(ZIP('abs(A_ - B_)') + ' / 64')} as gray from {PAIRS}""")
def ra6(spark, d):
    return rounded(pairs(spark, d).select("vec_id", "mb", *[op.compare_masks(F.col("a"), F.col("b"), m).alias(m) for m in ("xor", "a_minus_b", "gray")]), "xor", "a_minus_b", "gray")


@query("ra7_consensus", f"""with x as (select frame_key, i, avg(px[i]) as m, greatest(avg(px[i] * px[i]) - avg(px[i]) * avg(px[i]), 0) as v from {RASTERS}, range(1, 65) t(i) group by 1, 2)
 select frame_key, {R('avg(case when m <= 0 or m >= 1 then 0.0 else -(m * log2(m) + (1 - m) * log2(1 - m)) end)')} as entropy, {R('avg(v)')} as variance from x group by 1""")
def ra7(spark, d):
    p = op.mask_agreement(pairs(spark, d)).select("frame_key", "dice")
    return rounded(op.consensus(rasters(spark, d), p), "entropy", "variance").select("frame_key", "entropy", "variance")


@query("ra8_frame_uncertainty", f"""with u as (select vec_id, list_transform(px, lambda p: 1 - 2 * abs(p - 0.5)) as u from {RASTERS}), s as (select vec_id, list_sum(u) / 64 as m, len(list_filter(u, lambda x: x > 0.15)) / 64 as f, list_sum(list_reverse_sort(u)[1:7]) / 7 as t from u)
 select vec_id, {R('m')} as mean, {R('f')} as fraction, {R('t')} as top, {R('0.15 * m + 0.25 * f + 0.35 * t')} as risk from s""")
def ra8(spark, d):
    u = rasters(spark, d).select("vec_id", op.graded_uncertainty(F.col("px")).alias("u"))
    return rounded(op.frame_uncertainty(u), "mean", "fraction", "top", "risk").drop("u")


@query("ra8_region_uncertainty", f"""with recursive u as (select vec_id, list_transform(px, lambda p: 1 - 2 * abs(p - 0.5)) as u from {RASTERS}), c as (select vec_id, i, (i - 1) // 8 as y, (i - 1) % 8 as x from u, range(1, 65) t(i) where u[i] > 0.6),
 e as (select a.vec_id, a.i as a, b.i as b from c a join c b on a.vec_id = b.vec_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1), r as (select vec_id, a, b from e union select r.vec_id, r.a, e.b from r join e on e.vec_id = r.vec_id and e.a = r.b),
 g as (select vec_id, max(n) / 64 as region from (select vec_id, a, count(*) as n from r group by 1, 2) group by 1)
 select vec_id, {R('coalesce(region, 0)')} as region, {R('0.15 * list_sum(u) / 64 + 0.25 * len(list_filter(u, lambda x: x > 0.6)) / 64 + 0.35 * list_sum(list_reverse_sort(u)[1:7]) / 7 + 0.25 * coalesce(region, 0)')} as risk from u left join g using (vec_id)""")
def ra8_region(spark, d):
    u = op.uncertain_region(rasters(spark, d).select("vec_id", "w", op.graded_uncertainty(F.col("px")).alias("u")), limit=0.6)
    return rounded(op.frame_uncertainty(u, region="region", limit=0.6), "region", "risk").select("vec_id", "region", "risk")


@query("ra5_boundary_terms", f"""with recursive m as (select vec_id, mb, s, i, (i - 1) // 8 as y, (i - 1) % 8 as x from (select vec_id, mb, 0 as s, a as px from {PAIRS} union all select vec_id, mb, 1, b from {PAIRS}), range(1, 65) t(i) where px[i] >= 0.5),
 n as (select a.vec_id, a.mb, a.s, a.i, count(*) as n from m a join m b on a.vec_id = b.vec_id and a.mb = b.mb and a.s = b.s and abs(a.x - b.x) + abs(a.y - b.y) = 1 group by 1, 2, 3, 4), e as (select m.* from m left join n using (vec_id, mb, s, i) where coalesce(n, 0) < 4),
 d as (select a.vec_id, a.mb, a.s, a.i, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as d, min(greatest(abs(a.x - b.x), abs(a.y - b.y))) as g from e a join e b on a.vec_id = b.vec_id and a.mb = b.mb and a.s <> b.s group by 1, 2, 3, 4),
 h as (select vec_id, mb, max(d) as far, avg((g <= 1)::int) filter (s = 0) as p, avg((g <= 1)::int) filter (s = 1) as r from d group by 1, 2), k as (select vec_id, mb, count(distinct s) as sides from m group by 1, 2),
 j as (select a.vec_id, a.mb, a.s, a.i as a, b.i as b from m a join m b on a.vec_id = b.vec_id and a.mb = b.mb and a.s = b.s and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1), z as (select * from j union select z.vec_id, z.mb, z.s, z.a, j.b from z join j on j.vec_id = z.vec_id and j.mb = z.mb and j.s = z.s and j.a = z.b),
 c as (select vec_id, mb, count(distinct case when s = 0 then r end) as pa, count(distinct case when s = 1 then r end) as pb from (select vec_id, mb, s, a, min(b) as r from z group by 1, 2, 3, 4) group by 1, 2)
 select vec_id, mb, {R('case when sides is null then 1 when sides = 1 then 0 when p + r <= 1e-8 then 0 else 2 * p * r / (p + r) end')} as boundary_f1, {R('case when sides is null then 0 when sides = 1 then sqrt(128) else far end')} as hausdorff, {R('least(abs(coalesce(pa, 0) - coalesce(pb, 0)) / greatest(coalesce(pb, 0), 1), 1)')} as count_error
 from (select vec_id, mb from {PAIRS}) left join h using (vec_id, mb) left join k using (vec_id, mb) left join c using (vec_id, mb)""")
def ra5_boundary(spark, d):
    return rounded(op.boundary_terms(pairs(spark, d).select("vec_id", "mb", "h", "w", "a", "b")), "boundary_f1", "hausdorff", "count_error").select("vec_id", "mb", "boundary_f1", "hausdorff", "count_error")


@query("ra5_supervised_quality")
def ra5_quality(spark, d):
    q = op.supervised_quality(pairs(spark, d).select("vec_id", "mb", "h", "w", F.col("a").alias("pred"), F.col("b").alias("gt")))
    return rounded(q, "quality", "error").select("vec_id", "mb", "quality", "error")


@query("ra9_frame_features")
def ra9(spark, d):
    return op.frame_features(rasters(spark, d).withColumn("px", F.transform("px", lambda x: x * 255)), "vec_id long")


@query("ra10_pattern_vectors")
def ra10(spark, d):
    """Each embedding's map as a gray image; the vectors as one column a number."""
    v = patterns.pattern_vectors(rasters(spark, d).withColumn("px", F.transform("px", lambda x: x * 255)), "vec_id long")
    wide = [F.get(c, F.lit(i)).alias(f"{c}_{i}") for c, n in (("hardness", 11), ("pattern", 33)) for i in range(n)]
    return v.select("vec_id", *wide, "artifact", "edge", "object", "saturation_or_noise")


_TILE = "(select p_partkey, cast(p_size * 7 + 20 as bigint) as h, cast(p_size * 5 + 30 as bigint) as w from part)"
_ST = lambda dim: f"list_sort(list_distinct(list_concat(range(0, {dim} - least(64, {dim}) + 1, greatest(least(64, {dim}) - least(16, least(64, {dim}) - 1), 1)), [{dim} - least(64, {dim})])))"


@query("ra11_tile_plan", f"""select p_partkey, "top", "left", least("left" + 64, w) as "right", least("top" + 64, h) as bottom from (select *, unnest({_ST('w')}) as "left" from (select *, unnest({_ST('h')}) as "top" from {_TILE}))""")
def ra11(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 + 20).cast("long").alias("h"), (F.col("p_size") * 5 + 30).cast("long").alias("w"))
    return op.tile_plan(p, 64, 64, 16).select("p_partkey", "top", "left", "right", "bottom")


@query("ra12_subgrid", f"""select vec_id, (i - 1) // 8 // 4 as sub_row, (i - 1) % 8 // 4 as sub_col, {R('avg(px[i])')} as value, {R('1 - least(1, 1.75 * stddev_pop(px[i]))')} as confidence from {RASTERS}, range(1, 65) t(i) group by 1, 2, 3""")
def ra12(spark, d):
    return rounded(op.subgrid(rasters(spark, d), 2, 2, ["vec_id"]), "value", "confidence")


@query("ra13_cut_and_stitch", f"select vec_id, {R('list_sum(px)')} as mass, len(px) as n from {RASTERS}")
def ra13(spark, d):
    p = op.cut_patches(rasters(spark, d), 5, 2, ["vec_id"])
    return rounded(op.stitch_patches(p, 5, 2, ["vec_id"]).select("vec_id", op.total(F.col("px")).alias("mass"), F.size("px").cast("long").alias("n")), "mass")


@query("ra14_score_patches", f"select vec_id, {R('64 - list_sum(px)')} as mass from {RASTERS}")
def ra14(spark, d):
    p = op.cut_patches(rasters(spark, d), 5, 2, ["vec_id"])
    scored = op.score_patches(p, lambda x: 1 - x, 5, "vec_id long", flip=True)
    return rounded(op.stitch_patches(scored, 5, 2, ["vec_id"]).select("vec_id", op.total(F.col("px")).alias("mass")), "mass")


@query("ra15_apply_steps", f"select vec_id, list_sum(list_transform(px, lambda p: case when 1 - p >= 0.6 then 1.0 else 0.0 end)) as mass from {RASTERS}")
def ra15(spark, d):
    out = op.apply_steps(rasters(spark, d), [{"name": "invert"}, {"name": "otsu", "skip": True}, {"name": "threshold", "t": 0.6}], "vec_id long")
    return out.select("vec_id", op.total(F.col("px")).alias("mass"))


@query("ra16_label_components", f"""with recursive c as (select vec_id, i - 1 as i from {RASTERS}, range(1, 65) t(i) where px[i] >= 0.6), e as (select a.vec_id, a.i as a, b.i as b from c a join c b on a.vec_id = b.vec_id and abs(a.i % 8 - b.i % 8) <= 1 and abs(a.i // 8 - b.i // 8) <= 1),
 r as (select vec_id, a, b from e union select r.vec_id, r.a, e.b from r join e on e.vec_id = r.vec_id and e.a = r.b), l as (select vec_id, a, min(b) as root from r group by 1, 2)
 select vec_id, cast(row_number() over (partition by vec_id order by root) as bigint) as component, count(*) as area, min(a % 8) as "left", max(a // 8) as bottom from l group by vec_id, root""")
def ra16(spark, d):
    return op.label_components(rasters(spark, d), "vec_id long", 0.6).select("vec_id", "component", "area", "left", "bottom")


_OBJ = f"(select vec_id, px[i] as p, (i - 1) // 16 as label, i - 1 as i from {RASTERS}, range(1, 65) t(i) where (i - 1) // 16 > 0)"


@query("ra17_object_confidence", f"""select vec_id, label, count(*) as area, {R('avg(2 * abs(p - 0.5))')} as mean_confidence, {R('median(2 * abs(p - 0.5))')} as median, {R('quantile_cont(2 * abs(p - 0.5), 0.25)')} as p25, {R('avg(case when abs(p - 0.5) < 0.1 then 1.0 else 0.0 end)')} as uncertain_share, {R('avg(i % 8)')} as cx from {_OBJ} group by 1, 2""")
def ra17(spark, d):
    r = rasters(spark, d).withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(i / 16)))
    return rounded(op.object_confidence(r, ["vec_id"]), "mean_confidence", "median", "p25", "uncertain_share", "cx").select("vec_id", "label", "area", "mean_confidence", "median", "p25", "uncertain_share", "cx")


@query("ra18_point_confidence", f"""select l_orderkey, l_linenumber, l_quantity, l_extendedprice, {R('case when x < 8 and y < 8 then px[cast(y * 8 + x + 1 as int)] else 0.0 end')} as probability from (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_orderkey % 500 as vec_id, l_quantity % 10 as x, l_linenumber as y from lineitem) p join {RASTERS} r on p.vec_id = r.vec_id""")
def ra18(spark, d):
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_orderkey") % 500).alias("vec_id"), (F.col("l_quantity") % 10).alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    return rounded(op.point_confidence(p, rasters(spark, d), ["vec_id"]), "probability").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "probability")
