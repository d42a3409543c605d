"""Queries of points, boxes and polygons built from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.common import laid_by, r6
from framespark.operators import polygons as op
from framespark.operators.graph import connected_components
from framespark.plans.tables import table

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

# points: about ten line items of a supplier and flag; ids from order and line (unique enough to be grouped first)
POINTS = "(select frame_key, side, id, min(x) as x, min(y) as y from (select l_suppkey as frame_key, l_returnflag as side, l_orderkey * 100 + l_linenumber as id, l_quantity * 4 as x, l_partkey % 200 as y from lineitem) group by 1, 2, 3)"
BOXES = "(select frame_key, id, min(x) as x, min(y) as y, min(w) as w, min(h) as h, max(score) as score from (select l_suppkey as frame_key, l_orderkey * 100 + l_linenumber as id, cast(l_partkey % 300 as double) as x, cast(l_orderkey % 311 as double) as y, l_quantity / 4 + 1 as w, l_discount * 100 + 1 as h, l_tax as score from lineitem) group by 1, 2)"


def points(spark, d):
    c = F.col
    p = table(spark, d, "lineitem").select(c("l_suppkey").alias("frame_key"), c("l_returnflag").alias("side"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("id"), (c("l_quantity") * 4).alias("x"), (c("l_partkey") % 200).cast("double").alias("y"))
    return laid_by(p, "frame_key").groupBy("frame_key", "side", "id").agg(F.min("x").alias("x"), F.min("y").alias("y"))


def boxes(spark, d):
    c = F.col
    p = table(spark, d, "lineitem").select(
        c("l_suppkey").alias("frame_key"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("id"), (c("l_partkey") % 300).cast("double").alias("x"), (c("l_orderkey") % 311).cast("double").alias("y"),
        (c("l_quantity") / 4 + 1).alias("w"), (c("l_discount") * 100 + 1).alias("h"), c("l_tax").alias("score"),
    )
    return laid_by(p, "frame_key").groupBy("frame_key", "id").agg(*[F.min(k).alias(k) for k in ("x", "y", "w", "h")], F.max("score").alias("score"))


def sides(spark, d):
    p = points(spark, d)
    return p.where("side = 'A'").drop("side"), p.where("side = 'R'").drop("side")


_A, _B = f"(select * from {POINTS} where side = 'A')", f"(select * from {POINTS} where side = 'R')"
_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query("jn7_point_candidates", f"select a.frame_key, a.id as ia, b.id as ib, {R(_D)} as distance from {_A} a join {_B} b on a.frame_key = b.frame_key where {_D} <= 6")
def jn7(spark, d):
    return rounded(op.point_candidates(*sides(spark, d), 6.0, ["frame_key"]), "distance")


@query("jn7_match_points")
def jn7b(spark, d):
    return rounded(op.match_points(*sides(spark, d), 6.0, ["frame_key"]), "distance")


@query("jn8_nearest_distance", f"""with p as (select a.frame_key, a.id as ia, b.id as ib, {_D} as d from {_A} a join {_B} b on a.frame_key = b.frame_key), m as (select frame_key, avg(m) as u, max(m) as v from (select frame_key, ia, min(d) as m from p group by 1, 2) group by 1),
 n as (select frame_key, avg(m) as u, max(m) as v from (select frame_key, ib, min(d) as m from p group by 1, 2) group by 1) select m.frame_key, {R('(m.u + n.u) / 2')} as chamfer, {R('greatest(m.v, n.v)')} as hausdorff from m join n on m.frame_key = n.frame_key""")
def jn8(spark, d):
    return rounded(op.nearest_distance(*sides(spark, d), ["frame_key"]), "chamfer", "hausdorff")


#: Strips of a frame, each two pixels high and as wide as the frame; many have points of one side or none.
STRIPS, WIDTH = 100, 200
_PS = "(select *, cast(floor(y / 2) as bigint) as strip from " + POINTS + ")"


@query("jn8_frame_distance", f"""with s as {_PS}, a as (select * from s where side = 'A'), b as (select * from s where side = 'R'), f as (select s_suppkey as frame_key, unnest(range({STRIPS})) as strip from supplier), p as (select a.frame_key, a.strip, a.id as ia, b.id as ib, {_D} as d from a join b on a.frame_key = b.frame_key and a.strip = b.strip),
 m as (select frame_key, strip, avg(m) as u, max(m) as v from (select frame_key, strip, ia, min(d) as m from p group by 1, 2, 3) group by 1, 2), n as (select frame_key, strip, avg(m) as u, max(m) as v from (select frame_key, strip, ib, min(d) as m from p group by 1, 2, 3) group by 1, 2),
 g as (select f.*, case when exists (select 1 from a where a.frame_key = f.frame_key and a.strip = f.strip) or exists (select 1 from b where b.frame_key = f.frame_key and b.strip = f.strip) then sqrt({WIDTH}.0 * {WIDTH} + 4) else 0.0 end as far from f)
 select g.frame_key, g.strip, {R('coalesce((m.u + n.u) / 2, far)')} as chamfer, {R('coalesce(greatest(m.v, n.v), far)')} as hausdorff from g left join m on m.frame_key = g.frame_key and m.strip = g.strip left join n on n.frame_key = g.frame_key and n.strip = g.strip""")
def jn8_frames(spark, d):
    a, b = (p.withColumn("strip", F.floor(F.col("y") / 2)) for p in sides(spark, d))
    frames = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STRIPS - 1).cast("long"))).alias("strip"), F.lit(WIDTH).alias("w"), F.lit(2).alias("h"))
    return rounded(op.frame_distance(a, b, frames, ["frame_key", "strip"]), "chamfer", "hausdorff")


_DX = "(greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w))"
_DY = "(greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h))"
_GAP = f"sqrt(pow(greatest({_DX}, 0), 2) + pow(greatest({_DY}, 0), 2))"
_OV = f"(greatest(-{_DX}, 0) * greatest(-{_DY}, 0))"


@query("jn9_bbox_neighbors", f"select a.frame_key, a.id as a, b.id as b, {R(_GAP)} as gap, {R(_OV)} as overlap from {BOXES} a join {BOXES} b on a.frame_key = b.frame_key and a.id < b.id where {_GAP} <= 5")
def jn9(spark, d):
    return rounded(op.bbox_neighbors(boxes(spark, d), 5.0, ["frame_key"]), "gap", "overlap").drop("iou")


def polygons(spark, d):
    """Rings from boxes: every seventh a triangle, every fifth a hole whose parent is the box id before it."""
    b = boxes(spark, d)
    x, y, w, h = (F.col(k) for k in "xywh")
    p = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
    ring = F.when(F.col("id") % 7 == 0, F.array(p(x, y), p(x + w, y), p(x, y + h))).otherwise(F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)))
    out = b.select("frame_key", "id", ring.alias("points"), (F.col("id") % 5 == 0).alias("is_hole"), F.when(F.col("id") % 5 == 0, F.col("id") - 1).alias("parent_id"), F.when(F.col("id") % 3 == 0, "via").otherwise("conductor").alias("category"), (F.col("id") % 11 == 0).alias("manual"), F.lit("none").alias("shape_hint"))
    return out.withColumn("_m", op.polygon_metrics(F.col("points"))).select("*", "_m.*").drop("_m")


_AREA = "(case when id % 7 = 0 then w * h / 2 else w * h end)"
_PER = "(case when id % 7 = 0 then w + h + sqrt(w * w + h * h) else 2 * w + 2 * h end)"
POLY = f"(select *, {_AREA} as area, {_PER} as perimeter, id % 5 = 0 as is_hole, case when id % 5 = 0 then id - 1 end as parent_id, id % 3 = 0 as via, cast(ceil(x + w) - floor(x) + 1 as int) as bw, cast(ceil(y + h) - floor(y) + 1 as int) as bh from {BOXES})"


@query("jn10_containing_polygon", f"""with p as (select *, floor(x) + bw / 2 as cx, floor(y) + bh / 2 as cy from {POLY}) select a.frame_key, a.id, arg_min(b.id, b.area * 1e9 + b.id / 1e3) as container from p a join p b on a.frame_key = b.frame_key and a.id <> b.id
 where a.cx >= b.x and a.cx <= b.x + b.w and a.cy >= b.y and a.cy <= b.y + b.h and (b.id % 7 <> 0 or (a.cx - b.x) / b.w + (a.cy - b.y) / b.h <= 1) group by 1, 2""")
def jn10(spark, d):
    return op.containing_polygon(polygons(spark, d), ["frame_key"])


_CENTRED = "a.x + a.w / 2 >= b.x + 3 and a.x + a.w / 2 <= b.x + 3 + b.w and a.y + a.h / 2 >= b.y + 3 and a.y + a.h / 2 <= b.y + 3 + b.h"


@query("jn10_transfer_metadata", f"""with p as (select *, id % 5 = 0 as is_hole from {BOXES}), m as (select a.frame_key, a.id, arg_min(b.id, (b.w * b.h, b.id)) as c from p a join p b on a.frame_key = b.frame_key and a.is_hole = b.is_hole and {_CENTRED} group by 1, 2)
 select p.frame_key, p.id, case when c is null then 'own' when c % 3 = 0 then 'via' else 'conductor' end as category, coalesce('h' || c % 10, 'none') as shape_hint from p left join m using (frame_key, id)""")
def jn10_metadata(spark, d):
    """Rectangles take over category and hint from a layer whose rectangles lie three pixels off."""

    def layer(off):
        b = boxes(spark, d).withColumns({"x": F.col("x") + off, "y": F.col("y") + off, "area": F.col("w") * F.col("h")})
        x, y, w, h = (F.col(k) for k in "xywh")
        p = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
        ring = F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))
        return b.select("frame_key", "id", "area", ring.alias("points"), (F.col("id") % 5 == 0).alias("is_hole")).withColumn("bbox", op.polygon_metrics(F.col("points"))["bbox"])

    given = layer(3).withColumns({"category": F.when(F.col("id") % 3 == 0, "via").otherwise("conductor"), "shape_hint": F.concat(F.lit("h"), (F.col("id") % 10).cast("string"))})
    out = op.transfer_metadata(layer(0).withColumns({"category": F.lit("own"), "shape_hint": F.lit("none")}), given, ["frame_key"], ("category", "shape_hint"))
    return out.select("frame_key", "id", "category", "shape_hint")


@query("pg1_polygon_metrics", f"select frame_key, id, {R('area')} as area, {R('perimeter')} as perimeter, bw, bh from {POLY}")
def pg1(spark, d):
    return rounded(polygons(spark, d), "area", "perimeter").select("frame_key", "id", "area", "perimeter", F.col("bbox.w").alias("bw"), F.col("bbox.h").alias("bh"))


@query("pg2_polygon_filter", f"""select p.frame_key, p.id, case when not p.is_hole and p.area < 8 then 'area' when p.perimeter < 8 then 'perimeter' when p.bw < 4 then 'bbox_width' when p.via and (abs(p.bw - 8) > 2 or abs(p.bh - 8) > 2 or greatest(p.bw, p.bh) / least(p.bw, p.bh) > 1.15) then 'via_size'
 when greatest(p.bw, p.bh) / least(p.bw, p.bh) > 4 then 'aspect' when floor(p.x) <= 0 or floor(p.y) <= 0 or floor(p.x) + p.bw >= 310 or floor(p.y) + p.bh >= 330 then 'border' when p.is_hole and p.area < 12 then 'small_hole' when p.is_hole and p.area > 0.8 * q.area then 'hole_ratio' end as reject_reason
 from {POLY} p left join {POLY} q on p.frame_key = q.frame_key and p.parent_id = q.id""")
def pg2(spark, d):
    p = polygons(spark, d).withColumns({"h": F.lit(330), "w": F.lit(310)})
    limits = {"min_area": 8, "min_perimeter": 8, "min_width": 4, "via_size": 8, "max_aspect": 4, "border": 1, "min_hole_area": 12, "max_hole_ratio": 0.8}
    return op.polygon_filter(p, limits).select("frame_key", "id", "reject_reason")


#: L-shapes: the lower half of each box and its left half; parents are the box before, three generations deep.
_HALVES = f"(select frame_key, id, x, y, w, h / 2 as h from {BOXES} union all select frame_key, id, x, y, w / 2, h from {BOXES})"


def ells(spark, d):
    b = boxes(spark, d)
    x, y, w, h = (F.col(k) for k in "xywh")
    p = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
    ring = F.array(p(x, y), p(x + w, y), p(x + w, y + h / 2), p(x + w / 2, y + h / 2), p(x + w / 2, y + h), p(x, y + h))
    out = b.select("frame_key", "id", ring.alias("points"), F.when(F.col("id") % 4 != 0, F.col("id") - 1).alias("parent_id"), (F.col("id") % 3 == 0).alias("is_hole"), F.lit("conductor").alias("category"), F.lit(310).alias("w"), F.lit(330).alias("h"))
    return out.withColumn("_m", op.polygon_metrics(F.col("points"))).select("*", "_m.*").drop("_m")


@query("pg2_hierarchy_depth", f"select frame_key, id, id % 4 as depth from {BOXES} where id % 4 = 0 union all select a.frame_key, a.id, case when a.id % 4 = 1 or b.id is null then 1 when a.id % 4 = 2 or c.id is null then 2 else 3 end from {BOXES} a left join {BOXES} b on b.frame_key = a.frame_key and b.id = a.id - 1 left join {BOXES} c on b.id is not null and c.frame_key = a.frame_key and c.id = a.id - 2 where a.id % 4 <> 0")
def pg2_depth(spark, d):
    return op.hierarchy_depth(ells(spark, d), ["frame_key"])


@query("pg2_solidity", f"""with p as (select a.frame_key, a.id, case when a.id % 4 = 0 then 0 when a.id % 4 = 1 or b.id is null then 1 when a.id % 4 = 2 or c.id is null then 2 else 3 end as depth, a.w, a.h from {BOXES} a left join {BOXES} b on b.frame_key = a.frame_key and b.id = a.id - 1 left join {BOXES} c on b.id is not null and c.frame_key = a.frame_key and c.id = a.id - 2)
 select frame_key, id, case when depth > 2 then 'max_hierarchy_depth' when id % 3 = 0 and 0.75 * w * h < 20 then 'small_hole' end as reject_reason from p""")
def pg2_solidity(spark, d):
    p = ells(spark, d).join(op.hierarchy_depth(ells(spark, d), ["frame_key"]), ["frame_key", "id"])
    # an L fills 3/4 of its box and 6/7 of its hull
    return op.polygon_filter(p, {"max_depth": 2, "min_solidity": 0.857, "min_hole_area": 20}).select("frame_key", "id", "reject_reason")


@query("pg7_merge_polygons", f"""with recursive h as {_HALVES}, p as (select distinct a.frame_key, a.id as a, b.id as b from h a join h b on a.frame_key = b.frame_key and a.id <> b.id where a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h),
 r as (select frame_key, id as a, id as b from {BOXES} union select r.frame_key, r.a, p.b from r join p on p.frame_key = r.frame_key and p.a = r.b), g as (select frame_key, a as id, min(b) as group_id from r group by 1, 2)
 select frame_key, group_id, count(*) as members, {R('sum(0.75 * w * h)')} as area, min(floor(x))::int as x, min(floor(y))::int as y, (max(ceil(x + w) + 1) - min(floor(x)))::int as w, (max(ceil(y + h) + 1) - min(floor(y)))::int as h from g join {BOXES} using (frame_key, id) group by 1, 2""")
def pg7_polygons(spark, d):
    return rounded(op.merge_polygons(ells(spark, d), ["frame_key"]), "area")


@query("pg3_via_candidate_filter", f"""select frame_key, id, case when least(w, h) < 2 or greatest(w, h) > 12 then 'size' when greatest(w, h) / least(w, h) > 3 then 'aspect' when score * 10 < 0.1 then 'roundness' when w / 13 < 0.2 then 'contrast' when h / 11 < 0.3 then 'edge_coverage' when score < 0.04 then 'score' end as reject_reason from {BOXES}""")
def pg3(spark, d):
    b = boxes(spark, d).withColumns({"roundness": F.col("score") * 10, "contrast": F.col("w") / 13, "edge_coverage": F.col("h") / 11})
    return op.via_candidate_filter(b, {"min_size": 2, "max_size": 12, "max_aspect": 3, "min_roundness": 0.1, "min_contrast": 0.2, "min_edge_coverage": 0.3, "min_score": 0.04}).select("frame_key", "id", "reject_reason")


@query("pg4_clean_polygons", f"""with a as (select * from {POLY} where not is_hole or area >= 20), s as (select frame_key, id from a where not is_hole and not via and area < 15),
 b as (select * from a where not exists (select 1 from s where s.frame_key = a.frame_key and s.id = a.id) and not exists (select 1 from s where s.frame_key = a.frame_key and s.id = a.parent_id)),
 c as (select * from b where is_hole or not (id % 7 = 0 and not via and id % 11 <> 0 and area < 40)) select frame_key, id from c where not is_hole or exists (select 1 from c p where p.frame_key = c.frame_key and p.id = c.parent_id and not p.is_hole)""")
def pg4(spark, d):
    return op.clean_polygons(polygons(spark, d), 15.0, 20.0, 40.0).select("frame_key", "id")


@query("pg5_remove_spikes")
def pg5(spark, d):
    p = polygons(spark, d)
    spiked = F.concat("points", F.array(F.struct((F.get("points", F.lit(0))["x"] - 50.0).alias("x"), (F.get("points", F.lit(0))["y"] + 0.5).alias("y"))))
    return p.select("frame_key", "id", F.size(op.remove_spikes(spiked, 40.0)).alias("n_points"))


@query("pg6_is_simple_ring", f"select frame_key, id, id % 2 = 1 or id % 7 = 0 as simple from {BOXES}")
def pg6(spark, d):
    p = polygons(spark, d)
    g = lambda i: F.get("points", F.lit(i))
    bow = F.when((F.col("id") % 2 == 0) & (F.col("id") % 7 != 0), F.array(g(0), g(2), g(1), g(3))).otherwise(F.col("points"))
    return p.select("frame_key", "id", op.is_simple_ring(bow).alias("simple"))


@query("pg7_merge_overlapping", f"""with recursive p as (select a.frame_key, a.id as a, b.id as b from {BOXES} a join {BOXES} b on a.frame_key = b.frame_key and a.id <> b.id where {_OV} > 0), r as (select frame_key, id as a, id as b from {BOXES} union select r.frame_key, r.a, p.b from r join p on p.frame_key = r.frame_key and p.a = r.b)
 select frame_key, a as id, min(b) as group_id from r group by 1, 2""")
def pg7(spark, d):
    return op.merge_overlapping(boxes(spark, d), ["frame_key"])


@query("pg8_suppress_via")
def pg8(spark, d):
    return op.suppress_nms(boxes(spark, d), ["frame_key"], "via").select("frame_key", "id", "suppressed_by")


@query("pg8_suppress_iou")
def pg8b(spark, d):
    return op.suppress_nms(boxes(spark, d), ["frame_key"], "iou", 0.2).select("frame_key", "id", "suppressed_by")


@query("pg8_suppress_distance")
def pg8c(spark, d):
    return op.suppress_nms(boxes(spark, d), ["frame_key"], "distance", 4.0).select("frame_key", "id", "suppressed_by")


@query("pg8_suppress_grid")
def pg8d(spark, d):
    return op.suppress_nms(boxes(spark, d), ["frame_key"], "grid", 4.0).select("frame_key", "id", "suppressed_by")


@query("pg8_suppress_hard_rejects")
def pg8e(spark, d):
    hard = boxes(spark, d).withColumn("hard", F.col("score") < 0.01)
    return op.suppress_nms(hard, ["frame_key"], "distance", 4.0, inclusive=True, always="hard").select("frame_key", "id", "suppressed_by")


@query("pg9_polygons_changed", f"select distinct frame_key from {BOXES} where id % 997 = 0")
def pg9(spark, d):
    p = polygons(spark, d)
    moved = p.withColumn("points", F.when(F.col("id") % 997 == 0, F.transform("points", lambda q: F.struct((q["x"] + 1).alias("x"), q["y"].alias("y")))).otherwise(F.col("points")))
    return op.polygons_changed(p, moved)


@query("pg10_merge_branches", f"""select frame_key, id, 'conductor' as category from {POLY} where not via union all select v.frame_key, coalesce(t.top, 0) + row_number() over (partition by v.frame_key order by v.id), 'via' from {POLY} v left join (select frame_key, max(id) as top from {POLY} where not via group by 1) t on v.frame_key = t.frame_key where v.via""")
def pg10(spark, d):
    p = polygons(spark, d)
    return op.merge_branches(p.where("category = 'conductor'"), p.where("category = 'via'")).select("frame_key", "id", "category")


#: Lanes of a frame; the line items of a lane span one straight conductor.
LANES = 40
_TRACES = f"(select frame_key, lane, x, lane * 8 as y, x1 - x as w, 1 + lane % 5 as h from (select l_suppkey as frame_key, l_orderkey % {LANES} as lane, min(l_partkey % 300) as x, max(l_partkey % 300 + l_quantity) as x1 from lineitem group by 1, 2))"


def traces(spark, d):
    c = F.col
    t = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("frame_key"), (c("l_orderkey") % LANES).alias("id")).agg(F.min(c("l_partkey") % 300).cast("double").alias("x"), F.max(c("l_partkey") % 300 + c("l_quantity")).cast("double").alias("x1"))
    y = (c("id") * 8).cast("double")
    p = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
    y1 = y + 1 + c("id") % 5
    ring = F.array(p(c("x"), y), p(c("x1"), y), p(c("x1"), y1), p(c("x"), y1))
    return t.select("frame_key", "id", ring.alias("points"), F.lit(False).alias("is_hole")).withColumn("_m", op.polygon_metrics(c("points"))).select("*", "_m.*").drop("_m")


@query("pg10_drop_trace_vias", f"""select frame_key, id from (select *, floor(x) + bw / 2 as cx, floor(y) + bh / 2 as cy from {POLY} where via) v where not exists (select 1 from {_TRACES} t where t.frame_key = v.frame_key and cx >= t.x and cx <= t.x + t.w and cy >= t.y and cy <= t.y + t.h
 and greatest(t.w + 1, t.h + 1) > 7 * least(t.w + 1, t.h + 1) and t.w * t.h > 16 * bw * bh)""")
def pg10_vias(spark, d):
    return op.drop_trace_vias(polygons(spark, d).where("category = 'via'"), traces(spark, d), ["frame_key"]).select("frame_key", "id")


@query("pg11_polygon_frame_stats", f"""select a.frame_key, n_outer, n_hole, {R('m')} as min_area, {R('1 / (1 + 0.6 * abs(n_outer - coalesce(r_outer, 0)) + 0.8 * abs(n_hole - coalesce(r_hole, 0)))')} as topology from (select frame_key, count(*) filter (where not is_hole) as n_outer, count(*) filter (where is_hole) as n_hole, min(area) as m from {POLY} group by 1) a
 left join (select frame_key, count(*) filter (where not is_hole) as r_outer, count(*) filter (where is_hole) as r_hole from {POLY} where id % 50 <> 0 group by 1) b on a.frame_key = b.frame_key""")
def pg11(spark, d):
    p = polygons(spark, d)
    return rounded(op.polygon_frame_stats(p, p.where("id % 50 <> 0")), "min_area", "topology").drop("min_perimeter")


@query("gr1_connected_components", """with recursive e as (select l_suppkey as design, l_orderkey as a, -l_partkey as b from lineitem), u as (select design, a, b from e union select design, b, a from e), r as (select design, a, a as b from u union select r.design, r.a, u.b from r join u on u.design = r.design and u.a = r.b)
 select design, a as node, min(b) as component from r group by 1, 2""")
def gr1(spark, d):
    """Orders and parts of each supplier, joined by its line items."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("design"), F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
    return connected_components(e, ("design",))


@query("sc13_point_clusters", f"""with recursive p as (select frame_key, id, x, y from {POINTS} where side = 'N'), e as (select a.frame_key, a.id as a, b.id as b from p a join p b on a.frame_key = b.frame_key where {_D} <= 5), r as (select frame_key, a, b from e union select r.frame_key, r.a, e.b from r join e on e.frame_key = r.frame_key and e.a = r.b),
 c as (select frame_key, a, min(b) as root from r group by 1, 2) select frame_key, max(n) as largest, sum(n)::bigint as support from (select frame_key, root, count(*) as n from c group by 1, 2) group by 1""")
def sc13(spark, d):
    """Largest cluster of uncertain points of radius 2: linked within r1 + r2 + 1."""
    p = points(spark, d).where("side = 'N'").drop("side")
    pairs = op.point_candidates(p, p, 5.0, ["frame_key"])
    comp = connected_components(pairs.select("frame_key", F.col("ia").alias("src"), F.col("ib").alias("dst")), ("frame_key",))
    sizes = comp.groupBy("frame_key", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("frame_key").agg(F.max("n").alias("largest"), F.sum("n").alias("support"))
