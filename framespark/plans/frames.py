"""Queries of frame keys, ranges, layouts and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.operators import frames as op
from framespark.plans.tables import FILES_SQL, files, table

Q, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("fr1_frame_number", f"""select path, cast(regexp_extract(name, '_([0-9]+)[.]', 1) as bigint) as strict_no,
  case when frame % 2 = 0 then 0 else frame end as matrix_no from {FILES_SQL}""")
def fr1(spark, d):
    f = files(spark, d)
    odd = F.when(F.col("frame") % 2 == 0, F.concat(F.lit("x_"), F.col("frame").cast("string"), F.lit("b.png"))).otherwise(F.col("name"))
    return f.select("path", op.frame_number(F.col("name")).alias("strict_no"), op.frame_number(odd, "matrix").alias("matrix_no"))


@query("fr2_natural_key", f"""select path, lower(folder) || '/frame_' || lpad(cast(frame as varchar), 20, '0') || ext as natural_key from {FILES_SQL}""")
def fr2(spark, d):
    return files(spark, d).select("path", op.natural_key(F.col("path")).alias("natural_key"))


@query("fr3_frame_identity", f"""select path, folder as sequence_id, name as display_name, folder as sequence_group from {FILES_SQL}""")
def fr3(spark, d):
    return op.frame_identity(files(spark, d).select("path"))


@query("fr4_parse_frame_ranges", """select s_suppkey, x.pos as pos, x.s as "start", x.e as "end" from (
  select s_suppkey, unnest([{'pos':0,'s':s_suppkey,'e':s_suppkey+3},{'pos':1,'s':s_suppkey+8,'e':s_suppkey+10},{'pos':2,'s':s_suppkey+20,'e':s_suppkey+20}]) as x from supplier)""")
def fr4(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.format_string("%d-%d;%d:%d, %d", k, k + 3, k + 10, k + 8, k + 20).alias("expr"))
    return op.parse_frame_ranges(s).drop("expr")


RANGES = "(select n_nationkey * 400 + 7 as s, n_nationkey * 400 + 7 + 105 + n_nationkey as e from nation)"


def _ranges(spark, d):
    k = F.col("n_nationkey").cast("long") * 400 + 7
    return table(spark, d, "nation").select(k.alias("start"), (k + 105 + F.col("n_nationkey")).alias("end"))


@query("fr5_select_frames", f"select f.frame from {FILES_SQL} f where exists (select 1 from {RANGES} r where f.frame between r.s and r.e)")
def fr5(spark, d):
    return op.select_frames(files(spark, d).select("frame"), _ranges(spark, d))


@query("fr5_select_rectangle", f"""select f.frame from {FILES_SQL} f where exists (select 1 from {RANGES} r where
  (f.frame - 1) % 50 between least((r.s - 1) % 50, (r.e - 1) % 50) and greatest((r.s - 1) % 50, (r.e - 1) % 50)
  and (f.frame - 1) // 50 between (r.s - 1) // 50 and (r.e - 1) // 50)""")
def fr5b(spark, d):
    return op.select_frames(files(spark, d).select("frame"), _ranges(spark, d), "rectangle", 50)


@query("fr6_matrix_layout", f"""select frame, idx, idx // 40 as "row", idx % 40 as col from (
  select frame, row_number() over (order by frame, path) - 1 as idx from {FILES_SQL})""")
def fr6(spark, d):
    return op.matrix_layout(files(spark, d).select("frame", "name"), 40).select("frame", "idx", "row", "col")


_TWO = f"(select path, frame from {FILES_SQL} union all select 'z/frame_00' || frame || '.png', frame from {FILES_SQL} where frame % 4 = 0 union all select 'z/plain' || frame || '.png', null from {FILES_SQL} where frame % 9 = 0)"


def _doubled(spark, d):
    f = files(spark, d)
    k = F.col("frame").cast("string")
    return f.select("path").union(f.where("frame % 4 = 0").select(F.concat(F.lit("z/frame_00"), k, F.lit(".png")))).union(f.where("frame % 9 = 0").select(F.concat(F.lit("z/plain"), k, F.lit(".png"))))


@query("fr7_base_frames", f"""select path, frame, 'kept' as status from (select *, row_number() over (partition by frame order by lower(regexp_extract(path, '([^/]+)[.][a-z]+$', 1)), lower(path)) as n from {_TWO} where frame is not null) where n = 1
  union all select path, frame, 'duplicate' from (select *, row_number() over (partition by frame order by lower(regexp_extract(path, '([^/]+)[.][a-z]+$', 1)), lower(path)) as n from {_TWO} where frame is not null) where n > 1
  union all select path, frame, 'no number' from {_TWO} where frame is null""")
def fr7(spark, d):
    kept, warn = op.base_frames(_doubled(spark, d))
    return kept.select("path", "frame", F.lit("kept").alias("status")).union(warn.select("path", op.frame_number(F.col("path")), "reason"))


@query("fr7_layer_frames", f"""select path, frame from (select *, row_number() over (partition by frame order by lower(path)) as n from {_TWO} where frame % 3 = 0) where n = 1""")
def fr7b(spark, d):
    return op.layer_frames(_doubled(spark, d), files(spark, d).where("frame % 3 = 0").select("frame"))[0].select("path", "frame")


@query("jn1_resolve_assets", f"""select key, case when frame % 5 = 0 then path when frame % 5 = 4 then null else path end as path from (
  select frame, path, case frame % 5 when 0 then path when 1 then 'other/' || upper(name) when 2 then 'q/' || replace(name, ext, '.tif') when 3 then name else 'q/none_' || frame || '.png' end as key from {FILES_SQL})""")
def jn1(spark, d):
    f = files(spark, d)
    k = F.col("frame") % 5
    key = F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("other/"), F.upper("name"))).when(k == 2, F.concat(F.lit("q/"), F.replace("name", "ext", F.lit(".tif")))).when(k == 3, F.col("name"))
    key = key.otherwise(F.concat(F.lit("q/none_"), F.col("frame").cast("string"), F.lit(".png")))
    return op.resolve_assets(f.select(key.alias("key")), f.select("path"))


@query("jn2_assemble_frames", """select l_orderkey as frame_key, count(distinct l_returnflag) as n_masks from lineitem group by 1 having count(distinct l_returnflag) = 3""")
def jn2(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_key"), F.lit("mask").alias("role"), F.col("l_returnflag").alias("model_id"), F.format_string("%d/%d", "l_orderkey", "l_linenumber").alias("path"))
    return op.assemble_frames(li, "A", ["A", "N", "R"]).select("frame_key", F.size("masks").cast("long").alias("n_masks"))


_SIDES = ("select o_orderkey as key from orders where o_orderkey % 3 <> 0 union all select o_orderkey from orders where o_orderkey % 20 = 1", "select o_orderkey as key from orders where o_orderkey % 4 <> 0")


@query("jn3_pair_report", f"""select coalesce(a.key, b.key) as key, coalesce(n_left, 0) as n_left, coalesce(n_right, 0) as n_right,
  case when n_left > 1 or n_right > 1 then 'duplicate' when n_right is null then 'left_only' when n_left is null then 'right_only' else 'matched' end as status
  from (select key, count(*) n_left from ({_SIDES[0]}) group by 1) a full join (select key, count(*) n_right from ({_SIDES[1]}) group by 1) b on a.key = b.key""")
def jn3(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return op.pair_report(k.where("key % 3 <> 0").union(k.where("key % 20 = 1")), k.where("key % 4 <> 0"))


@query("jn4_transfer_plan", f"""select folder, ext, frame, substr(ext, 2) || '_' || folder || '/' || name as destination, 'copy' as status from {FILES_SQL} where frame % 7 = 0
  union all select g.folder, g.ext, f.frame, null, 'missing' from (select distinct folder, ext from {FILES_SQL} where frame % 7 = 0) g, (select frame from {FILES_SQL} where frame % 7 = 0) f
  where not exists (select 1 from {FILES_SQL} x where x.folder = g.folder and x.ext = g.ext and x.frame = f.frame)""")
def jn4(spark, d):
    f = files(spark, d)
    ops, missing, _ = op.transfer_plan(f.drop("frame", "path"), f.where("frame % 7 = 0").select("frame"))
    return ops.select("folder", "ext", "frame", "destination", F.lit("copy").alias("status")).union(missing.select("folder", "ext", "frame", F.lit(None), F.lit("missing")))


@query("jn5_sample_copy_plan", f"""select frame, pos, case when frame % 2 = 1 then null else name end as name from (select frame, frame // 11 as pos, name from {FILES_SQL} where frame % 11 = 0)""")
def jn5(spark, d):
    f = files(spark, d)
    copies, missing = op.sample_copy_plan(f.where("frame % 11 = 0").select("frame", F.expr("frame div 11").alias("pos")), f.where("frame % 2 = 0").select("name"))
    return copies.select("frame", "pos", "name").union(missing.select("frame", F.expr("frame div 11"), F.lit(None)))


@query("jn6_model_pairs", """select a.l_orderkey as frame_key, a.l_linenumber as model_a, b.l_linenumber as model_b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
  and (a.l_linenumber, a.l_partkey, a.l_extendedprice) < (b.l_linenumber, b.l_partkey, b.l_extendedprice)""")
def jn6(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_key"), F.col("l_linenumber").alias("model_id"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("ord"))
    return op.model_pairs(li)


@query("jn11_author_quality", """select o_orderpriority as author, count(*) filter (where o_orderkey % 5 = 0) as n_checked,
  cast(count(*) filter (where o_orderkey % 5 = 0 and o_orderkey % 2 = 0 and o_orderstatus = 'F') as bigint) as n_wrong,
  case when count(*) filter (where o_orderkey % 5 = 0) > 0 then floor(count(*) filter (where o_orderkey % 5 = 0 and o_orderkey % 2 = 0 and o_orderstatus = 'F') * 10000 / count(*) filter (where o_orderkey % 5 = 0) + 0.5) / 100 else 0.0 end as wrong_percent
  from orders group by 1""")
def jn11(spark, d):
    o = table(spark, d, "orders")
    checks = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") + 1000).alias("vector_no"))
    verdicts = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 1000).alias("number"), (F.col("o_orderstatus") != "F").alias("is_correct"))
    return op.author_quality(checks, o.select(F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("frame")), verdicts)
