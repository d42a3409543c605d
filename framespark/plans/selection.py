"""Queries of selection, sampling, splits and patch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.common import r6, stem, total
from framespark.operators import selection as op
from framespark.plans.rasters import RASTERS, rasters
from framespark.plans.tables import FILES_SQL, files, table

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
CLIP = lambda e: f"least(greatest({e}, 0), 1)"

# features of line items, in [0, 1]
_FEAT = """(select l_orderkey, l_linenumber, l_partkey, l_quantity as h, l_quantity + 3 as w, l_discount as contrast, l_tax * 2 as "range", l_tax * 10 as edges, l_discount * 8 as entropy, l_tax as sharpness, l_discount as noise, l_tax * 6 as saturation, l_quantity / 50 as brightness from lineitem)"""


def features(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c("l_quantity").alias("h"), (c("l_quantity") + 3).alias("w"), c("l_discount").alias("contrast"), (c("l_tax") * 2).alias("range"), (c("l_tax") * 10).alias("edges"), (c("l_discount") * 8).alias("entropy"), c("l_tax").alias("sharpness"), c("l_discount").alias("noise"), (c("l_tax") * 6).alias("saturation"), (c("l_quantity") / 50).alias("brightness"))


KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
_K = ", ".join(KEYS)


@query("se1_quality_gate", f"""select {_K}, {R('0.2 * contrast + 0.2 * edges + 0.15 * entropy + 0.15 * "range" + 0.15 * sharpness + 0.15 * (1 - saturation)')} as quality from {_FEAT} where h >= 24 and w >= 24 and contrast >= 0.01 and "range" >= 0.05""")
def se1(spark, d):
    return rounded(op.quality_gate_frames(features(spark, d)), "quality").select(*KEYS, "quality")


@query("se2_anomaly_score", f"""select {_K}, {R(f"0.3 * {CLIP('(0.1 - sharpness) / 0.1')} + 0.2 * {CLIP('(0.08 - contrast) / 0.08')} + 0.15 * {CLIP('(noise - 0.04) / 0.12')} + 0.15 * {CLIP('(saturation - 0.1) / 0.4')} + 0.08 * {CLIP('(0.35 - entropy) / 0.35')} + 0.07 * {CLIP('(abs(brightness - 0.5) - 0.25) / 0.25')} + 0.05 * " + CLIP('(0.25 - "range") / 0.25'))} as anomaly from {_FEAT}""")
def se2(spark, d):
    return rounded(op.anomaly_score(features(spark, d)), "anomaly").select(*KEYS, "anomaly")


@query("se3_fingerprint", f"""select vec_id, list_aggregate(list_transform(range(0, 256), lambda i: case when px[cast((i // 16 // 2) * 8 + (i % 16) // 2 + 1 as int)] >= list_sum(px) / 64 then '1' else '0' end), 'string_agg', '') as fingerprint from {RASTERS}""")
def se3(spark, d):
    r = rasters(spark, d)
    return r.select("vec_id", op.fingerprint(F.col("px"), F.col("h"), F.col("w")).alias("fingerprint"))


@query("se3_dedupe_fingerprint", "select doc_id, n_chars as quality from (select *, row_number() over (partition by md5(text) order by n_chars desc, doc_id) as n from documents) where n = 1")
def se3b(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("quality"), F.col("doc_id").alias("path"), F.md5("text").alias("fingerprint"))
    return op.dedupe_fingerprint(t).select("doc_id", "quality")


_VEC = "(select vec_id as id, list_transform(embedding[1:4], lambda x: x::double) as f, label as cluster, md5(vec_id::varchar) as bits from embeddings)"
_DIST = "sqrt(list_sum(list_transform(range(1, 5), lambda i: (a.f[i] - b.f[i]) * (a.f[i] - b.f[i]))))"
_SAME = "(list_sum(list_transform(range(1, 33), lambda i: case when a.bits[i:i] = b.bits[i:i] then 1 else 0 end)) / 32)"


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("features"), F.col("label").alias("cluster"), F.md5(F.col("vec_id").cast("string")).alias("bits"))


@query("se4_near_duplicates", f"select a.id as a, b.id as b, {R(_DIST)} as distance from {_VEC} a join {_VEC} b on a.cluster = b.cluster and a.id < b.id where {_DIST} <= 0.1 or ({_SAME} >= 0.1 and {_DIST} <= 0.18)")
def se4(spark, d):
    return rounded(op.near_duplicates(vectors(spark, d), 0.1, 0.1), "distance").drop("similarity")


_BITS = f"(select id, cluster, f, list_aggregate(list_transform(range(1, 65), lambda i: case when e[i] >= 0 then '1' else '0' end), 'string_agg', '') as bits from (select vec_id as id, label as cluster, list_transform(embedding[1:4], lambda x: x::double) as f, embedding as e from embeddings))"


@query("se4_near_fingerprints", f"""select a.id as a, b.id as b, {R(_DIST)} as distance, (64 - bit_count(xor(a.bits::bit, b.bits::bit))) / 64 as similarity from {_BITS} a join {_BITS} b on a.cluster = b.cluster and a.id < b.id
 where {_DIST} <= 0.1 or (64 - bit_count(xor(a.bits::bit, b.bits::bit)) >= 0.8 * 64 and {_DIST} <= 0.18)""")
def se4_packed(spark, d):
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("features"), F.col("label").alias("cluster"), op.pack_bits(bits).alias("bits"))
    return rounded(op.near_duplicates(v, 0.1, 0.8, length=64), "distance")


@query("se5_minmax_features", f"""with x as (select id, i, f[i] as v from {_VEC}, range(1, 5) t(i)), b as (select i, min(v) as lo, max(v) as hi from x group by 1) select id, {R('sum((v - lo) / greatest(hi - lo, 1e-8))')} as mass from x join b on x.i = b.i group by 1""")
def se5(spark, d):
    return rounded(op.minmax_features(vectors(spark, d)).select("id", total(F.col("features")).alias("mass")), "mass")


@query("se5_normalize_scores", f"select {_K}, {R('(edges - (select min(edges) from x)) / ((select max(edges) from x) - (select min(edges) from x))')} as edges from x".replace("from x", f"from {_FEAT}"))
def se5b(spark, d):
    return rounded(op.normalize_scores(features(spark, d), ["edges"]), "edges").select(*KEYS, "edges")


@query("se6_cluster_frames")
def se6(spark, d):
    out, _ = op.cluster_frames(vectors(spark, d).select("id", "features"), 4)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_CENTRES = [[0.1, 0.1, 0.0, 0.0], [-0.1, 0.0, 0.1, 0.0], [0.0, -0.1, 0.0, 0.1]]
_CD = lambda c: "(" + " + ".join(f"(f[{i + 1}] - ({x})) * (f[{i + 1}] - ({x}))" for i, x in enumerate(c)) + ")"


@query("se6_assign_clusters", f"select id, case when {_CD(_CENTRES[0])} <= least({_CD(_CENTRES[1])}, {_CD(_CENTRES[2])}) then 0 when {_CD(_CENTRES[1])} <= {_CD(_CENTRES[2])} then 1 else 2 end as cluster from {_VEC}")
def se6b(spark, d):
    return op.assign_clusters(vectors(spark, d), _CENTRES).select("id", "cluster")


_AVG = "avg(sharpness) as sharpness, avg(contrast) as contrast, avg(noise) as noise, avg(saturation) as saturation, avg(entropy) as entropy, avg(brightness) as brightness"


@query("se7_label_clusters", f"""select l_partkey as cluster, case when sharpness < 0.05 or contrast < 0.04 then 'blur_or_low_detail' when noise > 0.12 then 'noisy_artifacts' when saturation > 0.3 or abs(brightness - 0.5) > 0.35 then 'exposure' when entropy < 0.3 then 'low_information' when contrast >= 0.12 and noise <= 0.06 then 'normal_clean' else 'mixed' end as name
 from (select l_partkey, {_AVG} from {_FEAT} group by 1)""".replace("sharpness < 0.05", "sharpness * 2 < 0.1").replace("contrast < 0.04", "contrast * 1.5 < 0.06").replace("contrast >= 0.12", "contrast * 1.5 >= 0.12"))
def se7(spark, d):
    # averages meet limits exactly, so the order of sums decides: it is that of the rows in their files, however they are split. A part has a few dozen line items
    names = ("sharpness", "contrast", "noise", "saturation", "entropy", "brightness")
    rows = features(spark, d).select(F.col("l_partkey").alias("cluster"), F.struct("_metadata.file_path", "_metadata.row_index", *names).alias("row"))
    p = rows.groupBy("cluster").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    mean = lambda n: total(F.transform("rows", lambda r: F.coalesce(r[n], F.lit(0.0)))) / F.nullif(F.size(F.filter("rows", lambda r: r[n].isNotNull())), F.lit(0))
    p = p.select("cluster", *[mean(n).alias(n) for n in names])
    return op.label_clusters(p.withColumns({"sharpness": F.col("sharpness") * 2, "contrast": F.col("contrast") * 1.5})).select("cluster", "name")


@query("se8_rarity", f"""with n as (select a.id, {_DIST} as d, row_number() over (partition by a.id order by {_DIST}) as r from {_VEC} a, {_VEC} b where a.id <> b.id), m as (select id, avg(d) as v from n where r <= 5 group by 1)
 select id, {R('(v - (select min(v) from m)) / ((select max(v) from m) - (select min(v) from m))')} as rarity from m""")
def se8(spark, d):
    return rounded(op.rarity(vectors(spark, d)), "rarity").select("id", "rarity")


_PRIO = "(select l_orderkey, l_linenumber, l_partkey, l_discount / 0.1 as anomaly, l_tax / 0.08 as rarity, (l_quantity - 1) / 49 as edges, l_discount / 0.1 as objects, l_tax / 0.08 as structure from lineitem)"


def priorities(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(*KEYS, c("l_discount").alias("anomaly"), c("l_tax").alias("rarity"), c("l_quantity").alias("edges"), (c("l_discount") * 3).alias("objects"), (c("l_tax") * 2).alias("structure"))


@query("se9_priority_scores", f"select {_K}, {R('0.3 * anomaly + 0.25 * rarity + 0.2 * edges + 0.15 * objects + 0.1 * structure')} as priority from {_PRIO}")
def se9(spark, d):
    return rounded(op.priority_scores(priorities(spark, d)), "priority").select(*KEYS, "priority")


@query("se10_explain", f"""select {_K}, case when anomaly >= 0.65 then 'anomaly' when rarity >= 0.65 then 'rarity' when edges >= 0.7 then 'edges' else 'representative' end as category, anomaly <= 0.25 and rarity <= 0.35 as normal_reference from (select {_K}, l_discount * 10 as anomaly, l_tax * 12 as rarity, l_quantity / 50 as edges from lineitem)""")
def se10(spark, d):
    c = F.col
    p = table(spark, d, "lineitem").select(*KEYS, (c("l_discount") * 10).alias("anomaly"), (c("l_tax") * 12).alias("rarity"), (c("l_quantity") / 50).alias("edges"), F.lit(0.0).alias("objects"), F.lit(0.0).alias("structure"))
    return op.explain(p).select(*KEYS, "category", "normal_reference")


_STATS = "(select l_linenumber as cluster, count(*) as n, avg(l_discount) * 10 as mean_priority, max(l_quantity) / 50 as max_priority, avg(l_tax) * 10 as structure from lineitem group by 1)"


def stats(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), (F.avg("l_discount") * 10).alias("mean_priority"), (F.max("l_quantity") / 50).alias("max_priority"), (F.avg("l_tax") * 10).alias("structure"))


@query("se11_cluster_quotas", f"""with s as (select *, 0.45 * mean_priority + 0.25 * max_priority + 0.3 * structure as hardness, n / sum(n) over () as share from {_STATS}), q as (select cluster, i, (0.65 * hardness + 0.35 * share) / pow(i + 1, 0.7) as v from s, range(0, 20) t(i)),
 r as (select *, row_number() over (order by case when i = 0 then 0 else 1 end, v desc, cluster) as r from q) select s.cluster, {R('hardness')} as hardness, count(r.r) as quota from s left join r on s.cluster = r.cluster and r.r <= 40 group by 1, 2""")
def se11(spark, d):
    return rounded(op.cluster_quotas(stats(spark, d), 40), "hardness")


@query("se12_candidate_pool", """with x as (select vec_id as id, embedding[1]::double as p, embedding[2]::double as r from embeddings) select id from (select *, row_number() over (order by p desc, id) as a, row_number() over (order by r desc, id) as b, row_number() over (order by (p + r) / 2 desc, id) as c from x) where a <= 40 or b <= 40 or c <= 40""")
def se12(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("priority"), F.get("embedding", F.lit(1)).cast("double").alias("rarity"))
    return op.candidate_pool(e, 40).select("id")


@query("se12_select_diverse")
def se12b(spark, d):
    v = vectors(spark, d).withColumns({"priority": F.get("features", F.lit(0)), "structure": F.get("features", F.lit(1))})
    quotas = v.groupBy("cluster").agg(F.lit(5).alias("quota"))
    return op.select_diverse(v.drop("bits"), quotas)


@query("se13_uniform_sample", f"""with x as (select path, row_number() over (order by path) - 1 as i, count(*) over () as n from {FILES_SQL}) select path from x where i in (select cast(round_even(k * (n - 1) / 99.0, 0) as bigint) from range(100) t(k))""")
def se13(spark, d):
    return op.uniform_sample(files(spark, d).select("path"), 100).select("path")


@query("se13_round_robin", f"select path from (select path, folder, row_number() over (partition by folder order by size desc, path) as r from {FILES_SQL}) order by r, folder limit 50")
def se13b(spark, d):
    return op.round_robin_sample(files(spark, d).select("path", F.col("folder").alias("cluster"), F.col("size").alias("quality")), 50).select("path")


@query("se13_bootstrap_sample")
def se13c(spark, d):
    v = vectors(spark, d).select(F.format_string("%06d", "id").alias("path"), "features")
    return op.bootstrap_sample(v, 20).select("path")


@query("se13_clustered_sample")
def se13d(spark, d):
    v = vectors(spark, d)
    bits = F.array(*[F.xxhash64("bits", F.lit(i)) for i in range(4)])
    v = v.select("id", F.format_string("%06d", "id").alias("path"), "cluster", F.get("features", F.lit(0)).alias("quality"), F.get("features", F.lit(1)).alias("score"), "features", bits.alias("bits"))
    return op.clustered_sample(v, 40)


@query("se14_author_sample", """select distinct frame from (select o_orderkey as frame, row_number() over (partition by o_orderpriority order by md5('7:' || o_orderpriority || ':' || o_orderkey), o_orderkey) as r, count(*) over (partition by o_orderpriority) as n from orders) where r <= ceil(n * 12.5 / 100)""")
def se14(spark, d):
    return op.author_sample(table(spark, d, "orders").select(F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("frame")), 12.5, 7)


@query("se15_stratified_split", f"""with x as (select name as stem, frame % 100 / 300 as c, sha1('42:' || frame || ':' || frame) as k, frame from {FILES_SQL}), b as (select *, cast(c > 0 as int) + cast(c > 0.001 as int) + cast(c > 0.01 as int) + cast(c > 0.05 as int) + cast(c > 0.2 as int) as bucket from x),
 n as (select bucket, count(*) as n, count(*) * 1000 / sum(count(*)) over () as e from b group by 1), f as (select *, floor(e) as f, row_number() over (order by e - floor(e) desc, bucket) as r, 1000 - sum(floor(e)) over () as l from n)
 select frame, b.bucket, case when row_number() over (partition by b.bucket order by k, frame) <= f + case when r <= l then 1 else 0 end then 'val' else 'train' end as part from b join f on b.bucket = f.bucket""")
def se15(spark, d):
    f = files(spark, d).select("frame", F.col("frame").cast("string").alias("stem"), (F.col("frame") % 100 / 300).alias("coverage"))
    return op.stratified_split(f, 1000).select("frame", "bucket", "part")


@query("se16_patch_counts", "select p_partkey, (cast(trunc((p_size * 7 + 20 - 16) / 8) as bigint) + 1) * (cast(trunc((p_size * 5 + 30 - 16) / 8) as bigint) + 1) * 10 as n_patches from part")
def se16(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 + 20).alias("h"), (F.col("p_size") * 5 + 30).alias("w"))
    return op.patch_counts(p, 16, 8, half_turn=True, quarter_turns=True, flip_h=True, scale=True).select("p_partkey", F.col("n_patches").cast("long").alias("n_patches"))


@query("se17_patch_table", f"""with x as (select vec_id, r, c, list_sum(list_transform(range(0, 16), lambda i: case when px[cast((r * 2 + i // 4) * 8 + c * 2 + i % 4 + 1 as int)] >= 0.5 then 1 else 0 end)) as s from {RASTERS}, range(3) a(r), range(3) b(c))
 select vec_id, r * 3 + c as part, r * 2 as "top", c * 2 + 4 as "right", v.v as variant, k as "copy" from x, (values ('none'), ('rot180')) v(v), range(2) z(k) where s > 0 and s < 16""")
def se17(spark, d):
    return op.patch_table(rasters(spark, d), 4, 2, ["none", "rot180"], 2, ("vec_id",)).select("vec_id", "part", "top", "right", "variant", F.col("copy").cast("long").alias("copy"))


@query("se18_locate", """with g as (select p_partkey as frame_key, sum(p_size) over (order by p_partkey) - p_size as lo, sum(p_size) over (order by p_partkey) as hi from part), q as (select o_orderkey * 5 as idx from orders)
 select q.idx, g.frame_key, cast(q.idx - g.lo as bigint) as part from q left join g on q.idx >= g.lo and q.idx < g.hi""")
def se18(spark, d):
    g = op.global_index(table(spark, d, "part").select(F.col("p_partkey").alias("frame_key"), F.col("p_size").cast("long").alias("n")))
    return op.locate(g, table(spark, d, "orders").select((F.col("o_orderkey") * 5).alias("idx")))


_LW = "(select user_id as sample, event_id // 40 as batch, value as loss, 1.0 as lam, row_number() over (partition by user_id order by event_id // 40, value) as k from events where value is not null)"


@query("se19_loss_weights", f"""with recursive l as {_LW}, m as (select batch, avg(loss) as m from l group by 1), x as (select l.sample, l.k, case when m > 1e-8 then loss / m else 1.0 end as r, row_number() over (partition by l.sample order by l.batch, case when m > 1e-8 then loss / m else 1.0 end) as i from l join m on l.batch = m.batch),
 s as (select sample, i, 1.0 + 0.2 * (r - 1.0) as d from x where i = 1 union all select s.sample, x.i, s.d + 0.2 * (x.r - s.d) from s join x on x.sample = s.sample and x.i = s.i + 1)
 select sample, {R('d')} as difficulty, {R('1 + greatest(d - 1, 0)')} as weight from (select *, row_number() over (partition by sample order by i desc) as n from s) where n = 1""")
def se19(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return rounded(op.loss_weights(e.select(F.col("user_id").alias("sample"), F.expr("event_id div 40").alias("batch"), F.col("value").alias("loss"), F.lit(1.0).alias("lam"))), "difficulty", "weight")


@query("se20_weighted_sample")
def se20(spark, d):
    return op.weighted_sample(files(spark, d).select(F.col("frame").alias("id"), F.col("size").cast("double").alias("w")), "w", 500)


@query("se20_weighted_sample_replacement")
def se20b(spark, d):
    return op.weighted_sample(files(spark, d).select(F.col("frame").alias("id"), F.col("size").cast("double").alias("w")), "w", 500, replacement=True)
