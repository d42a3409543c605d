"""Queries of readers and writers on texts made from the test tables, and of the keyed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from framespark.functions.common import r6, stash, work_dir
from framespark.operators.selection import loss_weights
from framespark.plans.polygons import POLY, polygons
from framespark.plans.scoring import _LOG, METRICS_SQL, train_log
from framespark.plans.tables import metrics, table
from framespark.sources import files as op
from framespark.streaming import jobs

Q, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("io2_parse_cif", "select s_suppkey, v.polygon_id, v.category, v.n as n, v.x as x, v.y as y from (select s_suppkey, unnest([{'polygon_id': 1, 'category': 'conductor', 'n': 4, 'x': 4.0, 'y': 500.0 - 28}, {'polygon_id': 2, 'category': 'via', 'n': 4, 'x': 100.0 + s_suppkey - 5, 'y': 500.0 - 150 - 4}]) as v from supplier)")
def io2(spark, d):
    k = F.col("s_suppkey").cast("string")
    t = table(spark, d, "supplier").select(k.alias("path"), F.concat(F.lit("( R s"), k, F.lit(".png );\n( S 400 500 );\nP 4 28 24 28 24 12 4 12 4 28;\nB 10 8 "), (F.col("s_suppkey") + 100).cast("string"), F.lit(" 150;\nDF;\nE\n")).alias("value"))
    p = F.get("points", F.lit(0))
    return op.parse_cif(t).select(F.col("path").cast("long").alias("s_suppkey"), "polygon_id", "category", F.size("points").alias("n"), p["x"].alias("x"), p["y"].alias("y"))


@query("io3_cif_round_trip", f"select frame_key, count(*) as n, sum(case when id % 7 = 0 and not via then 3 else 4 end) as n_vertices from {POLY} where not is_hole group by 1")
def io3(spark, d):
    """The round trip of the polygons of every frame; vias come back as boxes."""
    p = polygons(spark, d).withColumnRenamed("id", "polygon_id")
    frames = p.select("frame_key").distinct().withColumns({"w": F.lit(400), "h": F.lit(400)})
    back = op.parse_cif(op.format_cif(p, frames).select(F.col("frame_key").alias("path"), "value"))
    return back.groupBy(F.col("path").alias("frame_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("points")).alias("n_vertices"))


@query("io4_explode_vertices", f"select frame_key, id as polygon_id, cast(is_hole as int) as is_hole, coalesce(cast(parent_id as varchar), '') as parent_id, case when id % 7 = 0 then 3 else 4 end as n from {POLY}")
def io4(spark, d):
    v = op.explode_vertices(polygons(spark, d).withColumnRenamed("id", "polygon_id"))
    return v.groupBy("frame_key", "polygon_id", "is_hole", "parent_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("io5_parse_edif", "select cast(s_suppkey as varchar) as design, 'pin' as kind, 'N' || s_suppkey as net, 'INS28' as instance, null as x from supplier union all select cast(s_suppkey as varchar), 'wire', 'N' || s_suppkey, null, s_suppkey from supplier union all select cast(s_suppkey as varchar), 'wire', 'N' || s_suppkey, null, 7 from supplier")
def io5(spark, d):
    k = F.col("s_suppkey").cast("string")
    t = table(spark, d, "supplier").select(k.alias("path"), F.concat(F.lit("(edif x (net N"), k, F.lit(" (joined (portRef DRAIN (instanceRef INS28))) (figure WIRE (path (pointList (pt "), k, F.lit(" -1680) (pt 7 8))))))")).alias("value"))
    return op.parse_edif(t).select("design", "kind", "net", "instance", F.col("x").cast("long").alias("x"))


@query("io6_verdicts", "select number, arg_max(ok, pos) as is_correct from (select o_orderkey as pos, o_orderkey // 2 as number, o_orderstatus <> 'F' as ok from orders) group by 1")
def io6(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("folder/frame_"), F.lpad(F.expr("o_orderkey div 2").cast("string"), 7, "0"), F.lit("_result.cif"))
    return op.verdicts(o.select(F.col("o_orderkey").alias("pos"), name.alias("name"), F.when(F.col("o_orderstatus") == "F", "0").when(F.col("o_orderstatus") == "O", "1").alias("correct")))


@query("io7_series_table", f"select cast(epoch as varchar) as \"Epoch\", max(loss) filter (where run = 'click') as click, max(loss) filter (where run = 'view') as \"view\" from {_LOG} where run in ('click', 'view') group by epoch")
def io7(spark, d):
    s = train_log(spark, d).where("run in ('click', 'view')").groupBy(F.col("run").alias("label"), F.col("epoch").cast("double").alias("x")).agg(F.max("loss").alias("y"))
    return op.series_table(s, ["click", "view"])


@query("io8_selection_manifest", f"select count(*) as n_primary from {METRICS_SQL} where metric_key = 'dice'")
def io8(spark, d):
    m = metrics(spark, d).where("metric_key = 'dice'").select("frame", F.col("value").alias("score"), F.lit(1.0).alias("percentile"), F.lit("primary").alias("reason"))
    return op.selection_lines(m).agg(F.count_if(F.get_json_object("value", "$.reason") == "primary").alias("n_primary"))


def customer_files(spark, d):
    """A folder with a text file for each nation, a line for each of its customers, written in the shared folder."""
    root = f"{work_dir(spark)}/nations"
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("value"))
    c.repartition("c_nationkey").write.partitionBy("c_nationkey").text(root)
    return root


_NATION = r"c_nationkey=(\d+)"


@query("io1_scan_manifest", "select c_nationkey as nation, '.txt' as ext, sum(length(cast(c_custkey as varchar)) + 1) as size from customer group by c_nationkey")
def io1(spark, d):
    m = op.scan_manifest(spark, customer_files(spark, d), (".TXT",))
    return m.groupBy(F.regexp_extract("path", _NATION, 1).cast("long").alias("nation"), "ext").agg(F.sum("size").alias("size"))


def count_lines(text: str) -> str:
    n = len(text.splitlines())
    if n % 5 == 0:
        raise ValueError("a multiple of five")
    return str(n)


@query("st1_stream_folder", """select c_nationkey as nation, case when count(*) % 5 <> 0 then cast(count(*) as varchar) end as result, case when count(*) % 5 = 0 then 'ValueError: a multiple of five' end as error from customer group by c_nationkey""")
def st1(spark, d):
    out = work_dir(spark)
    jobs.stream_folder(spark, customer_files(spark, d), count_lines, f"{out}/rows", f"{out}/offsets").awaitTermination()
    return spark.read.schema("path string, result string, error string").parquet(f"{out}/rows").select(F.regexp_extract("path", _NATION, 1).cast("long").alias("nation"), "result", "error")


def _stream(spark, df, job):
    """The last state of a keyed stream over df, written as files and read as a stream."""
    folder = work_dir(spark)
    src = stash(df, f"{folder}/in")
    out = job(spark.readStream.schema(src.schema).parquet(f"{folder}/in"))
    q = out.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.parquet(f"{folder}/out/batch={i}")).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("st2_stream_loss_weights")
def st2(spark, d):
    e = table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("sample"), F.expr("event_id div 40").alias("batch"), "value")
    mean = e.groupBy("batch").agg(F.avg("value").alias("m"))
    log = e.join(mean, "batch").select("sample", "batch", (F.col("value") / F.col("m")).alias("ratio"), F.lit(1.0).alias("lam"))
    return _stream(spark, log, jobs.stream_loss_weights).withColumns({c: r6(F.col(c)) for c in ("difficulty", "weight")})


@query("st3_stream_early_stopping")
def st3(spark, d):
    log = train_log(spark, d).groupBy("run", "epoch").agg(F.avg("loss").alias("loss"))
    return _stream(spark, log, lambda s: jobs.stream_early_stopping(s, 4, 0.01))


def batch_loss_weights(spark, d):
    """What st2 must equal."""
    e = table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("sample"), F.expr("event_id div 40").alias("batch"), F.col("value").alias("loss"), F.lit(1.0).alias("lam"))
    return loss_weights(e).withColumns({c: r6(F.col(c)) for c in ("difficulty", "weight")})
