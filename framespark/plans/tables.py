"""Domain tables derived from the test tables, each as a DataFrame and as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FILES_SQL = """(select o_orderkey as frame, o_orderstatus as folder,
  case o_orderkey % 3 when 0 then '.png' when 1 then '.jpg' else '.cif' end as ext,
  'Frame_' || o_orderkey || case o_orderkey % 3 when 0 then '.png' when 1 then '.jpg' else '.cif' end as name,
  o_orderstatus || '/' || 'Frame_' || o_orderkey || case o_orderkey % 3 when 0 then '.png' when 1 then '.jpg' else '.cif' end as path,
  cast(floor(o_totalprice) as bigint) as size from orders)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(frame, folder, ext, name, path, size): one file per order."""
    o = table(spark, sf_dir, "orders")
    ext = F.element_at(F.array(F.lit(".png"), F.lit(".jpg"), F.lit(".cif")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = o.select(F.col("o_orderkey").alias("frame"), F.col("o_orderstatus").alias("folder"), ext.alias("ext"), F.floor("o_totalprice").alias("size"))
    o = o.withColumn("name", F.concat(F.lit("Frame_"), F.col("frame").cast("string"), "ext"))
    return o.withColumn("path", F.concat_ws("/", "folder", "name"))


METRICS_SQL = """(select cast(event_id // 5 as bigint) as frame, case when event_type in ('click', 'view') then 'dice' else 'model_confidence::' || event_type end as metric_key, max(value) as value from events where value is not null group by 1, 2)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metrics(frame, metric_key, value) from events."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.groupBy(F.expr("event_id div 5").alias("frame"), F.when(F.col("event_type").isin("click", "view"), F.lit("dice")).otherwise(F.concat(F.lit("model_confidence::"), "event_type")).alias("metric_key")).agg(F.max("value").alias("value"))
