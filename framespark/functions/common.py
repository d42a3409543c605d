"""Shared columns and two-pass helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

EPS = 1e-8


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder named in spark.checkpoint.dir. Only a local session (tests) may leave it unset: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/framespark-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut of the lineage that outlives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_by(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys, for rows that come in many small groups: joins and groups by these and more columns then move nothing.

    Joins do so only if spark.sql.requireAllClusterKeysForCoPartition is false, which is set here for the session. Only plans use
    it, whose groups are known to be small; operators take rows as they come.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(*keys)


#: Rows of a group that one task may hold; larger groups go by joins over all tasks.
GROUP_ROWS = 1 << 17


def whole_groups(rows: DataFrame, keys: list[str], size: Column | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """rows of the groups by keys whose size (an aggregate, by default the number of rows) is within the limit, and those of all others or None.

    Rows with a null key are among the others, and so is everything without keys. rows are read twice, so they should be a table.
    """
    if not keys:
        return rows.limit(0), rows
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    size = F.count(F.lit(1)) if size is None else size
    big = rows.groupBy(*keys).agg(size.alias("_size")).where((F.col("_size") > (GROUP_ROWS if limit is None else limit)) | null).select(*[F.col(c).alias(f"_{c}") for c in keys])
    if big.isEmpty():
        return rows, None
    big = stash(big, f"{work_dir(rows.sparkSession)}/big")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return rows.join(big, same, "left_anti"), rows.join(big, same, "left_semi")


def by_group(rows: DataFrame, keys: list[str], solve: Callable, schema: str) -> DataFrame:
    """(keys, columns of schema): solve(), called once a group with the lists of its other columns, returns the lists of the new columns.

    Rows are laid and sorted by keys, and a task goes through its groups one after the other; only for groups of whole_groups().
    """
    given = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    new = StructType.fromDDL(schema)
    out = StructType([given.schema[k] for k in keys] + new.fields)
    types = [f.type for f in to_arrow_schema(new)]
    names, n = out.names, len(keys)

    def borders(t: pa.Table) -> np.ndarray:
        first = np.zeros(t.num_rows, bool)
        first[:1] = True
        for i in range(n):
            first[1:] |= pc.not_equal(t.column(i).slice(1), t.column(i).slice(0, t.num_rows - 1)).to_numpy()
        return np.flatnonzero(first)

    def solved(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        columns = [c.to_pylist() for c in t.columns[n:]]
        counts, found = [], [[] for _ in types]
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
            got = solve(*[c[lo:hi] for c in columns])
            counts.append(len(got[0]))
            for f, g in zip(found, got, strict=True):
                f.extend(g)
        place = pa.array(np.repeat(at, counts))
        arrays = [t.column(i).combine_chunks().take(place) for i in range(n)] + [pa.array(f, x) for f, x in zip(found, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            at = borders(t)
            last = int(at[-1])
            # the last group may go on in the next batch
            if last:
                yield solved(t.slice(0, last), at[:-1])
            held = t.slice(last).to_batches()
        if held:
            yield solved(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return given.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def r6(c: Column) -> Column:
    """Rounded to six places the same way in every engine."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def stem(name: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def total(values: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with a dense row number from 0 in the given order, without all rows in one task.

    Rows are range-partitioned, numbered within their partition, and shifted by the number of rows in the partitions
    before; only one count per partition is gathered. The partitioned rows are written to the shared folder, since
    both the counts and the numbers must see one and the same partitioning.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [f"_o{i}" for i in range(len(order))]
    placed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(n, *keys)
    placed = stash(placed.withColumn("_part", F.spark_partition_id()), f"{work_dir(spark)}/placed")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_part"), before.alias("_before"))
    local = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    return local.join(F.broadcast(counts), "_part").withColumn(name, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before", *keys)
