"""What the operators of this package share: the scratch folder, tables cut from their lineage,
and running totals over an order that is spread across the cluster."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session may lack one (tests); it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, and keeps
    the result when executors are lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of a few narrow columns is sent to all tasks up to so many rows, some megabytes.
FEW_ROWS = 1 << 17


def sized(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: sent to all tasks if its counted rows are few, sorted
    and merged if they are not."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table.hint("merge")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``before`` (the sum of ``value`` over the rows of the same keys that come earlier in
    ``order``) and ``rank`` (their number).

    The rows are range-partitioned by keys and order together, so that a key with a third of all
    rows is spread over many tasks; each task sums its own run, and the small table of sums by
    (partition, key) gives what lies before each partition. As a partition holds a contiguous
    range of keys, that table has at most one row for each partition and each key; with keys it
    is counted before it is sent to all tasks, and merged where it is large.
    """
    spark = df.sparkSession
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_sum", T.LongType()),
            T.StructField("_rank", T.LongType()),
        ]
    )
    columns = df.columns

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total, seen = None, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = np.nan_to_num(np.asarray(b.column(columns.index(value)).to_numpy(zero_copy_only=False), dtype="float64")).astype("int64")
            new = np.zeros(n, bool)
            for k in keys:
                c = b.column(columns.index(k))
                code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = tuple(b.column(columns.index(k))[0].as_py() for k in keys)
            if first != last:
                total, seen = 0, 0
            starts = np.flatnonzero(new)
            before = np.cumsum(v) - v
            rank = np.arange(n, dtype="int64")
            # what the run of the same keys began with
            at = np.zeros(n, "int64")
            at[starts] = starts
            at = np.maximum.accumulate(at)
            head = at == 0
            s = before - before[at] + np.where(head, total, 0)
            r = rank - at + np.where(head, seen, 0)
            last = tuple(b.column(columns.index(k))[n - 1].as_py() for k in keys)
            total, seen = int(s[-1] + v[-1]), int(r[-1] + 1)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(columns))), pa.array(np.full(n, part, "int32")), pa.array(s), pa.array(r)],
                names=[*columns, "_part", "_sum", "_rank"],
            )

    n = partitions(df)
    ordered = df.repartitionByRange(n, *keys, *order) if keys else df.repartitionByRange(n, *order)
    # the split of the rows among partitions is drawn from a sample: written once, never drawn again
    runs = stored(ordered.sortWithinPartitions(*keys, *order).mapInArrow(run, schema), "runs")
    parts = runs.groupBy("_part", *keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0)).cast("long")).alias("_t"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    offsets = parts.select(
        F.col("_part").alias("_at"),
        *(F.col(k).alias(v) for k, v in named.items()),
        F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_t0"),
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"),
    )
    side = sized(stored(offsets, "offsets")) if keys else F.broadcast(offsets)
    on = F.col("_part") == F.col("_at")
    for k, v in named.items():
        on = on & F.col(k).eqNullSafe(F.col(v))
    return runs.join(side, on).select(*columns, (F.col("_sum") + F.col("_t0")).alias("before"), (F.col("_rank") + F.col("_n0")).alias("rank"))
