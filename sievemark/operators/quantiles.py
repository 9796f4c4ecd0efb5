"""Exact percentiles without holding a group in one task.

Equal values are counted first, before anything moves. Unless they are few, the counts are then dealt out
by ranges of (group, value), so a group of any size is spread over many tasks; each adds up its own run, and a table
of sums by (task, group) says what lies before it. The two rows at each percentile's place are picked
and interpolated. Values and results are those of Spark's own ``percentile``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.sources.tables import written

#: So many distinct values of all groups together are few enough to be one part.
FEW = 1 << 17


def exact_percentiles(df: DataFrame, keys: list[str], column: str, quantiles: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row for each group: keys, ``n`` (values that are not null) and one column for each quantile.
    ``weight`` is a column of how often the value stands. Groups without a value have no row; null keys
    are a group."""
    spark = df.sparkSession
    count = F.sum(weight) if weight else F.count(F.lit(1))
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    counts = df.where(F.col(column).isNotNull()).select(group.alias("_k"), F.col(column).cast("double").alias("_v"), *([weight] if weight else [])).groupBy("_k", "_v").agg(count.alias("_n"))
    placed = written(counts, "counts")
    if placed.count() > FEW:
        # the ranges come from a sample: drawn once
        placed = written(placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_k", "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    else:
        placed = placed.withColumn("_part", F.lit(0))
    earlier = Window.partitionBy("_part", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.withColumn("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # at most a row for each task and group
    sums = placed.groupBy("_part", "_k").agg(F.sum("_n").alias("_t"))
    parts = Window.partitionBy("_k").orderBy("_part")
    offsets = sums.select("_part", "_k", F.coalesce(F.sum("_t").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    ranked = runs.join(offsets.hint("merge"), ["_part", "_k"]).withColumn("_b", F.col("_b") + F.col("_o"))
    picks = []
    for name, q in quantiles.items():
        h = (F.col("_total") - 1) * F.lit(float(q))
        for side, at in (("lower", F.floor(h)), ("upper", F.ceil(h))):
            picks.append(F.when((at >= F.col("_b")) & (at < F.col("_b") + F.col("_n")), F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), F.col("_v").alias("v"))))
    picked = ranked.select("_k", "_total", F.explode(F.array_compact(F.array(*picks))).alias("p"))
    of = lambda name, side: F.max(F.when((F.col("p.q") == name) & (F.col("p.side") == side), F.col("p.v")))
    wide = picked.groupBy("_k").agg(F.first("_total").alias("n"), *(of(name, side).alias(f"_{name}_{side}") for name in quantiles for side in ("lower", "upper")))

    def between(name: str, q: float):
        h, low, high = (F.col("n") - 1) * F.lit(float(q)), F.col(f"_{name}_lower"), F.col(f"_{name}_upper")
        return F.when((F.floor(h) == F.ceil(h)) | (low == high), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return wide.select(*(F.col(f"_k.{k}").alias(k) for k in keys), "n", *(between(name, q).alias(name) for name, q in quantiles.items()))
