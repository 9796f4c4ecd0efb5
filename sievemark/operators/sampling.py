"""Deterministic stratified samples for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_stratum(df: DataFrame, strata: list[str], id_column: str, n: int) -> DataFrame:
    """The n smallest ids of each stratum."""
    w = Window.partitionBy(*strata).orderBy(id_column)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def earliest_part(parts: list[DataFrame], id_column: str) -> DataFrame:
    """The union of the parts, each record once, from the first part that has it (``part``)."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(id_column).orderBy("part")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def review_sample(df: DataFrame, id_column: str, strata: list[tuple[str, int]], cap: int | None = 65, already: DataFrame | None = None, top_up: int = 0) -> DataFrame:
    """n smallest ids for each value of each stratum column in turn; ids of ``already`` are left out;
    ``top_up`` adds the smallest of the rest; at most ``cap`` are kept, the smallest ids."""
    pool = df if already is None else without(df, already, id_column)
    parts = [top_per_stratum(pool.where(F.col(c).isNotNull()), [c], id_column, n) for c, n in strata]
    picked = earliest_part(parts, id_column)
    if top_up:
        rest = without(pool, picked, id_column).orderBy(id_column).limit(top_up)
        picked = earliest_part([picked.drop("part"), rest], id_column)
    return picked if cap is None else picked.orderBy(id_column).limit(cap)


def within(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return df.join(ids.select(id_column).distinct(), id_column, "left_semi")


def without(df: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    return df.join(ids.select(id_column).distinct(), id_column, "left_anti")


def merge_preserving(existing: DataFrame, new: DataFrame, id_column: str, blank: str = "") -> DataFrame:
    """Existing rows untouched, and those of the new that aren't there yet; columns that one side
    lacks are blank."""
    fresh = without(new, existing, id_column)
    both = existing.unionByName(fresh, allowMissingColumns=True)
    return both.fillna(blank)


def disagreements(a: DataFrame, b: DataFrame, id_column: str, column: str) -> DataFrame:
    """Ids of both whose ``column`` differs, with both values."""
    x, y = a.select(id_column, F.col(column).alias("left_value")), b.select(id_column, F.col(column).alias("right_value"))
    return x.join(y, id_column).where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def restricted(df: DataFrame, state: str, column: str = "state_final") -> DataFrame:
    out = df.where(F.col(column) == state)
    if not out.limit(1).count():
        raise ValueError(f"no records of state {state!r}")
    return out


def excerpt(fragments: Column, description: Column) -> Column:
    """The first four distinct fragment texts, each cut to 160 characters; else the description's first 300."""
    texts = F.slice(F.array_distinct(F.transform(fragments, lambda f: f["text"])), 1, 4)
    joined = F.array_join(F.transform(texts, lambda t: F.substring(t, 1, 160)), " | ")
    return F.when(F.size(texts) > 0, joined).otherwise(F.substring(description, 1, 300))
