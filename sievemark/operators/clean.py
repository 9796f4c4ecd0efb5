"""Cleaning jobs: which columns stay, which of several records of one id, typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.places import coordinates, with_state
from sievemark.functions.text import cleaned, decimal_number, list_items, populated, reader_null, whole_number
from sievemark.policy import LIST_FIELDS, Policy

KEPT = (
    "unique_id", "name", "organization_type", "address_line1", "address_city", "address_stateOrRegion", "address_zipOrPostcode", "description", "area", "numberDoctors",
    "capacity", "specialties", "procedure", "equipment", "capability", "source", "source_urls", "latitude", "longitude", "cluster_id",
)


def most_complete(df: DataFrame, id_column: str, order: list[str | Column], columns: list[str] | None = None) -> DataFrame:
    """One row for each id: the one with most values, the earliest in ``order`` of equals. Null ids
    are one id. A value counts as missing if a CSV reader would have read it as such.

    The best row is an aggregate, so rows are combined before the shuffle and an id with a third of
    all rows needs no task to hold them.
    """
    columns = columns or df.columns
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    total = F.lit(0)
    for c in columns:
        total = total + (reader_null(F.col(c)) if c in text else F.col(c)).isNotNull().cast("int")
    keys = [F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
    rest = [c for c in df.columns if c != id_column]
    best = F.min(F.struct((-total).alias("_n"), *keys, *(F.col(c) for c in rest))).alias("_best")
    return df.groupBy(id_column).agg(best).select(*(F.col(c) if c == id_column else F.col(f"_best.{c}").alias(c) for c in df.columns))


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_in, rows_out, rows_dropped."""
    a, b = before.agg(F.count(F.lit(1)).alias("rows_in")), after.agg(F.count(F.lit(1)).alias("rows_out"))
    return a.join(F.broadcast(b), F.lit(True)).withColumn("rows_dropped", F.col("rows_in") - F.col("rows_out"))  # one row each


def kept_columns(df: DataFrame, columns: tuple[str, ...] = KEPT) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def typed(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds parsed coordinates with their status, capacity and number of doctors."""
    point = coordinates(F.col("latitude"), F.col("longitude"), policy)
    return df.withColumn("_p", point).select(
        *df.columns,
        F.col("_p.lat").alias("lat_parsed"),
        F.col("_p.lon").alias("lon_parsed"),
        F.col("_p.status").alias("coord_status"),
        whole_number(F.col("capacity")).alias("capacity_int"),
        whole_number(F.col("numberDoctors")).alias("number_doctors_int"),
    )


def parsed_lists(df: DataFrame, fields: tuple[str, ...] = LIST_FIELDS) -> DataFrame:
    """The list fields as arrays of items, under their own names."""
    return df.withColumns({c: list_items(F.col(c)) for c in fields if c in df.columns})


def clean_indicators(df: DataFrame, district: str = "district_name", state: str = "state_ut") -> DataFrame:
    """District indicators: cleaned identifiers, the canonical state beside the raw one, and every
    other column as a number."""
    rest = [c for c in df.columns if c not in (district, state)]
    named = with_state(df, state, "_state", "_method")
    return named.select(cleaned(F.col(district)).alias("district_name"), F.col(state).alias("state_raw"), F.col("_state").alias("state"), *(decimal_number(F.col(f"`{c}`")).alias(c) for c in rest))


def duplicate_keys(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Adds ``flag``: another row has the same cleaned, lower-cased keys. Rows whose first key is
    blank never count, and don't meet in one task: they are set apart before the shuffle."""
    named = df.withColumns({f"_k{i}": F.lower(F.coalesce(cleaned(F.col(k)), F.lit(""))) for i, k in enumerate(keys)})
    k = [f"_k{i}" for i in range(len(keys))]
    often = named.where("_k0 <> ''").groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(c).alias("r" + c) for c in k))
    on = F.col("_k0") != ""
    for c in k:
        on = on & (F.col(c) == F.col("r" + c))
    return named.join(often, on, "left").withColumn(flag, F.col("r_k0").isNotNull()).select(*df.columns, flag)


def first_by(df: DataFrame, keys: list[str], order: list[Column], limit: int = 1) -> DataFrame:
    """The first ``limit`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def completeness_of(df: DataFrame, columns: list[str], name: str = "n_populated") -> DataFrame:
    return df.withColumn(name, populated(columns))
