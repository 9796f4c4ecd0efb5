"""Geography by postal code: the rollup of a directory, and its use with recorded provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.places import position_status, postal_code, with_state
from sievemark.functions.text import cleaned, decimal_number, title_case
from sievemark.policy import Policy
from sievemark.sources.tables import written


#: Texts that one task gets of each kind at most; more are joined by shuffle.
BROADCAST_TEXTS = 200_000


def read_texts(directory: DataFrame) -> DataFrame:
    """Every distinct text of the directory's columns, read once: kind, text, and what it says as a
    number, a postal code, a state or a district. Written, as several joins use it."""
    kinds = {"number": ("latitude", "longitude"), "code": ("pincode",), "state": ("statename",), "district": ("district",)}
    cells = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("text")) for kind, columns in kinds.items() for c in columns))
    texts = directory.select(F.inline(cells)).where("text is not null").distinct()
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    named = with_state(texts.withColumn("_text", of("state", F.col("text"))), "_text", "_state", "_method")
    title = title_case(cleaned(F.col("text")))
    return written(
        named.select(
            "kind", "text", of("number", decimal_number(F.col("text"))).alias("number"), of("code", postal_code(F.col("text"))).alias("code"), cleaned(F.col("text")).isNotNull().alias("filled"),
            of("state", F.coalesce("_state", title)).alias("state"), of("district", title).alias("district"),
        ),
        "texts",
    )


def with_reading(df: DataFrame, texts: DataFrame, kind: str, column: str, reading: dict[str, str]) -> DataFrame:
    """Adds what the texts of a column were read as: columns of ``texts`` under new names."""
    side = texts.where(F.col("kind") == kind).select(F.col("text").alias("_text"), *(F.col(c).alias(n) for c, n in reading.items()))
    held = F.broadcast(side) if side.count() <= BROADCAST_TEXTS else side.hint("merge")
    return df.join(held, F.col(column).cast("string") == F.col("_text"), "left").drop("_text")


def postal_rollup(directory: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row for each postal code: modal state and district (ties to the least), mean of the valid
    coordinates, offices, valid coordinates, states seen. Rows without a valid code are left out.

    Texts are read once for each distinct one, whatever the number of rows that hold it. Rows of the
    same spelling are added up first, then spellings of the same names; a code gathers no list."""
    texts = read_texts(directory)
    placed = directory.select("pincode", "statename", "district", "latitude", "longitude")
    placed = with_reading(placed, texts, "number", "latitude", {"number": "_y", "filled": "_has_y"})
    placed = with_reading(placed, texts, "number", "longitude", {"number": "_x", "filled": "_has_x"})
    empty = ~(F.coalesce("_has_y", F.lit(False)) | F.coalesce("_has_x", F.lit(False)))
    ok = position_status(F.col("_y"), F.col("_x"), empty, policy) == "ok"
    spelt = placed.groupBy("pincode", "statename", "district").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.sum(F.when(ok, F.col("_y"))).alias("lat"), F.sum(F.when(ok, F.col("_x"))).alias("lon")
    )
    for kind, column, name in (("code", "pincode", "pincode_clean"), ("state", "statename", "_s"), ("district", "district", "_d")):
        spelt = with_reading(spelt, texts, kind, column, {kind: name})
    rows = spelt.where("pincode_clean is not null")
    names = F.array(F.struct(F.lit("s").alias("kind"), F.col("_s").alias("name")), F.struct(F.lit("d").alias("kind"), F.col("_d").alias("name")))
    # sums stand on the rows of one kind only, so that they add up once
    each = rows.select("pincode_clean", "n", "n_ok", "lat", "lon", F.inline(names))
    one = lambda c: F.sum(F.when(F.col("kind") == "s", F.col(c)))
    by_name = each.groupBy("pincode_clean", "kind", "name").agg(F.sum("n").alias("_n"), *(one(c).alias(c) for c in ("n", "n_ok", "lat", "lon")))
    modal = lambda kind: F.min(F.when((F.col("kind") == kind) & F.col("name").isNotNull(), F.struct((-F.col("_n")).alias("n"), "name")))["name"]
    sums = by_name.groupBy("pincode_clean").agg(
        modal("s").alias("pin_state"), modal("d").alias("pin_district"), F.sum("lat").alias("_lat"), F.sum("lon").alias("_lon"), F.sum("n").alias("n_offices"), F.sum("n_ok").alias("n_valid_coords"),
        F.count_if((F.col("kind") == "s") & F.col("name").isNotNull()).alias("n_states_seen"),
    )
    return sums.select(
        "pincode_clean", "pin_state", "pin_district", F.try_divide("_lat", "n_valid_coords").alias("pin_lat"), F.try_divide("_lon", "n_valid_coords").alias("pin_lon"), "n_offices", "n_valid_coords", "n_states_seen"
    )


#: There are 900,000 six-digit codes at most, so the rollup's two name columns stay small.
CODE_LIMIT = 900_000


def assign_geography(facilities: DataFrame, rollup: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """State and district by the postal code, else the state by the state field; where each came
    from, and whether the two differ. The rollup is worked out and written once; it is broadcast if it
    is small when counted, and joined by shuffle otherwise."""
    named = with_state(facilities.withColumn("pincode_clean", postal_code(F.col("address_zipOrPostcode"))), "address_stateOrRegion", "state_from_field", "state_field_method")
    lookup = written(rollup.select(F.col("pincode_clean").alias("_pin"), F.col("pin_state").alias("state_from_pin"), F.col("pin_district").alias("district_from_pin")), "lookup")
    small = lookup.count() <= broadcast_rows
    joined = named.join(F.broadcast(lookup) if small else lookup.hint("merge"), F.col("pincode_clean") == F.col("_pin"), "left").drop("_pin")
    pin, own = F.col("state_from_pin"), F.col("state_from_field")
    return joined.withColumns(
        {
            "state_final": F.coalesce(pin, own),
            "geo_source": F.when(pin.isNotNull(), "pin_directory").when(own.isNotNull(), "state_field").otherwise("none"),
            "geo_conflict": F.coalesce(pin != own, F.lit(False)),
            "district_final": F.col("district_from_pin"),
        }
    )


def fallback(primary, secondary, primary_name: str, secondary_name: str):
    """(value, source, conflict) of a first choice with a second to fall back on."""
    return (
        F.coalesce(primary, secondary),
        F.when(primary.isNotNull(), primary_name).when(secondary.isNotNull(), secondary_name).otherwise("none"),
        F.coalesce(primary != secondary, F.lit(False)),
    )
