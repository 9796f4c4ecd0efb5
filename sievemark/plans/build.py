"""The whole build: raw tables in, scored records and regional tables out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.clean import clean_indicators, kept_columns, most_complete, typed
from sievemark.operators.geography import assign_geography, postal_rollup
from sievemark.operators.profile import counters
from sievemark.operators.regions import rollup
from sievemark.operators.scoring import scored
from sievemark.policy import Policy
from sievemark.sources.tables import write_summary, write_tables, written


def _placed(facilities: DataFrame, lookup: DataFrame, policy: Policy) -> DataFrame:
    order = [c for c in facilities.columns if c != "unique_id"]
    one = most_complete(facilities, "unique_id", order)
    return assign_geography(typed(kept_columns(one), policy), lookup)


def cleaned_facilities(facilities: DataFrame, directory: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One typed record for each id, with its geography. Completeness counts all columns, so the
    choice among records of one id comes before columns are dropped."""
    return _placed(facilities, postal_rollup(directory, policy), policy)


def build(facilities: DataFrame, directory: DataFrame, indicators: DataFrame | None = None, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """The processed tables; the postal rollup is written at once, the others are lazy. The scored records
    feed three of them and are kept meanwhile: ``facilities_scored`` is persisted; unpersist it when the
    tables are written."""
    lookup = written(postal_rollup(directory, policy), "postal")
    rows = scored(_placed(facilities, lookup, policy), policy).persist(StorageLevel.MEMORY_AND_DISK)
    tables = {
        "facilities_scored": rows,
        "pin_lookup": lookup,
        "region_state": rollup(rows, "state", policy),
        "region_district": rollup(rows, "district", policy),
    }
    if indicators is not None:
        tables["indicators"] = clean_indicators(indicators)
    return tables


def run(spark: SparkSession, facilities: DataFrame, directory: DataFrame, folder: str, indicators: DataFrame | None = None, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """Writes all tables and the run's counters below ``folder``, and returns the tables as written. The
    counters are observed while the scored records are written, so they cost no scan of their own; the
    regions are rolled up from the written records, which need not be kept in memory."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    write_tables({"pin_lookup": postal_rollup(directory, policy)} | ({} if indicators is None else {"indicators": clean_indicators(indicators)}), folder)
    before, after = Observation("records read"), Observation("records scored")
    counted = facilities.observe(before, F.count(F.lit(1)).cast("double").alias("rows_in"))
    rows = scored(_placed(counted, read("pin_lookup"), policy), policy).observe(after, F.count(F.lit(1)).cast("double").alias("rows_out"), *counters())
    write_tables({"facilities_scored": rows}, folder)
    seen = before.get | after.get
    write_summary(spark.createDataFrame([(name, None if value is None else float(value)) for name, value in seen.items()], "metric string, value double"), f"{folder}/run_summary")
    kept = read("facilities_scored")
    write_tables({"region_state": rollup(kept, "state", policy), "region_district": rollup(kept, "district", policy)}, folder)
    return {name: read(name) for name in ("facilities_scored", "pin_lookup", "region_state", "region_district", *(() if indicators is None else ("indicators",)))}


def ordinal(df: DataFrame, name: str = "ingest_ord") -> DataFrame:
    """Adds the place of each row in its files, as an order of arrival for ties."""
    return df.withColumn(name, F.monotonically_increasing_id())
