"""Profiles of raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.places import postal_code, with_state
from sievemark.functions.text import NULL_LIKE, cleaned, stripped
from sievemark.operators.clean import typed
from sievemark.policy import Policy


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: missing, placeholder, populated, and the share that is not populated.
    One pass over the table for all columns."""
    columns = columns or df.columns
    counted = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        counted += [F.count_if(text.isNull()).alias(f"m{i}"), F.count_if(F.lower(stripped(text)).isin(*NULL_LIKE)).alias(f"p{i}")]
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"), F.col(f"p{i}").alias("placeholder"), (F.col("_n") - F.col(f"m{i}") - F.col(f"p{i}")).alias("populated")) for i, c in enumerate(columns)))
    share = F.coalesce(F.try_divide(100.0 * (F.col("missing") + F.col("placeholder")), F.col("missing") + F.col("placeholder") + F.col("populated")), F.lit(0.0))
    return df.agg(*counted).select(F.inline(rows)).withColumn("pct_null_like", F.round(share, 2))


def shape_check(tables: dict[str, DataFrame], expected: dict[str, tuple[int | None, int]]) -> DataFrame:
    """Rows and columns of each table against what is expected (rows None: any)."""
    out = None
    for name, (rows, columns) in expected.items():
        df = tables.get(name)
        if df is None:
            continue
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(columns).cast("long").alias("expected_columns"),
            ((F.lit(len(df.columns)) == columns) & (F.lit(True) if rows is None else F.col("n_rows") == rows)).alias("as_expected"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def repeated_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids that occur more than once, with how often."""
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def facility_profile(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """metric, value: repeated ids and rows, coordinate statuses, states and codes that resolve."""
    a = with_state(typed(df, policy), "address_stateOrRegion", "_state", "_method").withColumn("_pin", postal_code(F.col("address_zipOrPostcode")))
    counts = a.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(F.col("coord_status") == s).alias(f"coordinates_{s}") for s in ("ok", "missing", "unparseable", "out_of_range")),
        F.count("_state").alias("resolvable_states"),
        F.count("_pin").alias("valid_postal_codes"),
    )
    twice = repeated_ids(df, "unique_id").agg(F.count(F.lit(1)).alias("repeated_ids"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_of_repeated_ids"))
    long = lambda t: t.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in t.columns))))
    return long(counts).unionByName(long(twice))


def directory_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("pincode").alias("distinct_codes"),
        F.count_distinct("statename").alias("distinct_states"),
        F.count_if(F.col("latitude").isNotNull() & F.col("latitude").try_cast("double").isNull()).alias("non_numeric_latitudes"),
    )


def indicator_profile(df: DataFrame, district: str = "district_name", state: str = "state_ut") -> DataFrame:
    """Cells that are no number even without brackets, commas and asterisks, and distinct districts."""
    values = [c for c in df.columns if c not in (district, state)]
    odd = F.lit(0)
    for c in values:
        text = F.regexp_replace(cleaned(F.col(f"`{c}`")), r"[(),*]", "")
        odd = odd + ((text != "") & text.try_cast("double").isNull()).cast("int")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(odd, F.lit(0))).alias("non_numeric_cells"), F.count_distinct(F.struct(state, district)).alias("distinct_districts"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, column: str, k: int, width: int | None = None) -> DataFrame:
    """The most frequent values; null is one of them."""
    name = F.coalesce(F.substring(F.col(column), 1, width) if width else F.col(column).cast("string"), F.lit("(null)"))
    return df.groupBy(name.alias(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def counters() -> list[Column]:
    """What is counted of scored records, beside the rows that came in and went out."""
    return [
        F.count_if("geo_conflict").cast("double").alias("geo_conflicts"),
        F.count("state_final").cast("double").alias("states_resolved"),
        F.count("district_final").cast("double").alias("districts_resolved"),
        F.round(F.avg("capability_evidence_score"), 1).alias("mean_evidence"),
        F.round(F.avg("data_completeness_score"), 1).alias("mean_completeness"),
    ]


def run_counters(before: DataFrame, after: DataFrame, scored: DataFrame) -> DataFrame:
    """metric, value of one run of the build."""
    a = before.agg(F.count(F.lit(1)).cast("double").alias("rows_in"))
    b = after.agg(F.count(F.lit(1)).cast("double").alias("rows_out"))
    c = scored.agg(*counters())
    long = lambda t: t.select(F.inline(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in t.columns))))
    return long(a).unionByName(long(b)).unionByName(long(c))
