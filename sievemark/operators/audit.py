"""Self-audit of the headline numbers: what stands behind each class and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.names import NOT_HOSPITALS, audit_category
from sievemark.operators.scoring import substantive
from sievemark.operators.profile import top_counts, value_counts
from sievemark.operators.quantiles import exact_percentiles
from sievemark.policy import GAP, GENERAL_SUBTYPE, REVIEW, SUSPICIOUS, TRUSTED, UNASSIGNED, Policy

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def score_stats(df: DataFrame, column: str, keys: list[str] | None = None, width: float = 10.0, bins: int = 10, spread: bool = False) -> DataFrame:
    """Count, mean, median, interpolated percentiles and equal bins, the last closed on both sides. A
    task holds the distinct values of a group, as suits scores; with ``spread`` no task does."""
    c = F.col(column)
    bin_of = F.least(F.floor(c / width), F.lit(bins - 1))
    first = [F.count(c).alias("n"), F.avg(c).alias("mean")]
    last = [F.count_if(bin_of == i).alias(f"bin_{i}") for i in range(bins)]
    if not spread:
        return df.groupBy(*(keys or [])).agg(*first, F.median(c).alias("median"), *(F.percentile(c, q).alias(f"p{int(q * 100)}") for q in QUANTILES), *last)
    names = [f"_{k}" for k in keys or []]
    found = exact_percentiles(df, keys or [], column, {"median": 0.5, **{f"p{int(q * 100)}": q for q in QUANTILES}}).drop("n").withColumnsRenamed(dict(zip(keys or [], names)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys or [], names)), F.lit(True))
    sums = df.groupBy(*(keys or [])).agg(*first, *last)
    joined = sums.join(found.hint("merge") if keys else F.broadcast(found), same, "left")  # one row without keys
    return joined.select(*(keys or []), "n", "mean", "median", *(f"p{int(q * 100)}" for q in QUANTILES), *(f"bin_{i}" for i in range(bins)))


def combination_counts(df: DataFrame, items: Column, keys: list[str] | None = None) -> DataFrame:
    """How often each sorted combination of an array's items occurs, with its share."""
    combo = F.array_join(F.array_sort(items), "+")
    counts = df.groupBy(*(keys or []), combo.alias("combination")).agg(F.count(F.lit(1)).alias("n"))
    total = df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(total.hint("merge"), keys) if keys else counts.join(F.broadcast(total), F.lit(True))  # one row
    return joined.withColumn("pct", 100.0 * F.col("n") / F.col("_n")).drop("_n")


def judgeable(policy: Policy = Policy()) -> Column:
    return F.col("data_completeness_score") >= policy.thresholds.sufficient_completeness


def _long(t: DataFrame, section: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(c).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(c).cast("double").alias("value")) for c in t.columns))
    return t.select(F.inline(cells))


def _keyed(t: DataFrame, section: str, metric: str, key: str, value: str = "n") -> DataFrame:
    return t.select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.coalesce(F.col(key).cast("string"), F.lit("(null)")).alias("key"), F.col(value).cast("double").alias("value"))


def judgeability(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What judgeable records lack."""
    has_field = lambda name: F.exists("items", lambda x: x["field"] == name)
    signals = lambda g: F.size(f"{g}_signals") > 0
    # what would be left of the score without the fields that one extraction pass generated together
    generated = ("procedure", "equipment")
    rest = F.aggregate(F.map_values(F.map_filter("completeness_components", lambda k, _: ~k.isin(*generated))), F.lit(0), lambda a, x: a + x)
    return rows.where(judgeable(policy)).agg(
        F.count(F.lit(1)).alias("judgeable"),
        F.count_if(F.col("capacity_int").isNull()).alias("missing_capacity"),
        F.count_if(F.col("number_doctors_int").isNull()).alias("missing_doctors"),
        F.count_if(~F.map_contains_key("completeness_components", "source_url")).alias("missing_source"),
        F.count_if(F.col("coord_status") != "ok").alias("missing_coordinates"),
        F.count_if(F.col("district_final").isNull()).alias("missing_district"),
        F.count_if(~signals("procedure")).alias("no_relevant_procedure"),
        F.count_if(~signals("equipment")).alias("no_relevant_equipment"),
        F.count_if(~F.col("explicit_icu_claim")).alias("no_explicit_claim"),
        F.count_if((has_field("procedure") | has_field("equipment")) & ~signals("procedure") & ~signals("equipment") & ~F.col("explicit_icu_claim")).alias("generic_content_only"),
        F.count_if(rest < policy.thresholds.sufficient_completeness).alias("judgeable_by_generated_only"),
    )


def gap_records(rows: DataFrame) -> DataFrame:
    """section rows on the records of the gap class."""
    gaps = rows.where(F.col("classification") == GAP).withColumn("_category", audit_category(F.col("name"), F.col("organization_type")))
    shares = gaps.agg(
        F.count(F.lit(1)).alias("total"),
        (100.0 * F.avg((F.col("_category") == "hospital_like").cast("double"))).alias("pct_hospital_like"),
        (100.0 * F.avg(F.col("_category").isin(*NOT_HOSPITALS).cast("double"))).alias("pct_clearly_non_hospital"),
        F.count_if(F.map_contains_key("completeness_components", "source_url")).alias("with_source"),
        F.count_if(F.col("coord_status") == "ok").alias("with_coordinates"),
        F.count_if(F.col("capacity_int").isNotNull()).alias("with_capacity"),
    )
    s = "gap_records"
    parts = [
        _long(shares, s),
        _keyed(top_counts(gaps, "organization_type", 10, 40), s, "organization_type", "organization_type"),
        _keyed(value_counts(gaps, "_category"), s, "category", "_category"),
        _keyed(value_counts(gaps, "state_final"), s, "state", "state_final"),
        _keyed(top_counts(gaps, "district_final", 20), s, "district", "district_final"),
        _long(score_stats(gaps, "data_completeness_score"), s + "_completeness"),
        _long(score_stats(gaps, "capability_evidence_score"), s + "_evidence"),
    ]
    return reduce(DataFrame.unionByName, parts)


def barely_trusted(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Trusted records that stand just above the bar, the weakest first."""
    t = policy.thresholds
    near = (F.col("capability_evidence_score") <= t.high_evidence + 5) | (F.col("n_corroboration_categories") <= t.min_corroboration_categories)
    return rows.where((F.col("classification") == TRUSTED) & near).orderBy("capability_evidence_score", "unique_id")


def trusted_records(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    trusted = rows.where(F.col("classification") == TRUSTED)
    none = F.array(F.lit("(none)"))
    kinds = trusted.select(F.explode(F.when(F.size("icu_subtypes") > 0, F.col("icu_subtypes")).otherwise(none)).alias("subtype"))
    raised = trusted.select(F.explode(F.transform("validation_flags", lambda f: f["name"])).alias("flag"))
    claim_fields = F.array_distinct(F.transform(F.filter("fragments", lambda f: f["group"] == "explicit_icu"), lambda f: f["field"]))
    lists_only = (F.size(claim_fields) > 0) & (F.size(F.array_except(claim_fields, F.array(F.lit("capability"), F.lit("specialties")))) == 0)
    s = "trusted_records"
    parts = [
        _long(trusted.agg(F.count(F.lit(1)).alias("total"), F.count_if(lists_only).alias("structured_claim_only")), s),
        _long(barely_trusted(rows, policy).agg(F.count(F.lit(1)).alias("barely_trusted")), s),
        _keyed(value_counts(kinds, "subtype"), s, "subtype", "subtype"),
        _keyed(value_counts(raised, "flag"), s, "flag", "flag"),
        _keyed(combination_counts(trusted, F.col("corroboration_categories")), s, "categories", "combination"),
        _keyed(combination_counts(trusted, claim_fields), s, "claim_fields", "combination"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dominance(rows: DataFrame, keys: list[str], flagged: Column, share: float = 0.5, top: int = 20) -> DataFrame:
    """Groups in which at least ``share`` of the records are flagged, by share."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(flagged.cast("double")).alias("share"))
    return found.where(F.col("share") >= share).orderBy(F.desc("share"), F.desc("n"), *keys).limit(top)


def regional(rows: DataFrame, states: DataFrame, districts: DataFrame) -> DataFrame:
    s = "regional"
    single = districts.agg(F.count_if((F.col("trusted_icu_count") == 1) & (F.col("district") != UNASSIGNED)).alias("single_trusted_districts"))
    named = rows.where(F.col("district_final").isNotNull()).withColumns(
        {"_off": audit_category(F.col("name"), F.col("organization_type")).isin(*NOT_HOSPITALS), "_district": F.concat_ws("/", "state_final", "district_final")}
    )
    return reduce(
        DataFrame.unionByName,
        [
            _keyed(value_counts(states, "region_status"), s, "states", "region_status"),
            _keyed(value_counts(districts, "region_status"), s, "districts", "region_status"),
            _long(single, s),
            _keyed(dominance(named, ["_district"], F.col("_off")), s, "non_hospital_share", "_district", "share"),
        ],
    )


def report(rows: DataFrame, states: DataFrame, districts: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The whole audit as (section, metric, key, value) rows."""
    can = rows.where(judgeable(policy))
    parts = [
        _keyed(value_counts(rows, c), "counts", c, c)
        for c in ("classification", "coord_status", "geo_source")
    ]
    parts += [
        _long(judgeability(rows, policy), "judgeability"),
        _long(score_stats(can, "data_completeness_score"), "judgeability_completeness"),
        _keyed(combination_counts(can, F.map_keys("completeness_components")), "judgeability", "components", "combination"),
        gap_records(rows),
        trusted_records(rows, policy),
        regional(rows, states, districts),
    ]
    return reduce(DataFrame.unionByName, parts)


def boundary_population(policy: Policy = Policy()) -> Column:
    """Records that lack one corroboration category only."""
    t = policy.thresholds
    return (
        (F.col("classification") == REVIEW)
        & (F.col("capability_evidence_score") >= t.high_evidence)
        & F.col("explicit_icu_claim")
        & (F.col("n_corroboration_categories") == 1)
        & judgeable(policy)
        & (F.col("n_contradiction_flags") == 0)
        & ~F.exists("validation_flags", lambda f: f["severity"] == SUSPICIOUS)
    )


def boundary_summary(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """section rows on the records at the boundary: where their claim stands, what flags and kinds
    they have, and how many a substantive description would move."""
    claim = lambda f: f["group"] == "explicit_icu"
    flagged = lambda name: F.exists("validation_flags", lambda f: f["name"] == name)
    at = rows.where(boundary_population(policy)).withColumns(
        {
            "_length": F.char_length("description"), "_c": F.get("corroboration_categories", F.lit(0)), "_audit": audit_category(F.col("name"), F.col("organization_type")),
            "_described": F.exists("fragments", lambda f: claim(f) & (f["field"] == "description")),
            "_substantive": F.exists("fragments", lambda f: claim(f) & (f["field"] == "description") & substantive(f["text"], policy)),
            "_subtype_only": (F.size("icu_subtypes") > 0) & ~F.array_contains("icu_subtypes", GENERAL_SUBTYPE),
        }
    )
    s = "boundary"
    measures = {
        "total": F.count(F.lit(1)), "claim_in_description": F.count_if("_described"), "claim_only_structured": F.count_if(~F.col("_described")), "with_directory_flag": F.count_if(flagged("directory_or_partner_content_detected")),
        "subtype_only": F.count_if("_subtype_only"), "moves_v2a": F.count_if("_substantive"), "moves_v2b": F.count_if(F.col("description_claim").isNotNull()),
    }
    lengths = {f"description_p{int(q * 100)}": q for q in (0.25, 0.5, 0.75)}
    one = rows.sparkSession.range(1).select()
    middle = one.join(F.broadcast(exact_percentiles(at, [], "_length", lengths).select(*lengths)), F.lit(True), "left")  # one row
    return reduce(
        DataFrame.unionByName,
        [
            _long(at.agg(*(v.alias(k) for k, v in measures.items())), s),
            _long(middle, s),
            _keyed(value_counts(at, "_c"), s, "category", "_c"),
            _keyed(value_counts(at, "_audit"), s, "audit_category", "_audit"),
            _keyed(top_counts(at, "state_final", 10), s, "state", "state_final"),
        ],
    )
