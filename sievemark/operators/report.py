"""The whole audit in one aggregation: every record hands out small cells, one for each measure that it
counts in, and a single grouping adds up all of them. The measures of regions come from one grouping by
both levels. Percentiles come from the counts of the values. Same rows as the parts of ``audit``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.names import NOT_HOSPITALS, audit_category
from sievemark.operators.audit import QUANTILES, boundary_population, judgeable
from sievemark.operators.quantiles import exact_percentiles
from sievemark.operators.regions import both_levels
from sievemark.operators.scoring import substantive
from sievemark.policy import GAP, GENERAL_SUBTYPE, TRUSTED, UNASSIGNED, Policy
from sievemark.sources.tables import written

#: Only the first few values of these are shown.
TOP = {("gap_records", "organization_type"): 10, ("gap_records", "district"): 20, ("boundary", "state"): 10}
#: These are shares of the records that they stand for, not counts.
SHARES = {("gap_records", "pct_hospital_like"): 100.0, ("gap_records", "pct_clearly_non_hospital"): 100.0, ("regional", "non_hospital_share"): 1.0}
DOMINANT, DOMINANT_TOP = 0.5, 20
BIN, BINS = 10.0, 10
STATS = ("judgeability_completeness", "gap_records_completeness", "gap_records_evidence")
LENGTHS = (0.25, 0.5, 0.75)


def facts(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """What the report needs of scored records: no texts, some thirty narrow columns. Written once, it
    serves all groupings."""
    has_field = lambda name: F.exists("items", lambda x: x["field"] == name)
    signals = lambda g: F.size(f"{g}_signals") > 0
    rest = F.aggregate(F.map_values(F.map_filter("completeness_components", lambda k, _: ~k.isin("procedure", "equipment"))), F.lit(0), lambda a, x: a + x)
    claim = lambda f: f["group"] == "explicit_icu"
    claimed = F.array_distinct(F.transform(F.filter("fragments", claim), lambda f: f["field"]))
    combination = lambda c: F.array_join(F.array_sort(c), "+")
    in_text = F.exists("fragments", lambda f: claim(f) & (f["field"] == "description"))
    return rows.select(
        "classification", "coord_status", "geo_source", "state_final", "district_final", "organization_type", "capability_evidence_score", "data_completeness_score", "n_corroboration_categories",
        audit_category(F.col("name"), F.col("organization_type")).alias("category"), F.col("capacity_int").isNotNull().alias("has_capacity"), F.col("number_doctors_int").isNotNull().alias("has_doctors"),
        F.map_contains_key("completeness_components", "source_url").alias("has_source"), signals("procedure").alias("procedure"), signals("equipment").alias("equipment"), F.col("explicit_icu_claim").alias("explicit"),
        (has_field("procedure") | has_field("equipment")).alias("generic"), rest.alias("rest"), combination(F.map_keys("completeness_components")).alias("components"), combination(F.col("corroboration_categories")).alias("categories"),
        combination(claimed).alias("claim_fields"), ((F.size(claimed) > 0) & (F.size(F.array_except(claimed, F.array(F.lit("capability"), F.lit("specialties")))) == 0)).alias("structured_only"),
        "icu_subtypes", F.transform("validation_flags", lambda f: f["name"]).alias("flags"), boundary_population(policy).alias("boundary"),
        F.when(boundary_population(policy), F.struct(
            F.char_length("description").alias("length"), F.get("corroboration_categories", F.lit(0)).alias("category"), in_text.alias("in_text"), F.col("description_claim").isNotNull().alias("moves_v2b"),
            F.exists("fragments", lambda f: claim(f) & (f["field"] == "description") & substantive(f["text"], policy)).alias("moves_v2a"),
            ((F.size("icu_subtypes") > 0) & ~F.array_contains("icu_subtypes", GENERAL_SUBTYPE)).alias("subtype_only"),
        )).alias("edge"),
    )


def _cells(policy: Policy) -> list[tuple[str, str, Column, Column | None, Column]]:
    """(section, metric, condition, key, number): what a record adds to."""
    yes, one = F.lit(True), F.lit(1.0)
    can, gap, trusted, edge = judgeable(policy), F.col("classification") == GAP, F.col("classification") == TRUSTED, F.col("boundary")
    c = F.col
    located = c("coord_status") == "ok"
    off = c("category").isin(*NOT_HOSPITALS)
    out = [("counts", m, yes, c(m), one) for m in ("classification", "coord_status", "geo_source")]
    of_can = {
        "judgeable": yes, "missing_capacity": ~c("has_capacity"), "missing_doctors": ~c("has_doctors"), "missing_source": ~c("has_source"), "missing_coordinates": ~located, "missing_district": c("district_final").isNull(),
        "no_relevant_procedure": ~c("procedure"), "no_relevant_equipment": ~c("equipment"), "no_explicit_claim": ~c("explicit"), "generic_content_only": c("generic") & ~c("procedure") & ~c("equipment") & ~c("explicit"),
        "judgeable_by_generated_only": c("rest") < policy.thresholds.sufficient_completeness,
    }
    out += [("judgeability", m, can & x, None, one) for m, x in of_can.items()] + [("judgeability", "components", can, c("components"), one)]
    out += [("gap_records", m, gap & x, None, one) for m, x in {"total": yes, "with_source": c("has_source"), "with_coordinates": located, "with_capacity": c("has_capacity")}.items()]
    out += [("gap_records", "pct_hospital_like", gap, None, (c("category") == "hospital_like").cast("double")), ("gap_records", "pct_clearly_non_hospital", gap, None, off.cast("double"))]
    out += [("gap_records", m, gap, k, one) for m, k in {"organization_type": F.substring("organization_type", 1, 40), "category": c("category"), "state": c("state_final"), "district": c("district_final")}.items()]
    t = policy.thresholds
    near = (c("capability_evidence_score") <= t.high_evidence + 5) | (c("n_corroboration_categories") <= t.min_corroboration_categories)
    out += [("trusted_records", m, trusted & x, None, one) for m, x in {"total": yes, "structured_claim_only": c("structured_only"), "barely_trusted": near}.items()]
    out += [("trusted_records", "categories", trusted, c("categories"), one), ("trusted_records", "claim_fields", trusted, c("claim_fields"), one)]
    out += [("regional", "non_hospital_share", c("district_final").isNotNull(), F.concat_ws("/", "state_final", "district_final"), off.cast("double"))]
    flagged = F.array_contains("flags", "directory_or_partner_content_detected")
    at = {"total": yes, "claim_in_description": c("edge.in_text"), "claim_only_structured": ~c("edge.in_text"), "with_directory_flag": flagged, "subtype_only": c("edge.subtype_only"), "moves_v2a": c("edge.moves_v2a"), "moves_v2b": c("edge.moves_v2b")}
    out += [("boundary", m, edge & x, None, one) for m, x in at.items()]
    out += [("boundary", m, edge, k, one) for m, k in {"category": c("edge.category"), "audit_category": c("category"), "state": c("state_final")}.items()]
    values = {STATS[0]: (can, "data_completeness_score"), STATS[1]: (gap, "data_completeness_score"), STATS[2]: (gap, "capability_evidence_score"), "description": (edge & c("edge.length").isNotNull(), "edge.length")}
    return out + [(s, "_value", cond, c(column).cast("string"), c(column).cast("double")) for s, (cond, column) in values.items()]


def fused(of: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The report from written ``facts``: section, metric, key, value."""
    cells = _cells(policy)
    cell = lambda s, m, key, x: F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), key.alias("key"), x.alias("x"))
    nil = F.lit(None).cast("string")
    single = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), cell(s, m, nil if key is None else F.coalesce(key.cast("string"), F.lit("(null)")), x)) for s, m, cond, key, x in cells)))
    trusted = F.col("classification") == TRUSTED
    kinds = F.when(F.size("icu_subtypes") > 0, F.col("icu_subtypes")).otherwise(F.array(F.lit("(none)")))
    lists = [F.when(trusted, F.transform(c, _in("trusted_records", m, cell))).otherwise(F.array()) for m, c in (("subtype", kinds), ("flag", F.col("flags")))]
    each = of.select(F.inline(F.concat(single, *lists)))
    sums = each.groupBy("section", "metric", "key").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("x"))
    # measures without a key are there with nothing to count, too
    blank = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), nil.alias("key"), F.lit(0.0).alias("n"), F.lit(0.0).alias("x")) for s, m, _, key, _ in cells if key is None))
    seeds = of.sparkSession.range(1).select(F.inline(blank))
    whole = sums.unionByName(seeds).groupBy("section", "metric", "key").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = written(whole, "report-cells")

    shown = whole.where(F.col("metric") != "_value")
    factor, top = F.lit(None).cast("double"), F.lit(None).cast("int")
    for (s, m), f in SHARES.items():
        factor = F.when((F.col("section") == s) & (F.col("metric") == m), F.lit(f)).otherwise(factor)
    for (s, m), k in TOP.items():
        top = F.when((F.col("section") == s) & (F.col("metric") == m), F.lit(k)).otherwise(top)
    value = F.when(factor.isNotNull(), factor * F.try_divide("x", "n")).otherwise(F.col("x"))
    dominant = F.col("metric") == "non_hospital_share"
    order = Window.partitionBy("section", "metric").orderBy(F.when(dominant, F.col("value")).desc(), F.desc("n"), "key")
    valued = shown.withColumns({"value": value, "_top": F.when(dominant, F.lit(DOMINANT_TOP)).otherwise(top)}).where(~dominant | (F.col("value") >= DOMINANT))
    few = valued.where(F.col("_top").isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_top"))
    parts = [t.select("section", "metric", "key", "value") for t in (valued.where(F.col("_top").isNull()), few)]

    values = whole.where(F.col("metric") == "_value").select("section", (F.col("x") / F.col("n")).alias("v"), F.col("n").cast("bigint").alias("times"))
    parts.append(_spread(values))
    regions = written(both_levels(of, policy).select("level", "state", "district", "region_status", "trusted_icu_count"), "report-regions")
    by_status = regions.groupBy(F.when(F.col("level") == "state", "states").otherwise("districts").alias("metric"), F.col("region_status").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts.append(by_status.select(F.lit("regional").alias("section"), "metric", "key", "value"))
    alone = regions.agg(F.count_if((F.col("level") == "district") & (F.col("trusted_icu_count") == 1) & (F.col("district") != UNASSIGNED)).cast("double").alias("value"))
    parts.append(alone.select(F.lit("regional").alias("section"), F.lit("single_trusted_districts").alias("metric"), nil.alias("key"), "value"))
    return reduce(DataFrame.unionByName, parts)


def _in(section: str, metric: str, cell):
    return lambda k: cell(section, metric, k, F.lit(1.0))


def _spread(values: DataFrame) -> DataFrame:
    """Count, mean, percentiles and bins of each section of counted ``values``."""
    p = exact_percentiles(values, ["section"], "v", {"median": 0.5, **{f"p{int(q * 100)}": q for q in QUANTILES}}, weight="times").drop("n")
    bin_of = F.least(F.floor(F.col("v") / BIN), F.lit(BINS - 1))
    sums = values.groupBy("section").agg(
        F.sum("times").cast("double").alias("n"), (F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("mean"), *(F.sum(F.when(bin_of == i, F.col("times")).otherwise(0)).cast("double").alias(f"bin_{i}") for i in range(BINS))
    )
    names = values.sparkSession.range(1).select(F.explode(F.array(*(F.lit(s) for s in (*STATS, "description")))).alias("section"))
    wide = names.join(sums.hint("merge"), "section", "left").join(p.hint("merge"), "section", "left").na.fill(0.0, ["n", *(f"bin_{i}" for i in range(BINS))])
    entry = lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
    names_of = ("n", "mean", "median", *(f"p{int(q * 100)}" for q in QUANTILES), *(f"bin_{i}" for i in range(BINS)))
    stats, lengths = F.array(*(entry(c, c) for c in names_of)), F.array(*(entry(f"description_p{int(q * 100)}", f"p{int(q * 100)}" if q != 0.5 else "median") for q in LENGTHS))
    is_length = F.col("section") == "description"
    rows = wide.select(F.when(is_length, F.lit("boundary")).otherwise(F.col("section")).alias("section"), F.explode(F.when(is_length, lengths).otherwise(stats)).alias("e"))
    return rows.select("section", F.col("e.metric").alias("metric"), F.lit(None).cast("string").alias("key"), F.col("e.value").alias("value"))
