"""Review worklists and what a reviewer is told about a record. Order and wording only: nothing here
changes a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.names import CONTEXT_RANK, class_label, context, context_rank, looked_up, scope_key, subtype_label
from sievemark.functions.text import humanized, list_items
from sievemark.policy import CLASSES, GAP, GENERAL_SUBTYPE, INSUFFICIENT, REGION_DESERT, REGION_GAP, REGION_TRUSTED, REVIEW, SUSPICIOUS, TRUSTED, Policy

REASONS = {
    "near_trusted": "Strong evidence, one corroboration category short - verify first",
    "review": "Unresolved claims need human verification",
    "trusted_flagged": "Trusted record with open data-quality flags",
    "trusted": "Trusted record, confirm it is current",
    "gap": "Judgeable record without evidence in a potential planning gap",
}
RESOLVED = {TRUSTED: "resolved", GAP: "resolved", REVIEW: "unresolved", INSUFFICIENT: "unresolved"}


def with_context(rows: DataFrame) -> DataFrame:
    return rows.withColumn("facility_context", context(F.col("name"), F.col("organization_type")))


def review_rank(policy: Policy = Policy()) -> Column:
    """Within the review class: 0 near trust, 1 strong but suspicious, 2 ambiguous, 3 contradictory."""
    high = F.col("capability_evidence_score") >= policy.thresholds.high_evidence
    suspicious = F.exists("validation_flags", lambda f: f["severity"] == SUSPICIOUS)
    return F.when(F.col("n_contradiction_flags") > 0, 3).when(high & suspicious, 1).when(high & F.col("explicit_icu_claim"), 0).otherwise(2)


def ranked_worklist(rows: DataFrame, region: list[str], tier: Column, order: list[Column], id_column: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each region by tier, then by ``order``, then by id; rows without
    a tier are left out. All regions in one job."""
    w = Window.partitionBy(*region).orderBy("_tier", *order, id_column)
    named = rows.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    return named.withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= limit).drop("_tier")


def priority_worklist(rows: DataFrame, region: list[str], limit: int = 5, policy: Policy = Policy()) -> DataFrame:
    """Who to look at first in each region: unresolved reviews, trusted records with flags, other
    trusted ones, and in planning-gap regions (``region_status`` of the row) records without
    evidence; within each by name context. Adds ``priority`` and ``priority_reason``."""
    work = with_context(rows).withColumns({"_review": review_rank(policy), "_context": context_rank(context(F.col("name"), F.col("organization_type")))})
    c, flags = F.col("classification"), F.col("n_validation_flags")
    tier = F.when(c == REVIEW, 1).when((c == TRUSTED) & (flags > 0), 2).when(c == TRUSTED, 3).when((c == GAP) & (F.col("region_status") == REGION_GAP), 4)
    reason = (
        F.when((c == REVIEW) & (F.col("_review") == 0), REASONS["near_trusted"])
        .when(c == REVIEW, REASONS["review"])
        .when((c == TRUSTED) & (flags > 0), REASONS["trusted_flagged"])
        .when(c == TRUSTED, REASONS["trusted"])
        .otherwise(REASONS["gap"])
    )
    strength = F.when(c == GAP, F.col("data_completeness_score")).when((c == TRUSTED) & (flags > 0), flags).otherwise(F.col("capability_evidence_score"))
    order = [F.when(c == REVIEW, F.col("_review")), F.col("_context"), -strength]
    once = ranked_worklist(work, region, tier, order, "unique_id", limit)
    return once.withColumn("priority_reason", reason).drop("_review", "_context")


def facility_table(rows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """The records of the chosen classes with display labels, the strongest first."""
    shown = rows.where(F.col("classification").isin(*classes)).withColumn("status", class_label(F.col("classification")))
    return shown.orderBy(F.desc("capability_evidence_score"), F.desc("data_completeness_score"), "unique_id").select(
        F.col("unique_id").alias("id"), "name", "status", F.col("capability_evidence_score").alias("evidence"), F.col("data_completeness_score").alias("completeness"), F.col("address_city").alias("city")
    )


def labelled_candidates(rows: DataFrame, labels: dict[str, Column], order: list[Column], per_label: int = 3) -> DataFrame:
    """The first rows under each label's predicate; a row may stand under several."""
    tagged = rows.withColumn("label", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in labels.items())))))
    w = Window.partitionBy("label").orderBy(*order)
    return tagged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_label)


def candidates(rows: DataFrame, per_label: int = 3, districts: DataFrame | None = None) -> DataFrame:
    """Records that show each kind: trusted general, review, and one subtype only. With ``districts``
    (their summary) also the largest districts of three kinds, as ``state/district`` in the id column:
    too little to judge, a planning gap, and trust that hangs on one record."""
    c = F.col("classification")
    labels = {"trusted_general": (c == TRUSTED) & F.array_contains("icu_subtypes", GENERAL_SUBTYPE), "review": c == REVIEW}
    labels |= {f"only_{s}": (F.size("icu_subtypes") == 1) & F.array_contains("icu_subtypes", s) for s in ("neonatal_icu", "pediatric_icu", "cardiac_icu", "medical_icu", "surgical_icu")}
    found = labelled_candidates(rows, labels, [F.desc("capability_evidence_score"), F.col("unique_id")], per_label)
    if districts is None:
        return found
    status = F.col("region_status")
    kinds = {
        "data_desert_district": (status == REGION_DESERT) & (F.col("facility_count") > 0), "planning_gap_district": status == REGION_GAP,
        "single_trusted_district": (status == REGION_TRUSTED) & (F.col("trusted_icu_count") == 1),
    }
    places = labelled_candidates(districts.withColumn("unique_id", scope_key(F.col("state"), F.col("district"))), kinds, [F.desc("facility_count"), F.col("unique_id")], per_label)
    return found.unionByName(places.select("label", "rank", "unique_id"), allowMissingColumns=True)


def operational_data(rows: DataFrame) -> DataFrame:
    """Six things a planner can check, how many there are, and the level: High from five, Medium from
    three, Low below."""
    located = (F.col("coord_status") == "ok") | (F.col("state_final").isNotNull() & F.col("district_final").isNotNull())
    parts = {
        "location_resolved": located,
        "source_or_provenance": F.size(list_items(F.col("source_urls"))) > 0,
        "total_capacity": F.col("capacity_int").isNotNull(),
        "doctor_count": F.col("number_doctors_int").isNotNull(),
        "anchored_icu_bed_count": F.col("icu_bed_count").isNotNull(),
        "icu_operational_detail": F.size(F.array_intersect("corroboration_categories", F.array(*(F.lit(g) for g in ("equipment", "procedure", "staffing"))))) > 0,
    }
    available = sum((p.cast("int") for p in parts.values()), F.lit(0))
    general = F.array_contains("icu_subtypes", GENERAL_SUBTYPE)
    beds = F.when(F.col("icu_bed_count").isNull(), "No bed count anchored to ICU context.").otherwise(
        F.concat(
            F.format_string("%d beds anchored in intensive-care context", F.col("icu_bed_count")),
            F.when((F.size("icu_subtypes") > 0) & ~general, F.concat(F.lit("; subtype evidence only: "), F.array_join(F.transform("icu_subtypes", subtype_label), ", "))).otherwise(""),
        )
    )
    return rows.withColumns(
        {
            "operational": F.struct(*(v.alias(k) for k, v in parts.items())),
            "operational_available": available,
            "operational_level": F.when(available >= 5, "High").when(available >= 3, "Medium").otherwise("Low"),
            "operational_beds": beds,
            "operational_source_warning": F.exists("validation_flags", lambda f: f["name"] == "directory_or_partner_content_detected"),
        }
    )


def trust_gates(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The six gates to trust, each met or not, and a line on corroboration."""
    t = policy.thresholds
    n, described = F.col("n_corroboration_categories"), F.col("description_corroboration")
    gate = lambda label, met: F.struct(F.lit(label).alias("label"), met.alias("met"))
    gates = F.array(
        gate("Data: full enough to judge", F.col("data_completeness_score") >= t.sufficient_completeness),
        gate("Claim: stated in so many words", F.col("explicit_icu_claim")),
        gate("Evidence: at the bar or above", F.col("capability_evidence_score") >= t.high_evidence),
        gate("Denial: none in the record", F.col("n_contradiction_flags") == 0),
        gate("Doubt: no suspicious claim", ~F.exists("validation_flags", lambda f: f["severity"] == SUSPICIOUS)),
        gate("Backing: enough kinds of evidence", (n >= t.min_corroboration_categories) | (described & (n >= 1))),
    )
    names = F.array_join("corroboration_categories", " + ")
    line = (
        F.when(n >= t.min_corroboration_categories, F.concat(F.lit("Backed by "), names))
        .when(described & (n >= 1), F.concat(F.lit("Backed by the description's own statement and "), names, F.lit(", as policy v2 allows")))
        .otherwise(F.concat(n.cast("string"), F.lit(f" kinds of evidence stand beside the claim, {t.min_corroboration_categories} are asked"), F.when(n > 0, F.concat(F.lit(" ("), names, F.lit(")"))).otherwise("")))
    )
    return rows.withColumns({"trust_gates": gates, "corroboration_line": line})


#: What a reader is told beside the label; other classes than the four are named as unknown.
HEADLINES = {
    TRUSTED: "Settled: trusted evidence", GAP: "Settled: nothing found in a record that can be judged",
    REVIEW: "Open: a person has to look", INSUFFICIENT: "Open: too little data",
}
HELP = {
    TRUSTED: "The record meets every requirement for trust. It says what was recorded, not what runs today.",
    GAP: "The record is full enough to judge and holds no credible evidence. That is no proof of absence.",
    REVIEW: "The rules could not settle this record; the reason and the flags say why.",
    INSUFFICIENT: "The record holds too little to find evidence or its absence.",
}


def assessment(rows: DataFrame) -> DataFrame:
    """Whether the class settles the record, its label, headline and help, and the first flag in words."""
    c = F.col("classification")
    return rows.withColumns(
        {
            "assessment": looked_up(c, RESOLVED, F.lit("unresolved")),
            "status_label": class_label(c),
            "headline": looked_up(c, HEADLINES, F.concat(F.lit("Open: unknown class "), F.coalesce(c, F.lit("(none)")))),
            "help": looked_up(c, HELP, F.lit("The class is none of the four.")),
            "first_flag": humanized(F.get("validation_flags", F.lit(0))["name"]),
        }
    )


CONTEXT_ORDER = tuple(sorted(CONTEXT_RANK, key=CONTEXT_RANK.get))
