"""The engine's own jobs on the driver's documents, read as records of facilities: every query here
goes through the operator that it stands for, from keyword evidence to scores, regions, audits and
review lists."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.places import coordinates
from sievemark.operators import audit, clean, evaluate, extractors, geography, proposals, regions, report, review, sampling, scoring, signals
from sievemark.operators.profile import directory_profile, facility_profile, indicator_profile, run_counters
from sievemark.policy import EvidenceWeights, Keywords, Policy, Thresholds
from sievemark.sources.tables import spread, written

QUERIES: dict = {}
#: Keyword groups for documents, in place of the facility vocabulary.
RECORD_POLICY = Policy(
    keywords=Keywords(
        explicit_icu=(r"licen[sc]e", r"copyright"), equipment=(r"[0-9]{3}-[0-9]{4}",), procedure=(r"https?://", r"version"), staffing=(r"[a-z]+@[a-z]+",), specialty_context=(r"public",),
        negation=(r"all\s+rights\s+reserved",), subtypes={"cardiac_icu": ("apache", "gpl"), "neonatal_icu": ("mit",), "surgical_icu": ("public",)},
        service_verbs=("released",), unit_statements=("under",), operational_details=("version",), cross_organization=("creative",), bed_count=(r"version\s+(\d{1,4})", r"(\d{1,4})\.\d"),
    )
)
OTHER_THRESHOLDS = Policy(thresholds=Thresholds(high_evidence=60, low_evidence=20, sufficient_completeness=50))

#: The present policy, one with other weights and thresholds, and one with other keyword groups.
POLICIES = {
    "present": RECORD_POLICY,
    "other_weights": replace(RECORD_POLICY, evidence_weights=EvidenceWeights(explicit_claim=25, equipment=30, procedure=10, negation_penalty=15), thresholds=Thresholds(high_evidence=40, low_evidence=10, sufficient_completeness=60)),
    "other_words": replace(RECORD_POLICY, keywords=replace(RECORD_POLICY.keywords, explicit_icu=(r"copyright", r"public"), equipment=(r"[0-9]{3}-[0-9]{4}", r"https?://"), staffing=(r"licen[sc]e",), specialty_context=(r"apache",), negation=(r"creative",))),
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(c: Column) -> Column:
    return c.cast("bigint")


def joined(c: Column) -> Column:
    return F.array_join(c, "+")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records: the text as description, lines that hold a mail address, a link or a
    number as the list fields, and facts from the labels."""
    d = spread(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id", "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # no pattern spans lines, so a text without a match has no such line
    having = lambda p: F.when(F.col("text").rlike(p), F.filter(lines, lambda x: x.rlike(p))).otherwise(F.array().cast("array<string>"))
    size = F.coalesce("n_chars", F.lit(0))
    kind = F.pmod(size, F.lit(7))
    title = F.when(kind == 0, "Dr.").when(kind == 1, "City hospital").when(kind == 2, "Lab").when(kind == 3, "Dental hospital").when(kind == 4, "Eye hospital")
    return d.select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("unique_id"),
        F.concat_ws(" ", title, "source", size.cast("string")).alias("name"),
        F.col("lang").alias("organization_type"), F.col("source").alias("address_city"), F.col("text").alias("description"),
        having("@").alias("capability"), F.array().cast("array<string>").alias("specialties"), having("https?://|version").alias("procedure"), having("[0-9]{3}-[0-9]{4}").alias("equipment"),
        F.concat(F.lit('["https://example.org/'), F.col("source"), F.lit('"]')).alias("source_urls"),
        F.when(size % 3 != 0, size % 200).cast("int").alias("capacity_int"), F.col("quality").cast("int").alias("number_doctors_int"),
        F.when(size % 5 == 0, "missing").when(size % 5 == 1, "out_of_range").otherwise("ok").alias("coord_status"),
        F.col("lang").alias("state_final"), F.when(size % 11 != 0, F.col("source")).alias("district_final"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("geo_conflict"), F.col("lang").alias("state_from_field"), F.lit("xx").alias("state_from_pin"), F.lit("pin_directory").alias("geo_source"),
        size.cast("double").alias("lat_parsed"), F.coalesce(F.col("quality"), F.lit(0)).cast("double").alias("lon_parsed"),
    )


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.scored(records(spark, sf), RECORD_POLICY, listed=True)


def judged_once(spark: SparkSession, sf: str, fragments: bool = False) -> DataFrame:
    """The scored records without their texts, written: for jobs that read them several times, as a sort does
    that samples its ranges first."""
    return written(judged(spark, sf).drop("items", *(() if fragments else ("fragments",)), "description", "capability", "specialties", "procedure", "equipment"), "judged")


def _sections(df: DataFrame) -> DataFrame:
    return df.select("section", "metric", "key", F.round("value", 3).alias("value"))


def _districts(rows: DataFrame) -> DataFrame:
    return regions.rollup(rows, "district", RECORD_POLICY)


@query
def q_records_scored(spark, sf):
    s = judged(spark, sf)
    return s.select(
        "unique_id", big(F.col("capability_evidence_score")).alias("evidence"), big(F.col("data_completeness_score")).alias("completeness"), "classification",
        big(F.col("n_corroboration_categories")).alias("n_categories"), "description_corroboration", "is_name_duplicate", "explicit_icu_claim", big(F.col("icu_bed_count")).alias("beds"),
        joined(F.col("icu_subtypes")).alias("subtypes"), joined(F.col("supporting_fields")).alias("fields"), joined(F.col("corroboration_categories")).alias("categories"),
        joined(F.array_sort(F.transform("validation_flags", lambda f: f["name"]))).alias("flags"), joined(F.array_sort(F.map_keys("evidence_components"))).alias("evidence_parts"),
        joined(F.array_sort(F.map_keys("completeness_components"))).alias("completeness_parts"), big(F.size("fragments")).alias("n_fragments"), big(F.size("missing_evidence")).alias("n_missing"),
    )


@query
def q_records_fragments(spark, sf):
    return judged(spark, sf).select("unique_id", F.explode("fragments").alias("f")).select("unique_id", F.col("f.field").alias("field"), F.col("f.group").alias("signal"), F.col("f.pattern").alias("pattern"), F.col("f.text").alias("fragment"))


@query
def q_validator_flags(spark, sf):
    f = judged(spark, sf).select(F.explode("validation_flags").alias("f"))
    return f.groupBy(F.col("f.name").alias("name"), F.col("f.severity").alias("severity")).agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_judgeability(spark, sf):
    out = audit.judgeability(judged(spark, sf), RECORD_POLICY)
    return out.select(*(big(F.col(c)).alias(c) for c in out.columns))


@query
def q_gap_audit(spark, sf):
    return _sections(audit.gap_records(judged_once(spark, sf)))


@query
def q_trusted_audit(spark, sf):
    return _sections(audit.trusted_records(judged_once(spark, sf, fragments=True), RECORD_POLICY))


@query
def q_barely_trusted(spark, sf):
    return audit.barely_trusted(judged_once(spark, sf), RECORD_POLICY).select("unique_id", big(F.col("capability_evidence_score")).alias("evidence"))


@query
def q_regional_audit(spark, sf):
    rows = judged_once(spark, sf)
    return _sections(audit.regional(rows, regions.rollup(rows, "state", RECORD_POLICY), _districts(rows)))


@query
def q_boundary(spark, sf):
    at = written(judged(spark, sf).where(audit.boundary_population(RECORD_POLICY)), "boundary")
    return _sections(audit.boundary_summary(at, RECORD_POLICY))


@query
def q_report(spark, sf):
    """The whole audit: records are scored once, and one grouping adds up all measures."""
    return _sections(report.fused(written(report.facts(judged(spark, sf), RECORD_POLICY), "facts"), RECORD_POLICY))


@query
def q_priority_worklist(spark, sf):
    rows = judged_once(spark, sf)
    status = _districts(rows).select(F.col("state").alias("_s"), F.col("district").alias("_d"), "region_status")
    named = rows.join(status.hint("merge"), (F.coalesce("state_final", F.lit("(unassigned)")) == F.col("_s")) & (F.coalesce("district_final", F.lit("(unassigned)")) == F.col("_d")))
    out = review.priority_worklist(named, ["_s", "_d"], 5, RECORD_POLICY)
    return out.select(F.col("_s").alias("state"), F.col("_d").alias("district"), big(F.col("priority")).alias("priority"), "unique_id", "facility_context")


@query
def q_facility_table(spark, sf):
    out = review.facility_table(judged_once(spark, sf), ("Trusted ICU Coverage", "Needs Human Review"))
    return out.select("id", "name", "status", big(F.col("evidence")).alias("evidence"), big(F.col("completeness")).alias("completeness"), "city")


@query
def q_candidates(spark, sf):
    rows = judged_once(spark, sf)
    out = review.candidates(rows, 3, districts=_districts(rows))
    return out.select("label", big(F.col("rank")).alias("rank"), "unique_id")


@query
def q_operational(spark, sf):
    o = review.operational_data(judged(spark, sf))
    parts = ("location_resolved", "source_or_provenance", "total_capacity", "doctor_count", "anchored_icu_bed_count", "icu_operational_detail")
    return o.groupBy("operational_level", "operational_source_warning").agg(big(F.count(F.lit(1))).alias("n"), *(big(F.count_if(F.col(f"operational.{p}"))).alias(p) for p in parts))


@query
def q_trust_gates(spark, sf):
    g = review.trust_gates(judged(spark, sf), RECORD_POLICY).select(F.posexplode("trust_gates").alias("gate", "g"))
    return g.groupBy(big(F.col("gate")).alias("gate")).agg(big(F.count_if(F.col("g.met"))).alias("met"), big(F.count_if(~F.col("g.met"))).alias("open"))


@query
def q_assessment(spark, sf):
    a = review.assessment(judged(spark, sf))
    return a.groupBy("assessment", "status_label", "first_flag").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_policy_change(spark, sf):
    return scoring.migrations(scoring.what_if(judged(spark, sf), OTHER_THRESHOLDS)).select("classification", "other_classification", big(F.col("n")).alias("n"))


@query
def q_policy_sweep(spark, sf):
    """Every record under three whole policies, from one extraction."""
    book = written(signals.ledger(records(spark, sf), POLICIES, listed=True), "signals")
    out = signals.scored_under(book, POLICIES)
    return out.select("unique_id", "policy", big(F.col("evidence")).alias("evidence"), big(F.col("completeness")).alias("completeness"), big(F.col("n_categories")).alias("n_categories"), big(F.col("icu_bed_count")).alias("beds"), "described", "classification")


@query
def q_policy_moves(spark, sf):
    book = written(signals.ledger(records(spark, sf), POLICIES, listed=True), "signals")
    return signals.moves(signals.scored_under(book, POLICIES), "present")


@query
def q_extractors(spark, sf):
    """The records by the engine's keyword scan and by a plug-in over Arrow batches."""
    plugin = extractors.plugged(extractors.keyword_plugin(RECORD_POLICY.keywords), RECORD_POLICY, listed=True)
    out = None
    for name, extractor in (("keywords", None), ("arrow", plugin)):
        s = scoring.scored(records(spark, sf), RECORD_POLICY, extractor, listed=True)
        one = s.select(F.lit(name).alias("extractor"), "unique_id", big(F.col("capability_evidence_score")).alias("evidence"), "classification", big(F.size("fragments")).alias("n_fragments"), joined(F.array_sort(F.transform("fragments", lambda f: F.concat_ws(":", f["field"], f["group"], f["pattern"])))).alias("found"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def q_run_summary(spark, sf):
    """An evaluation run over the records: agreement with another policy's classes and with the labels."""
    rows = written(scoring.what_if(judged(spark, sf), OTHER_THRESHOLDS).select("unique_id", "classification", "other_classification", "number_doctors_int", "icu_subtypes", "capacity_int", "geo_conflict", "organization_type"), "run")
    human = F.when(F.col("number_doctors_int") == 1, "Trusted ICU Coverage").when(F.col("number_doctors_int") == 0, "Likely Medical Gap").otherwise("")
    run = rows.select("classification", F.when(F.col("organization_type") != "de", F.col("other_classification")).alias("model_classification"), human.alias("human_label"), F.col("capacity_int").cast("double").alias("latency_ms"))
    s = evaluate.run_summary(run, rows.where("geo_conflict"), rows.where("organization_type = 'fr'"))
    e = evaluate.error_rate(rows, rows.where("geo_conflict"))
    numbers = ("rows", "model_pairs", "model_agreement_pct", "human_pairs", "human_agreement_pct", "false_trusted", "false_gap", "mean_latency_ms", "total_latency_ms", "errors", "quarantined")
    cells = lambda t, section, names: t.select(F.inline(F.array(*(F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), 3).alias("value")) for n in names))))
    kinds = evaluate.subtype_distribution(rows).select(F.lit("subtypes").alias("section"), F.col("subtype").alias("metric"), F.col("n").cast("double").alias("value"))
    return cells(s, "run", numbers).unionByName(cells(e, "requests", ("requested", "errors", "error_pct"))).unionByName(kinds)


@query
def q_district_centroids(spark, sf):
    rows = judged_once(spark, sf)
    c = regions.district_centroids(rows, _districts(rows))
    return c.select("state", "district", big(F.col("facility_count")).alias("facility_count"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), big(F.col("n_located")).alias("n_located"))


@query
def q_planning_example(spark, sf):
    rows = review.with_context(judged_once(spark, sf))
    return regions.example_regions(_districts(rows), rows).select("region_status", "state", "district", big(F.col("facility_count")).alias("facility_count"))


@query
def q_region_options(spark, sf):
    return regions.options(records(spark, sf))


@query
def q_excerpts(spark, sf):
    s = judged(spark, sf).withColumn("excerpt", sampling.excerpt(F.col("fragments"), F.col("description")))
    return s.select("unique_id", F.sha2("excerpt", 256).alias("excerpt_sha"), big(F.char_length("excerpt")).alias("length"))


@query
def q_single_state(spark, sf):
    return sampling.restricted(records(spark, sf), "en").groupBy("district_final").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_text_blocks(spark, sf):
    from sievemark.operators.evidence import text_items

    r = records(spark, sf).withColumn("block", proposals.text_block(text_items(listed=True)))
    return r.select("unique_id", F.sha2("block", 256).alias("block_sha"))


# -- geography -----------------------------------------------------------------------------------


def directory(spark: SparkSession, sf: str) -> DataFrame:
    """The order lines as a postal directory, all text: parts as codes, some of them unreadable."""
    lines = spread(table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"))
    state = F.when(F.col("l_returnflag") == "A", "KERALA").when(F.col("l_returnflag") == "N", "Orissa").otherwise("Government of Delhi")
    return lines.select(
        F.concat(F.when(F.col("l_linenumber") == 7, "x").otherwise(""), (F.lit(600000) + F.col("l_partkey") % 300000).cast("string")).alias("pincode"), state.alias("statename"),
        F.when(F.col("l_linestatus") == "O", "24-parganas NORTH").otherwise("ernakulam").alias("district"), F.col("l_quantity").cast("string").alias("latitude"),
        F.when(F.col("l_linenumber") == 6, "NA").otherwise((F.col("l_quantity") + 60).cast("string")).alias("longitude"),
    )


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    state = F.when(F.col("c_mktsegment") == "BUILDING", "kerala").when(F.col("c_mktsegment") == "MACHINERY", "U.P.").when(F.col("c_mktsegment") == "AUTOMOBILE", "Mumbai").otherwise("Jammu & Kashmir")
    return c.select(
        F.concat(F.lit("fac-"), F.col("c_custkey").cast("string")).alias("unique_id"), F.concat(F.lit("6 "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")).alias("address_zipOrPostcode"),
        state.alias("address_stateOrRegion"), F.col("c_acctbal").cast("string").alias("latitude"), F.col("c_nationkey").cast("string").alias("longitude"), F.concat(F.lit("1,"), F.lpad((F.col("c_nationkey") * 10).cast("string"), 3, "0")).alias("capacity"), F.lit("n/a").alias("numberDoctors"),
    )


@query
def q_modal_rollup(spark, sf):
    r = geography.postal_rollup(directory(spark, sf))
    return r.select("pincode_clean", "pin_state", "pin_district", F.round("pin_lat", 4).alias("pin_lat"), F.round("pin_lon", 4).alias("pin_lon"), *(big(F.col(c)).alias(c) for c in ("n_offices", "n_valid_coords", "n_states_seen")))


@query
def q_geography(spark, sf):
    g = geography.assign_geography(facilities(spark, sf), geography.postal_rollup(directory(spark, sf)))
    return g.groupBy("state_final", "district_final", "geo_source", "geo_conflict", "state_from_field", "state_field_method").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_value_status(spark, sf):
    c = table(spark, sf, "customer")
    point = coordinates(F.when(F.col("c_mktsegment") != "BUILDING", (F.col("c_acctbal") / 100).cast("string")), F.when(F.col("c_mktsegment") != "BUILDING", F.when(F.col("c_nationkey") == 3, "east").otherwise((F.col("c_nationkey") + 60).cast("string"))))
    return c.select("c_nationkey", point.alias("p")).groupBy("c_nationkey", F.col("p.status").alias("status")).agg(big(F.count(F.lit(1))).alias("n"), big(F.count("p.lat")).alias("with_lat"))


@query
def q_facility_profile(spark, sf):
    return facility_profile(facilities(spark, sf)).select("metric", big(F.col("value")).alias("value"))


@query
def q_directory_profile(spark, sf):
    d = directory_profile(directory(spark, sf))
    return d.select(*(big(F.col(c)).alias(c) for c in d.columns))


def _indicators(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_name").alias("district_name"), F.when(F.col("p_size") % 2 == 0, "TAMILNADU").otherwise("West  Bengal").alias("state_ut"), F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("a"),
        F.when(F.col("p_size") % 3 == 0, "*").when(F.col("p_size") % 3 == 1, "no data").otherwise(F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"))).alias("b"),
    )


@query
def q_indicators(spark, sf):
    i = clean.clean_indicators(_indicators(spark, sf))
    return i.groupBy("state_raw", "state").agg(big(F.count(F.lit(1))).alias("n"), big(F.count("district_name")).alias("named"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))


@query
def q_indicator_profile(spark, sf):
    p = indicator_profile(_indicators(spark, sf))
    return p.select(*(big(F.col(c)).alias(c) for c in p.columns))


@query
def q_typed(spark, sf):
    t = clean.typed(facilities(spark, sf))
    return t.groupBy("coord_status", "capacity_int").agg(big(F.count(F.lit(1))).alias("n"), big(F.count("number_doctors_int")).alias("doctors")).select("coord_status", big(F.col("capacity_int")).alias("capacity"), "n", "doctors")


@query
def q_duplicate_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.substring("p_name", 1, 6)).alias("name"), "p_brand")
    return clean.duplicate_keys(p, ["name", "p_brand"], "twice").select("p_partkey", "twice")


@query
def q_run_counters(spark, sf):
    rows = judged_once(spark, sf)
    return run_counters(table(spark, sf, "documents"), rows, rows).select("metric", F.round("value", 3).alias("value"))


# -- evaluation and proposals --------------------------------------------------------------------


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    rows = judged_once(spark, sf).select("unique_id", "classification", joined(F.col("icu_subtypes")).alias("extractor_subtypes"), "number_doctors_int", F.col("organization_type").alias("audit_category"), "geo_conflict")
    human = F.when(F.col("number_doctors_int") == 1, "Trusted ICU Coverage").when(F.col("number_doctors_int") == 0, "Likely Medical Gap").otherwise("")
    subtype = F.when(F.col("geo_conflict"), "cardiac_icu").when(F.col("number_doctors_int").isNotNull(), "general")
    return rows.select("unique_id", "audit_category", "extractor_subtypes", human.alias("human_expected_classification"), F.col("classification").alias("current_classification"), subtype.alias("subtype"))


@query
def q_category_errors(spark, sf):
    out = evaluate.by_category(_reviewed(spark, sf))
    return out.select("audit_category", big(F.col("rows")).alias("n_rows"), "agreement_pct", big(F.col("false_trusted")).alias("false_trusted"), big(F.col("false_gap")).alias("false_gap"))


@query
def q_subtype_mismatches(spark, sf):
    return evaluate.subtype_mismatches(_reviewed(spark, sf))


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    """A model's claims about the documents: the first line that names a licence as a quote, a quote
    that isn't there, and one that says too little."""
    r = records(spark, sf)
    licence = "(?i)licen[sc]e"
    quote = F.when(F.col("description").rlike(licence), F.get(F.filter(F.split("description", "\n"), lambda x: x.rlike(licence)), F.lit(0)))
    fragment = lambda group, q: F.struct(F.lit("description").alias("field"), F.lit(group).alias("group"), q.alias("quote"))
    return r.where("description is not null").select(
        "unique_id", quote.isNotNull().alias("explicit_icu_claim"), F.when(F.col("number_doctors_int") == 1, 7).cast("int").alias("icu_bed_count"), F.array(F.lit("cardiac_icu")).alias("icu_subtypes"),
        F.array_compact(F.array(F.when(quote.isNotNull(), fragment("explicit_icu", F.regexp_replace(quote, " ", "  "))), fragment("equipment", F.lit("not in any text, surely")), F.when(F.col("geo_conflict"), fragment("staffing", F.regexp_extract("description", r"[^ \t-\r]+", 0))))).alias("fragments"),
        F.array().cast("array<string>").alias("unclear_claims"), F.lit("").alias("explanation"),
    )


@query
def q_proposals_verified(spark, sf):
    r = records(spark, sf).withColumns({c: F.to_json(c) for c in ("capability", "specialties", "procedure", "equipment")})
    v = proposals.scored_proposals(r, _proposals(spark, sf), RECORD_POLICY)
    return v.select("unique_id", big(F.col("verified_fragments")).alias("verified"), big(F.col("dropped_fragments")).alias("dropped"), big(F.col("low_information_fragments")).alias("low"), "explicit_icu_claim")


@query
def q_batch_inputs(spark, sf):
    b = proposals.batch_inputs(records(spark, sf), "unique_id", 20)
    return b.select(big(F.col("batch_id")).alias("batch_id"), big(F.col("n")).alias("n"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))
