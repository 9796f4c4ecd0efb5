"""The operators on the driver's tables: one query for each group of them, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions import text as txt
from sievemark.plans import record_queries
from sievemark.operators import audit, clean, evaluate, evidence, geography, ledger, profile, proposals, quotes, regions, review, sampling, scoring
from sievemark.sources.tables import shared_folder, spread
from sievemark.policy import CLASSES, GAP, INSUFFICIENT, REVIEW, TRUSTED, EvidenceWeights, Keywords, Policy, Thresholds

QUERIES: dict = dict(record_queries.QUERIES)
LICENCE, MAIL, NUMBER = "(?i)licen[sc]e", "@", "[0-9]{3}"
#: Keyword groups for the driver's documents, in place of the facility vocabulary.
DOC_KEYWORDS = Keywords(
    explicit_icu=(r"licen[sc]e", r"copyright"), equipment=(r"[0-9]{3}-[0-9]{4}",), procedure=(r"https?://", r"version"), staffing=(r"[a-z]+@[a-z]+",), specialty_context=(r"public",),
    negation=(r"all\s+rights\s+reserved",),
)
SENTENCES = (
    "A 20 bed ICU, with ventilators and BiPAP", "Critical care team and central oxygen", "There is no intensive care here", "The NICU and PICU have a multipara monitor", "Lacks an ICU", "criticalcare, resuscitation; intubation", "Anaesthesiologist for the critical",
    "mechanical   ventilation with CPAP, infusion pump", "a clinic", "CRITICAL\tCARE nurse, icu staff and an intensivist", "syringe pump; ECMO; defibrillator; oxygen pipeline",
)
DOC_POLICY = Policy(evidence_weights=EvidenceWeights(), thresholds=Thresholds())


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def big(c: Column) -> Column:
    return c.cast("bigint")


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def scored_docs(spark: SparkSession, sf: str, policy: Policy = DOC_POLICY) -> DataFrame:
    """The documents as if they were scored records: language as state, source as district."""
    text = F.coalesce("text", F.lit(""))
    d = labelled_docs(spark, sf).select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic",
        text.rlike(LICENCE).alias("licence"), text.contains(MAIL).alias("mail"), text.rlike(NUMBER).alias("number"), text.contains("\n").alias("lines"), F.char_length(text).alias("length"),
    )
    explicit, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    long = F.col("length") >= 1000
    w, c = policy.evidence_weights, policy.completeness_weights
    e = scoring.points(
        [
            ("explicit_claim", explicit, w.explicit_claim), ("equipment", long, w.equipment), ("procedure", F.col("number"), w.procedure), ("capacity", F.col("mail"), w.capacity),
            ("negation_penalty", toxic, -w.negation_penalty), ("suspicious_penalty", F.col("licence"), -w.suspicious_penalty),
        ]
    )
    k = scoring.points(
        [
            ("description", F.col("length") >= 300, c.description), ("procedure", F.col("lines"), c.procedure), ("equipment", F.col("quality").isNotNull(), c.equipment),
            ("staffing", F.col("lang") == "en", c.staffing), ("capacity", F.col("length") < 20000, c.capacity), ("source_url", F.col("source").isNotNull(), c.source_url), ("geography", F.col("lang").isNotNull(), c.geography),
        ]
    )
    a = d.withColumns(
        {
            "evidence_components": e, "completeness_components": k, "explicit": explicit, "toxic_flag": toxic,
            "categories": F.array_compact(F.array(F.when(long, "long"), F.when(F.col("mail"), "mail"), F.when(F.col("number"), "number"))),
        }
    )
    b = a.withColumns({"capability_evidence_score": scoring.clamped(F.col("evidence_components")), "data_completeness_score": scoring.clamped(F.col("completeness_components")), "n_categories": F.size("categories"), "described": (F.col("lang") == "en") & (F.col("length") >= 2000)})
    name, reason = scoring.classified(F.col("toxic_flag"), F.col("licence"), F.col("capability_evidence_score"), F.col("data_completeness_score"), F.col("explicit"), F.col("n_categories"), F.col("described"), policy)
    return b.withColumns({"classification": name, "classification_reason": reason})


# -- profiles ------------------------------------------------------------------------------------


@query
def q_null_profile(spark, sf):
    parts = [profile.null_profile(table(spark, sf, t), cols).withColumn("table_name", F.lit(t)) for t, cols in (("documents", ["text", "lang", "source"]), ("pages", ["url", "html"]), ("events", ["event_type", "props"]))]
    return union(parts).select("table_name", "column_name", *(big(F.col(c)).alias(c) for c in ("missing", "placeholder", "populated")), "pct_null_like")


SHAPES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


@query
def q_shape_check(spark, sf):
    return profile.shape_check({t: table(spark, sf, t) for t in SHAPES}, {t: (None, n) for t, n in SHAPES.items()})


@query
def q_duplicate_keys(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2(F.lower(txt.stripped(F.coalesce("text", F.lit("")))), 256).alias("text_key"))
    return profile.repeated_ids(d, "text_key").select("text_key", big(F.col("n_rows")).alias("n_rows"))


@query
def q_value_counts(spark, sf):
    o = table(spark, sf, "orders")
    return union([profile.value_counts(o, c).select(F.lit(c).alias("column_name"), F.col(c).alias("value"), big(F.col("n")).alias("n")) for c in ("o_orderstatus", "o_orderpriority")])


@query
def q_top_counts(spark, sf):
    return profile.top_counts(table(spark, sf, "part"), "p_brand", 10, 7).select("p_brand", big(F.col("n")).alias("n"))


# -- cleaning ------------------------------------------------------------------------------------


@query
def q_dedupe_most_complete(spark, sf):
    d = labelled_docs(spark, sf).select("text", "doc_id", "lang", "source", "n_chars", "quality", "toxic")
    one = clean.most_complete(d, "text", ["doc_id"], ["lang", "source", "n_chars", "quality", "toxic"])
    return clean.completeness_of(one, ["lang", "source", "n_chars", "quality", "toxic"]).select("doc_id", "lang", "quality", big(F.col("n_populated")).alias("n_populated"))


@query
def q_top_text_per_source(spark, sf):
    return sampling.top_per_stratum(table(spark, sf, "documents"), ["lang", "source"], "doc_id", 3).select("lang", "source", "doc_id")


@query
def q_number_from_text(spark, sf):
    e = table(spark, sf, "events").select("event_type", txt.whole_number(F.col("props")).alias("k"), txt.decimal_number(F.concat(F.lit("("), F.col("value").cast("string"), F.lit(")"))).alias("v"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), big(F.count_if(F.col("k").isNull())).alias("without_k"), F.round(F.sum("v"), 2).alias("sum_v"))


@query
def q_json_list(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), k, F.lit('", "n/a", " '), F.col("event_type"), F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('["'), k)).otherwise(F.lit("[]"))
    items = e.select(F.explode(txt.list_items(shown)).alias("item"))
    return items.groupBy("item").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_title_case(spark, sf):
    a = table(spark, sf, "customer").select(txt.title_case(F.col("c_mktsegment")).alias("name"))
    b = table(spark, sf, "part").select(txt.title_case(F.concat_ws("-", "p_name", F.lower("p_type"))).alias("name"))
    return a.union(b).distinct()


@query
def q_lookup_fallback(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")  # 25 rows in any scale
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    value, source, conflict = geography.fallback(F.when(F.col("o_custkey") % 7 != 0, F.col("n_name")), F.when(F.col("o_orderkey") % 3 != 0, F.col("r_name")), "lookup", "field")
    return j.groupBy(value.alias("place"), source.alias("place_source"), conflict.alias("conflict")).agg(big(F.count(F.lit(1))).alias("n"))


# -- evidence ------------------------------------------------------------------------------------


def _doc_fragments(spark, sf, windows: bool = True) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "text")).where(F.col("text").isNotNull())
    items = F.array(F.struct(F.lit("description").alias("field"), F.col("text").alias("text")))
    return d.select("doc_id", "lang", evidence.all_fragments(items, DOC_KEYWORDS, windows).alias("found"))


@query
def q_keyword_scan(spark, sf):
    f = _doc_fragments(spark, sf, windows=False).select("doc_id", "lang", F.explode("found").alias("f"))
    return f.groupBy("lang", F.col("f.group").alias("signal"), F.col("f.pattern").alias("pattern")).agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_negated_items(spark, sf):
    d = table(spark, sf, "documents")
    t = F.coalesce("text", F.lit(""))
    denied, claimed = t.rlike(txt.any_of(DOC_KEYWORDS.negation)), t.rlike(txt.any_of(DOC_KEYWORDS.explicit_icu))
    return d.groupBy("lang").agg(big(F.count_if(denied)).alias("denied"), big(F.count_if(claimed)).alias("claimed"), big(F.count_if(denied & claimed)).alias("suppressed"))


@query
def q_sentence_window(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike(LICENCE))
    return d.select("doc_id", evidence.sentence_window(F.col("text"), "licen[sc]e").alias("sentence")).withColumn("length", big(F.char_length("sentence")))


@query
def q_fragment_dedup(spark, sf):
    f = _doc_fragments(spark, sf).select("doc_id", F.explode(evidence.first_of_each(F.col("found"))).alias("f"))
    return f.select("doc_id", F.col("f.group").alias("signal"), F.col("f.pattern").alias("pattern"), F.col("f.text").alias("fragment"))


@query
def q_anchored_number(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    found = evidence.anchored_number(F.array("text"), (r"version\s+(\d{1,4})", r"(\d{1,4})\.\d"))
    return d.select("doc_id", big(found).alias("largest")).where("largest is not null")


@query
def q_score_components(spark, sf):
    s = scored_docs(spark, sf)
    return s.select("doc_id", big(F.col("capability_evidence_score")).alias("evidence"), big(F.col("data_completeness_score")).alias("completeness"), big(F.size("evidence_components")).alias("n_evidence"), big(F.size("completeness_components")).alias("n_completeness"))


@query
def q_classify(spark, sf):
    return scored_docs(spark, sf).groupBy("classification", F.col("classification_reason").alias("reason")).agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_policy_whatif(spark, sf):
    s = scored_docs(spark, sf)
    other, _ = scoring.classified(F.col("toxic_flag"), F.col("licence"), F.col("capability_evidence_score"), F.col("data_completeness_score"), F.col("explicit"), F.col("n_categories"), F.lit(False), Policy(thresholds=Thresholds(high_evidence=55, low_evidence=20)))
    return scoring.migrations(s.withColumn("other_classification", other)).select("classification", "other_classification", big(F.col("n")).alias("n"))


# -- regions -------------------------------------------------------------------------------------

REGION_COLUMNS = ("facility_count", "trusted_icu_count", "likely_gap_count", "insufficient_data_count", "needs_review_count")


def _regions(spark, sf) -> DataFrame:
    s = scored_docs(spark, sf)
    # a few documents lack a region, so that the unassigned one is there too
    return s.withColumns({"lang": F.when(F.col("doc_id") % 97 != 0, F.col("lang")), "source": F.when(F.col("doc_id") % 89 != 0, F.col("source"))})


@query
def q_region_rollup(spark, sf):
    out = regions.both_levels(_regions(spark, sf), DOC_POLICY, "lang", "source")
    return out.select("level", "state", "district", *(big(F.col(c)).alias(c) for c in REGION_COLUMNS), "pct_sufficient_data", "evidence_coverage_pct", "trust_weighted_icu_coverage", "region_status")


@query
def q_region_metrics_tpch(spark, sf):
    n, r, c = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "customer")
    j = c.join(F.broadcast(n.join(r, n["n_regionkey"] == r["r_regionkey"])), c["c_nationkey"] == n["n_nationkey"])  # 25 rows in any scale
    share = 100.0 * F.avg((F.col("c_acctbal") >= 5000).cast("double"))
    weighted = F.coalesce(F.try_divide(F.sum(F.col("c_acctbal") * F.length("c_mktsegment")), F.sum(F.length("c_mktsegment"))), F.lit(0.0))
    status, _ = regions.region_status(F.col("n"), F.col("rich"), F.col("poor"), F.col("raw_share"))
    a = j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") >= 9500).alias("rich"), F.count_if(F.col("c_acctbal") < 0).alias("poor"), share.alias("raw_share"), weighted.alias("w"))
    return a.select("r_name", "n_name", big(F.col("n")).alias("n"), F.round("raw_share", 4).alias("share"), F.round("w", 2).alias("weighted_balance"), status.alias("region_status"))


@query
def q_decision_path(spark, sf):
    out = regions.decision_steps(regions.both_levels(_regions(spark, sf), DOC_POLICY, "lang", "source"), DOC_POLICY)
    return out.select("level", "state", "district", big(F.col("step")).alias("step"), "question", "passed")


@query
def q_status_distribution(spark, sf):
    s = scored_docs(spark, sf)
    return regions.class_distribution(s, ["lang"]).select("lang", big(F.col("position")).alias("position"), "classification", big(F.col("n")).alias("n"), F.round("pct", 4).alias("pct"))


@query
def q_class_region_pivot(spark, sf):
    wide = regions.class_crosstab(scored_docs(spark, sf), "source", 30)
    return wide.select("source", big(F.col("total")).alias("total"), *(big(F.col(c)).alias(f"n_{i}") for i, c in enumerate(CLASSES)))


@query
def q_order_pivot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey"))
    wide = o.groupBy("c_nationkey").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    total = F.col("F") + F.col("O") + F.col("P")
    return wide.withColumn("total", total).orderBy(F.desc("total"), "c_nationkey").limit(30).select("c_nationkey", *(F.col(x).alias(f"n_{x.lower()}") for x in "FOP"), "total")


@query
def q_centroid(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    points = regions.centroids(c.where("c_acctbal >= 0"), ["c_nationkey"], "c_acctbal", "c_custkey")
    totals = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_all"))
    j = points.join(totals, F.col("c_nationkey") == F.col("k")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows in any scale
    return j.select("n_name", F.round("lat", 3).alias("median_balance"), F.round("lon", 3).alias("median_key"), big(F.col("n_located")).alias("n_located"), big(F.col("n_all")).alias("n_all"))


@query
def q_extent(spark, sf):
    x = regions.extents(table(spark, sf, "lineitem").withColumn("d", F.col("l_discount") * 100), ["l_returnflag"], "l_quantity", "d")
    return x.select("l_returnflag", F.round("mid_lat", 4).alias("mid_a"), F.round("mid_lon", 4).alias("mid_b"), F.round("zoom", 4).alias("zoom"))


@query
def q_facility_mix(spark, sf):
    kinds = F.when(F.col("p_type") == "LARGE", "Likely general-hospital context").when(F.col("p_type") == "PROMO", "Specialty or limited-scope hospital context").when(F.col("p_type").isin("SMALL", "MEDIUM"), "Outpatient / diagnostic context").otherwise("Unknown context")
    m = regions.facility_mix(table(spark, sf, "part").withColumn("facility_context", kinds), ["p_brand"])
    return m.select("p_brand", *(big(F.col(c)).alias(c) for c in ("n_general", "n_specialty", "n_outpatient", "n_unknown")), "mix_warning")


@query
def q_attention_topk(spark, sf):
    out = regions.attention(regions.rollup(_regions(spark, sf), "district", DOC_POLICY, "lang", "source"))
    return out.select("region_status", "state", "district", big(F.col("facility_count")).alias("facility_count"), big(F.col("rank")).alias("rank"), big(F.col("n_more")).alias("n_more"))


@query
def q_example_regions(spark, sf):
    out = regions.example_regions(regions.rollup(_regions(spark, sf), "district", DOC_POLICY, "lang", "source"))
    return out.select("region_status", "state", "district", big(F.col("facility_count")).alias("facility_count"))


@query
def q_region_slice(spark, sf):
    """Five slices in one pass: each record is counted in those that hold it."""
    parts = [(None, None), ("en", None), ("(unassigned)", None), ("fr", "(unassigned)"), ("de", "src3")]
    held = F.array_compact(F.array(*(F.when(regions.in_slice(a, b, "lang", "source"), F.lit(f"{a or 'all'}/{b or 'all'}")) for a, b in parts)))
    out = regions.finished(_regions(spark, sf).withColumn("slice", F.explode(held)).groupBy("slice").agg(*regions.measures(DOC_POLICY)), DOC_POLICY)
    # a slice that no record is in can't be assessed: it has a row all the same
    names = spark.createDataFrame([(f"{a or 'all'}/{b or 'all'}",) for a, b in parts], "slice string")
    full = names.join(out.hint("merge"), "slice", "left").fillna(0, list(REGION_COLUMNS)).fillna({"trust_weighted_icu_coverage": 0.0, "region_status": "Insufficient data to assess"})
    return full.select("slice", *(big(F.col(c)).alias(c) for c in REGION_COLUMNS), "trust_weighted_icu_coverage", "region_status")


# -- audit ---------------------------------------------------------------------------------------


@query
def q_spread_stats(spark, sf):
    """The same of prices, nearly all of which differ: no task holds a group's values."""
    s = audit.score_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], 10000.0, spread=True)
    return s.select("l_returnflag", big(F.col("n")).alias("n"), *(F.round(c, 3).alias(c) for c in ("median", "p5", "p25", "p50", "p75", "p95")), *(big(F.col(f"bin_{i}")).alias(f"bin_{i}") for i in range(10)))


@query
def q_score_stats(spark, sf):
    s = audit.score_stats(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"], 5.0)
    return s.select("l_returnflag", big(F.col("n")).alias("n"), *(F.round(c, 4).alias(c) for c in ("mean", "median", "p5", "p25", "p50", "p75", "p95")), *(big(F.col(f"bin_{i}")).alias(f"bin_{i}") for i in range(10)))


@query
def q_combo_counts(spark, sf):
    s = scored_docs(spark, sf)
    return audit.combination_counts(s, F.map_keys("completeness_components"), ["lang"]).select("lang", "combination", big(F.col("n")).alias("n"), F.round("pct", 4).alias("pct"))


@query
def q_dominance(spark, sf):
    s = table(spark, sf, "supplier")
    return audit.dominance(s, ["s_nationkey"], F.col("s_acctbal") < 5000, 0.5, 20).select("s_nationkey", big(F.col("n")).alias("n"), F.round("share", 4).alias("share"))


# -- evaluation ----------------------------------------------------------------------------------


def _predicted(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.char_length(F.coalesce("text", F.lit(""))).alias("length"), F.coalesce("text", F.lit("")).rlike(NUMBER).alias("number"))
    name = lambda c: F.when(c, TRUSTED).otherwise(GAP)
    j = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return j.select("doc_id", "lang", name(F.col("quality") == 1).alias("_q"), "quality", "length", "number").select(
        "doc_id", "lang", "length", "number", F.when(F.col("quality").isNotNull(), F.col("_q")).alias("human"), name(F.col("length") >= 800).alias("rule_a"), F.when(F.col("doc_id") % 4 != 0, name(~F.col("number"))).alias("rule_b")
    )


@query
def q_confusion(spark, sf):
    return evaluate.confusion(table(spark, sf, "labels"), "quality", "toxic").select("human", "predicted", big(F.col("n")).alias("n"))


@query
def q_per_class_metrics(spark, sf):
    p = evaluate.labelled(_predicted(spark, sf), "human")
    return evaluate.per_class(p, "human", "rule_a").select("label", "precision", "recall", big(F.col("support")).alias("support"))


@query
def q_agreement(spark, sf):
    out = evaluate.agreement(_predicted(spark, sf), "human", {"a": "rule_a", "b": "rule_b"}, ["lang"])
    return out.select("extractor", "lang", big(F.col("rows")).alias("n_rows"), F.col("agreement_pct"), big(F.col("false_trusted")).alias("false_trusted"), big(F.col("false_gap")).alias("false_gap"))


@query
def q_extractor_compare(spark, sf):
    p = _predicted(spark, sf)
    given = lambda c: p.select(F.col("doc_id").alias("unique_id"), F.col(c).alias("classification"), F.length(c).alias("capability_evidence_score"), F.length(c).alias("verified_fragments"), F.col("length").alias("dropped_fragments"), F.lit(0).alias("low_information_fragments"))
    x = evaluate.comparison(given("rule_a"), given("human").where("classification is not null"), given("rule_b"))
    s = evaluate.comparison_summary(x)
    second = x.agg(big(F.count("other_classification")).alias("second"))
    return s.join(F.broadcast(second), F.lit(True)).select(big(F.col("rows")).alias("n_rows"), big(F.col("pairs")).alias("pairs"), "agreement_pct", F.col("mean_score_difference").alias("mean_difference"), big(F.col("verified_fragments")).alias("verified"), big(F.col("dropped_fragments")).alias("dropped"), "second")  # one row each


@query
def q_progress(spark, sf):
    return evaluate.progress(_predicted(spark, sf), "human").select(*(big(F.col(c)).alias(c) for c in ("rows_total", "rows_labelled", "rows_pending")))


@query
def q_disagreements(spark, sf):
    return evaluate.differing(_predicted(spark, sf), "human", "rule_a").select("doc_id", "human", "rule_a")


# -- sampling ------------------------------------------------------------------------------------


@query
def q_semi_anti(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    some, none = sampling.within(d, lab, "doc_id"), sampling.without(d, lab, "doc_id")
    return union([t.groupBy("lang").agg(big(F.count(F.lit(1))).alias("n")).select(F.lit(k).alias("part"), "lang", "n") for k, t in (("labelled", some), ("unlabelled", none))])


@query
def q_stratified_sample(spark, sf):
    d = labelled_docs(spark, sf).select("doc_id", "lang", "source", "quality")
    return sampling.review_sample(d, "doc_id", [("quality", 10), ("lang", 8), ("source", 2)], 65).select("doc_id", "lang", "source", big(F.col("part")).alias("part"))


@query
def q_merge_preserving(spark, sf):
    old = table(spark, sf, "labels").select("doc_id").withColumns({"lang": F.lit("labelled"), "note": F.lit("kept")})
    new = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.merge_preserving(old, new, "doc_id").select("doc_id", "lang", "note")


@query
def q_batches(spark, sf):
    b = proposals.batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 25)
    return b.groupBy("batch_id").agg(big(F.count(F.lit(1))).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query
def q_disagreeing_ids(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    said = d.select("doc_id", F.when(F.char_length("text") >= 800, "1").otherwise("0").alias("good"))
    return sampling.disagreements(said, lab.select("doc_id", F.col("quality").cast("string").alias("good")), "doc_id", "good")


# -- proposals -----------------------------------------------------------------------------------


@query
def q_id_accounting(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unique_id"), big(F.floor(F.col("o_orderkey") / 1000)).alias("batch_id"))
    given = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unique_id"), big(F.floor(F.col("l_orderkey") / 1000)).alias("batch_id"))
    x = proposals.accounted(asked, given)
    return x.groupBy("batch_id", F.coalesce("problem", F.lit("none")).alias("problem")).agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_quote_verify(spark, sf):
    """Passages of the benchmark that stand in documents as a whole, whatever the white space and
    wherever they begin and end."""
    quoted = table(spark, sf, "benchmark").select("item_id", proposals.collapsed(F.col("text")).alias("quote"))
    found = quotes.found_quotes(quoted, spread(table(spark, sf, "documents").select("doc_id", "text")), "item_id", "quote", "doc_id", "text")
    return found.select(F.col("quote_id").alias("item_id"), F.col("text_id").alias("doc_id"), "quote")


@query
def q_default_scan(spark, sf):
    """All patterns of the default policy over the documents' whole texts, each with a sentence about
    equipment and units behind it, as the documents speak of none."""
    said = F.element_at(F.array(*(F.lit(x) for x in SENTENCES)), (F.pmod(F.coalesce("n_chars", F.lit(0)), F.lit(len(SENTENCES))) + 1).cast("int"))
    items = F.array(F.struct(F.lit("description").alias("field"), F.concat_ws("\n", "text", said).alias("text")))
    found = spread(table(spark, sf, "documents").select("lang", "text", "n_chars")).select("lang", F.explode(evidence.all_fragments(items, Policy().keywords, windows=False)).alias("f"))
    return found.groupBy("lang", F.col("f.group").alias("signal"), F.col("f.pattern").alias("pattern")).agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_turn_checks(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("turn").alias("u"), F.max("turn").alias("m"), F.min("turn").alias("l"))
    state = F.when(F.col("n") > F.col("u"), "duplicate").when((F.col("l") != 0) | (F.col("m") + 1 != F.col("u")), "missing").otherwise("complete")
    return t.groupBy(state.alias("state"), big(F.col("n")).alias("turns")).agg(big(F.count(F.lit(1))).alias("n_conversations"))


@query
def q_id_quarantine(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("-"), F.col("event_id").cast("string")).alias("unique_id"))
    good, bad = proposals.split_by(e, proposals.valid_id(F.col("unique_id")))
    return union([t.agg(big(F.count(F.lit(1))).alias("n"), F.min("unique_id").alias("first_id"), F.max("unique_id").alias("last_id")).withColumn("part", F.lit(k)) for k, t in (("good", good), ("quarantined", bad))])


@query
def q_payload_check(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 5
    body = F.concat(F.lit('{"unique_id": "id-'), F.col("event_id").cast("string"), F.lit('", "explicit_icu_claim": true, "fragments": []'))
    payload = F.when(k == 0, F.concat(body, F.lit("}"))).when(k == 1, body).when(k == 2, F.concat(body, F.lit(', "extra": 1}'))).when(k == 3, F.lit('{"unique_id": "x"}')).otherwise(F.lit(" "))
    x = proposals.parsed_payloads(e.select(payload.alias("payload")))
    return x.groupBy("valid", F.coalesce("reason", F.lit("none")).alias("reason")).agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_resume(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unique_id"), "o_orderpriority")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unique_id"))
    return proposals.unfinished(o, done).groupBy("o_orderpriority").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_spend(spark, sf):
    c = table(spark, sf, "conversations").select("role", F.char_length("text").alias("chars"))
    usage = c.select(F.when(F.col("role") == "assistant", 0).otherwise(F.col("chars")).alias("tokens_in"), F.when(F.col("role") == "assistant", F.col("chars")).otherwise(0).alias("tokens_out"))
    return proposals.spend(usage, limit=0.01).select(big(F.col("records")).alias("records"), F.round("cost_usd", 6).alias("cost_usd"), "over_limit")


# -- review --------------------------------------------------------------------------------------


@query
def q_display_order(spark, sf):
    f = _doc_fragments(spark, sf).select("doc_id", F.posexplode(evidence.display_order(F.col("found"), 5)).alias("rank", "f"))
    return f.groupBy("rank", F.col("f.group").alias("signal")).agg(big(F.count(F.lit(1))).alias("n")).select(big(F.col("rank")).alias("rank"), "signal", "n")


# -- ledger and streams --------------------------------------------------------------------------


@query
def q_snapshot_latest(spark, sf):
    e = table(spark, sf, "events")
    out = ledger.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error")
    return out.select("user_id", "event_id", "event_type")


@query
def q_notes_scoped(spark, sf):
    n = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("scope_type"), F.col("user_id").cast("string").alias("scope_id"), F.col("props").alias("note"))
    return ledger.scoped_notes(n, "purchase", "7").select("id", "scope_type", "note")


@query
def q_note_checks(spark, sf):
    e = table(spark, sf, "events")
    scope = F.when(F.col("event_type") == "error", "planet").when(F.col("event_id") % 2 == 0, "state").otherwise("district")
    n = e.select(scope.alias("scope_type"), F.col("user_id").cast("string").alias("scope_id"), F.when(F.col("event_id") % 7 == 0, " \t").otherwise(F.col("props")).alias("note"), F.lit(None).cast("string").alias("author"))
    good, bad = ledger.checked_notes(n)
    return good.select(F.lit("accepted").alias("outcome"), "scope_type").unionByName(bad.select(F.col("reason").alias("outcome"), "scope_type")).groupBy("outcome", "scope_type").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_fingerprint(spark, sf):
    return ledger.fingerprint(table(spark, sf, "orders"), "o_orderstatus").select(big(F.col("n_rows")).alias("n_rows"), "digest", "data_snapshot_id")


@query
def q_drift(spark, sf):
    """Snapshots with the data they were saved on: one of the orders as they are, one of another column."""
    orders = table(spark, sf, "orders")
    saved = union([ledger.fingerprint(orders, c).select(F.lit(c).alias("id"), "data_snapshot_id") for c in ("o_orderstatus", "o_orderpriority")])
    return ledger.drifted(saved, ledger.fingerprint(orders, "o_orderstatus"))


@query
def q_drift_ranges(spark, sf):
    """Which ranges of order keys differ between the orders and the keys of their lines."""
    wide = lambda c: F.floor(F.col(c) / 500).cast("bigint")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    halves = [ledger.range_fingerprints(orders.where(f"k % 2 = {i}"), ["k"], wide("k")) for i in (0, 1)]
    out = ledger.drifted_ranges(ledger.merged_fingerprints(union(halves)), ledger.range_fingerprints(lines, ["k"], wide("k")))
    return out.select("key_range", big(F.col("n_saved")).alias("n_saved"), big(F.col("n_now")).alias("n_now"), "drift")


@query
def q_run_compatibility(spark, sf):
    """What forbids each customer's last order to go on with the settings of the newest."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string").alias("year"))
    manifest = o.where("o_orderkey % 50 = 7")
    out = proposals.incompatibilities(manifest, {"o_orderpriority": "1-URGENT", "o_orderstatus": "O", "year": "1995"})
    return out.groupBy("field", "recorded", "current").agg(big(F.count(F.lit(1))).alias("n"))


@query
def q_incremental(spark, sf):
    """The events scored as a stream of files and, beside that, in one batch."""
    import uuid

    from sievemark.streaming.incremental import file_stream, scored_stream

    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")

    def score(df: DataFrame) -> DataFrame:
        return df.select("event_id", "event_type", F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int").alias("score"))

    def valid(df: DataFrame) -> DataFrame:
        return df.withColumn("valid", F.col("event_type") != "error")

    # files of one batch each, as they would come in
    events.repartition(3, F.dayofyear("ts")).write.parquet(f"{base}/in")
    scored_stream(file_stream(spark, f"{base}/in", events.schema, files_per_batch=1), score, valid, f"{base}/out", f"{base}/bad", f"{base}/state", "event_id").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(big(F.count(F.lit(1))).alias("n"), big(F.sum("score")).alias("total_score"))


def _event_regions(df: DataFrame) -> DataFrame:
    """Events as scored records of regions: type and group of users."""
    kind = F.pmod("event_id", F.lit(9))
    name = F.when(kind == 0, TRUSTED).when(kind < 3, REVIEW).when(kind < 7, GAP).otherwise(INSUFFICIENT)
    return df.select(
        "event_id", name.alias("classification"), F.pmod("event_id", F.lit(101)).cast("int").alias("data_completeness_score"), F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int").alias("capability_evidence_score"),
        F.col("event_type").alias("state_final"), F.when(F.col("user_id") % 10 > 0, F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))).alias("district_final"),
    )


@query
def q_incremental_regions(spark, sf):
    """The regional rollup of a stream of files, some of which come twice, from the sums of its batches."""
    import uuid

    from sievemark.streaming.incremental import file_stream, id_range, scored_stream

    base = f"{shared_folder(spark)}/regions-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    events.repartition(4, F.floor(F.col("event_id") / 5000)).write.parquet(f"{base}/in")
    events.where("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{base}/in")
    scored_stream(
        file_stream(spark, f"{base}/in", events.schema, files_per_batch=2), _event_regions, lambda df: df.withColumn("valid", F.lit(True)), f"{base}/out", f"{base}/bad", f"{base}/state", "event_id",
        slot=id_range("event_id", 1000), sums=regions.partial, partials=f"{base}/sums",
    ).awaitTermination()
    out = regions.merged(spark.read.parquet(f"{base}/sums"), "district")
    counts = ("facility_count", "trusted_icu_count", "likely_gap_count", "insufficient_data_count", "needs_review_count")
    return out.select("state", "district", *(big(F.col(c)).alias(c) for c in counts), "pct_sufficient_data", "evidence_coverage_pct", "trust_weighted_icu_coverage", "region_status")


@query
def q_round_trips(spark, sf):
    """The customers through every sink and back: how many come back, and whether all rows are the same."""
    import uuid

    from sievemark.sources import tables

    base = f"{shared_folder(spark)}/trips-{uuid.uuid4().hex}"
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit('a "b", \\ '), "c_name")).alias("note"))
    names = c.columns
    text = c.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names))
    key = F.lit(0).cast("bigint")
    tables.write_tables({"facilities_scored": c}, base)
    tables.write_labels(text, f"{base}/labels")
    tables.append_json(c.where("c_custkey % 2 = 0"), f"{base}/lines")
    tables.append_json(c.where("c_custkey % 2 = 1"), f"{base}/lines")
    # every tenth line is torn in the middle
    lines = c.select(F.to_json(F.struct(*names)).alias("value"), "c_custkey")
    lines.select(F.when(F.col("c_custkey") % 10 == 0, F.substring("value", 1, 25)).otherwise(F.col("value")).alias("value")).write.text(f"{base}/torn")
    whole, torn = tables.split_json_lines(spark, f"{base}/torn", c.schema)
    back = {
        "parquet": (c, tables.source(spark, "files", base)("facilities_scored")), "labels": (text, tables.read_labels(spark, f"{base}/labels")), "json lines": (c, tables.json_lines(spark, f"{base}/lines", c.schema)),
        "torn lines": (c.where("c_custkey % 10 > 0"), whole), "torn lines, by schema": (c.where("c_custkey % 10 > 0"), tables.json_lines(spark, f"{base}/torn", c.schema)),
    }
    out = []
    for sink, (before, after) in back.items():
        d = ledger.drifted_ranges(ledger.range_fingerprints(before, names, key), ledger.range_fingerprints(after.select(*names), names, key))
        out.append(d.select(F.lit(sink).alias("sink"), big(F.col("n_now")).alias("n"), "drift"))
    out.append(torn.agg(big(F.count(F.lit(1))).alias("n")).select(F.lit("torn").alias("sink"), "n", F.lit("skipped").alias("drift")))
    return union(out)
