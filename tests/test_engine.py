"""The build from raw records to regions, and its parts."""

import json

import pytest
from pyspark.sql import functions as F

from sievemark import policy as P
from sievemark.operators import audit, clean, evaluate, evidence, geography, ledger, profile, proposals, regions, review, sampling, scoring
from sievemark.plans import build as plan
from sievemark.sources import tables

COLUMNS = [*clean.KEPT]
DEFAULT = {
    "unique_id": "test-0001", "name": "Marigold House", "organization_type": "facility", "address_city": "Lakeside", "address_stateOrRegion": "Kerala", "address_zipOrPostcode": "682001",
    "description": "Looks after births and day patients of the whole town.", "numberDoctors": "12", "capacity": "100", "specialties": '["familyMedicine", "midwifery"]',
    "procedure": '["Day visits", "Births"]', "equipment": '["X-ray", "Sonograph"]', "capability": '["Sees day patients", "Has a birth room"]',
    "source_urls": '["https://example.org/marigold"]', "latitude": "9.9312", "longitude": "76.2673",
}
GOLDEN = [
    ("backed", {"description": "Our 20 bed ICU is run by intensivists day and night.", "procedure": '["Mechanical ventilation", "Resuscitation"]', "equipment": '["Twelve ventilators", "Defibrillator"]', "capability": '["ICU open at all hours"]', "capacity": "400"}, P.TRUSTED),
    ("claim-only", {"description": "Skin and eye clinic above the market.", "capability": '["ICU"]'}, P.REVIEW),
    ("births", {"description": "A home for births and the weeks before them.", "address_stateOrRegion": "Orissa", "address_zipOrPostcode": "751001"}, P.GAP),
    ("sparse", {k: None for k in ("numberDoctors", "capacity", "latitude", "longitude", "address_zipOrPostcode")} | {"description": "null", "specialties": "[]", "procedure": "[]", "equipment": "[]", "capability": "[]", "source_urls": "[]", "address_stateOrRegion": "Mh"}, P.INSUFFICIENT),
    ("denial", {"description": "We have no ICU; serious cases go to the next town.", "capability": '["ICU ward"]'}, P.REVIEW),
    ("implausible", {"description": "A villa that speaks of its 50 bed ICU.", "capacity": "20", "procedure": '["broken json', "equipment": '["Ventilator"]', "capability": '["ICU with 50 beds"]'}, P.REVIEW),
]


def records(spark, changes):
    rows = [{**DEFAULT, "unique_id": f"test-{i:04d}", "name": f"Hospital {i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], tables.text_schema(COLUMNS))


@pytest.fixture(scope="module")
def directory(spark):
    rows = [("682001", "KERALA", "ERNAKULAM", "9.9", "76.2"), ("682001", "KERALA", "ERNAKULAM", "10.1", "76.4"), ("110001", "DELHI", "NEW DELHI", "NA", "NA"), ("110001", "DELHI", "NEW DELHI", "28.6", "77.2"), ("bad", "X", "Y", "1", "2")]
    return spark.createDataFrame(rows, "pincode string, statename string, district string, latitude string, longitude string")


@pytest.fixture(scope="module")
def golden(spark, directory, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("built"))
    return plan.run(spark, records(spark, [c for _, c, _ in GOLDEN]), directory, folder)["facilities_scored"]


def test_golden_classes(golden):
    got = {r["unique_id"]: r for r in golden.collect()}
    assert [got[f"test-{i:04d}"]["classification"] for i in range(len(GOLDEN))] == [c for _, _, c in GOLDEN]
    assert got["test-0000"]["icu_bed_count"] == 20 and got["test-0005"]["icu_bed_count"] == 50
    assert got["test-0002"]["state_final"] == "Odisha" and got["test-0002"]["geo_source"] == "state_field"
    assert "icu_beds_exceed_total_capacity" in [f["name"] for f in got["test-0005"]["validation_flags"]]


def test_default_record_scores_nothing_and_everything(spark, directory):
    r = plan.build(records(spark, [{}]), directory)["facilities_scored"].first()
    assert (r["capability_evidence_score"], r["data_completeness_score"], r["classification"]) == (0, 100, P.GAP)


def test_postal_rollup(directory):
    got = {r["pincode_clean"]: r for r in geography.postal_rollup(directory).collect()}
    assert set(got) == {"682001", "110001"}
    assert got["682001"]["pin_lat"] == pytest.approx(10.0) and got["682001"]["pin_district"] == "Ernakulam"
    assert got["110001"]["pin_lat"] == pytest.approx(28.6) and got["110001"]["n_valid_coords"] == 1


def test_geography_provenance(spark, directory):
    df = records(spark, [{"address_stateOrRegion": "Tamil Nadu"}, {"address_zipOrPostcode": None, "address_stateOrRegion": "Orissa"}, {"address_zipOrPostcode": "12", "address_stateOrRegion": "Mumbai"}])
    for small in (10, 0):  # broadcast, and by shuffle
        got = geography.assign_geography(df, geography.postal_rollup(directory), small).orderBy("unique_id").collect()
        assert [(r["state_final"], r["geo_source"], r["geo_conflict"]) for r in got] == [("Kerala", "pin_directory", True), ("Odisha", "state_field", False), (None, "none", False)]


def test_most_complete_row_of_each_id(spark):
    rows = [("a", 1, None, "x"), ("a", 2, "y", "x"), ("a", 3, "z", "x"), (None, 4, None, None), (None, 5, "NA", "q"), ("b", 6, None, None)]
    df = spark.createDataFrame(rows, "id string, o int, p string, q string")
    got = clean.most_complete(df, "id", ["o"])
    assert sorted((r["id"] or "", r["o"]) for r in got.collect()) == [("", 5), ("a", 2), ("b", 6)]
    assert clean.dropped(df, got).first()["rows_dropped"] == 3


def test_duplicate_names_ignore_blank_ones(spark):
    df = spark.createDataFrame([("A ", "x"), ("a", "X"), ("", "x"), (None, "x"), ("a", "y")], "name string, city string")
    got = clean.duplicate_keys(df, ["name", "city"], "d").collect()
    assert sorted((r["name"] or "", r["city"], r["d"]) for r in got) == [("", "x", False), ("", "x", False), ("A ", "x", True), ("a", "X", True), ("a", "y", False)]


@pytest.mark.parametrize(
    ("sentence", "count"),
    [("an 11-bed ICU", 11), ("its ICU counts 9 beds", 9), ("14 bedded ICU", 14), ("30 - bed ICU", 30), ("Intensive care of 7 beds", 7), ("5-bed critical care ward", 5), ("4   ICU beds", 4)]
    + [(s, None) for s in ("8 monitors; an ICU", "60 beds. An ICU.", "an ICU", "15 beds")],
)
def test_anchored_counts(spark, sentence, count):
    df = spark.createDataFrame([(sentence,)], "t string")
    assert df.select(evidence.anchored_number(F.array("t"), P.Keywords().bed_count)).first()[0] == count


def test_sentence_window(spark):
    long = "x" * 400 + " icu " + "y" * 400
    df = spark.createDataFrame([("First. The ICU is open; more", 0), (long, 1)], "t string, i int")
    got = [r[0] for r in df.orderBy("i").select(evidence.sentence_window(F.col("t"), r"\bicu\b")).collect()]
    assert got[0] == "The ICU is open" and len(got[1]) <= 300 and "icu" in got[1]


def test_one_phrase_does_not_back_itself(spark, directory):
    df = records(spark, [{"capability": '["critical care with mechanical ventilation"]'}])
    r = plan.build(df, directory)["facilities_scored"].first()
    assert r["corroboration_categories"] == [] and "procedure" in r["evidence_components"]


def test_policies(spark, golden, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({"thresholds": {"high_evidence": 101}, "keywords": {"equipment": ["lamp"]}}))
    other = P.load(str(path))
    assert other.thresholds.high_evidence == 101 and other.keywords.equipment == ("lamp",) and other.fingerprint() != P.Policy().fingerprint()
    with pytest.raises(ValueError):
        P.overridden(P.Policy(), {"nothing": 1})
    moved = {(r[0], r[1]): r[2] for r in scoring.migrations(scoring.what_if(golden, other)).collect()}
    assert moved[(P.TRUSTED, P.REVIEW)] == 1
    assert all(a == b for a, b in {(r[0], r[1]) for r in scoring.migrations(scoring.what_if(golden, P.Policy())).collect()})


def scored_rows(spark):
    rows = [("A", "a", P.TRUSTED, 80, 90)] + [("A", "a", P.GAP, 0, 80)] * 2 + [("B", "b", P.GAP, 5, 70)] * 3 + [("C", "c", P.INSUFFICIENT, 0, 10)] * 3 + [("D", "d", P.GAP, 0, 90)] + [("E", "e", P.REVIEW, 30, 60)] + [("E", "e", P.GAP, 0, 60)] * 2 + [(None, None, P.GAP, 0, 50)]
    return spark.createDataFrame(rows, "state_final string, district_final string, classification string, capability_evidence_score int, data_completeness_score int")


def test_region_statuses(spark):
    df = scored_rows(spark)
    got = {r["state"]: r["region_status"] for r in regions.rollup(df, "state").collect()}
    assert got == {"A": P.REGION_TRUSTED, "B": P.REGION_GAP, "C": P.REGION_DESERT, "D": P.REGION_DESERT, "E": P.REGION_VERIFY, P.UNASSIGNED: P.REGION_DESERT}
    both = regions.both_levels(df)
    assert both.count() == 12
    steps = regions.decision_steps(both).where("level = 'state' and state = 'D'").orderBy("step").collect()
    assert [s["question"] for s in steps] == ["Enough records?", "Regional result"]
    empty = regions.summary(df.where("false")).first()
    assert (empty["facility_count"], empty["region_status"], empty["trust_weighted_icu_coverage"]) == (0, P.REGION_DESERT, 0.0)
    with pytest.raises(ValueError):
        regions.rollup(df, "county")
    counts = {r["classification"]: r["n"] for r in regions.class_distribution(df, ["state_final"]).where("state_final = 'A'").collect()}
    assert counts == {P.TRUSTED: 1, P.GAP: 2, P.INSUFFICIENT: 0, P.REVIEW: 0}
    assert regions.sliced(df, P.UNASSIGNED).count() == 1 and regions.sliced(df, "A", "a").count() == 3
    assert regions.attention(regions.rollup(df, "district"), 1).where("region_status = 'Insufficient data to assess'").first()["n_more"] == 1


def test_extent_and_zoom(spark):
    df = spark.createDataFrame([("p", 10.0, 70.0), ("p", 10.0, 70.0), ("w", 8.0, 68.0), ("w", 36.0, 97.0)], "k string, lat double, lon double")
    got = {r["k"]: r for r in regions.extents(df, ["k"], "lat", "lon").collect()}
    assert got["p"]["zoom"] == 13 and got["w"]["zoom"] == 6 and got["w"]["mid_lat"] == 22.0


def test_audit_profile_and_review(spark, golden, directory):
    states, districts = regions.rollup(golden, "state"), regions.rollup(golden, "district")
    report = {(r["section"], r["metric"], r["key"]): r["value"] for r in audit.report(golden, states, districts).collect()}
    assert report[("judgeability", "judgeable", None)] == 5 and report[("trusted_records", "total", None)] == 1
    assert audit.boundary_summary(golden).count() > 0
    assert audit.trusted_records(golden.where("false")).where("metric = 'total'").first()["value"] == 0
    work = review.priority_worklist(golden.withColumns({"state": F.col("state_final"), "region_status": F.lit(P.REGION_GAP)}), ["region_status"], 6).orderBy("priority").collect()
    assert [r["classification"] for r in work] == [P.REVIEW] * 3 + [P.TRUSTED, P.GAP]
    assert work[-1]["priority_reason"] == review.REASONS["gap"]
    shown = review.assessment(review.trust_gates(review.operational_data(golden))).where("unique_id = 'test-0000'").first()
    assert shown["operational_level"] == "High" and all(g["met"] for g in shown["trust_gates"]) and shown["assessment"] == "resolved"
    assert review.candidates(golden).where("label = 'trusted_general'").count() == 1
    facts = {r["metric"]: r["value"] for r in profile.facility_profile(records(spark, [{}, {"unique_id": "test-0000"}, {"latitude": "x"}])).collect()}
    assert facts["rows"] == 3 and facts["repeated_ids"] == 1 and facts["coordinates_unparseable"] == 1
    assert profile.directory_profile(directory).first()["non_numeric_latitudes"] == 1


def test_score_stats(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 5, 10, 95, 100)], "s double")
    r = audit.score_stats(df, "s").first()
    assert (r["n"], r["median"], r["bin_0"], r["bin_9"], r["p25"]) == (5, 10.0, 2, 2, 5.0)


def test_sampling(spark):
    df = spark.createDataFrame([(f"r{i:02d}", "ab"[i % 2]) for i in range(10)], "id string, c string")
    got = sampling.review_sample(df, "id", [("c", 2)], cap=3)
    assert [r["id"] for r in got.orderBy("id").collect()] == ["r00", "r01", "r02"]
    more = sampling.review_sample(df, "id", [("c", 1)], cap=None, already=got, top_up=2)
    assert [r["id"] for r in more.orderBy("id").collect()] == ["r03", "r04", "r05", "r06"]
    merged = sampling.merge_preserving(got.select("id", F.lit("mine").alias("note")), df.select("id"), "id")
    assert {r["id"]: r["note"] for r in merged.collect()}["r00"] == "mine" and merged.count() == 10


def test_evaluation(spark):
    rows = [("1", P.TRUSTED, P.GAP, ""), ("2", P.GAP, P.TRUSTED, P.TRUSTED), ("3", P.GAP, P.GAP, None), ("4", P.GAP, " ", P.GAP)]
    df = spark.createDataFrame(rows, "unique_id string, current_classification string, human_expected_classification string, llm_classification string")
    got = {r["extractor"]: r for r in evaluate.agreement(df).collect()}
    assert (got["deterministic"]["agreement_pct"], got["deterministic"]["false_trusted"], got["deterministic"]["false_gap"]) == (33.3, 1, 1)
    assert got["llm_assisted"]["rows"] == 1 and got["llm_assisted"]["agreement_pct"] == 100.0
    assert evaluate.progress(df).first()["rows_pending"] == 1
    per = {r["label"]: r for r in evaluate.per_class(evaluate.labelled(df), "human_expected_classification", "current_classification").collect()}
    assert per[P.GAP]["precision"] == 0.5 and per[P.TRUSTED]["recall"] == 0.0
    none = df.where("false").select(F.lit(None).cast("string").alias("human_label"), F.lit("x").alias("classification"), F.lit(None).cast("string").alias("model_classification"), F.lit(1.0).alias("latency_ms"))
    r = evaluate.run_summary(none, df.where("false")).first()
    assert r["model_agreement_pct"] is None and r["false_trusted"] is None


def test_quotes(spark):
    rows = [("Intensive care unit", "An Intensive  care\nunit available", "Intensive  care\nunit"), ("a paraphrase", "something else", None), (" ", "x", None), ("a+b (c)", "is a+b   (c) ok", "a+b   (c)"), (r"x\Ey", r"ax\Eyb", r"x\Ey")]
    df = spark.createDataFrame([(q, s, i) for i, (q, s, _) in enumerate(rows)], "q string, s string, i int")
    assert [r[0] for r in df.orderBy("i").select(proposals.located("q", "s")).collect()] == [e for *_, e in rows]


def test_proposals(spark, directory):
    cleaned = plan.cleaned_facilities(records(spark, [{"capability": '["True", "Medical ICU with 10 ICU beds"]', "equipment": '["Ventilator"]'}, {}]), directory)
    payload = [
        {"unique_id": "test-0000", "explicit_icu_claim": True, "icu_bed_count": 10, "icu_subtypes": [], "unclear_claims": [], "explanation": "", "fragments": [{"field": "capability", "group": "explicit_icu", "quote": "Medical  ICU"}, {"field": "capability", "group": "explicit_icu", "quote": "True"}, {"field": "equipment", "group": "equipment", "quote": "Ventilator"}, {"field": "capability", "group": "staffing", "quote": "10 ICU beds"}]},
        {"unique_id": "test-0001", "explicit_icu_claim": True, "icu_bed_count": 99, "icu_subtypes": [], "unclear_claims": [], "explanation": "", "fragments": [{"field": "description", "group": "explicit_icu", "quote": "has an ICU"}]},
    ]
    raw = spark.createDataFrame([(0, json.dumps(p)) for p in payload] + [(0, "{"), (0, json.dumps({**payload[0], "x": 1}))], "batch_id int, payload string")
    parsed = proposals.parsed_payloads(raw)
    assert sorted(r["reason"] or "" for r in parsed.collect()) == ["", "", "malformed JSON", "unknown keys"]
    got = {r["unique_id"]: r for r in proposals.scored_proposals(cleaned, parsed.where("valid")).collect()}
    a, b = got["test-0000"], got["test-0001"]
    assert a["explicit_icu_claim"] and a["icu_bed_count"] == 10 and a["low_information_fragments"] == 1 and a["icu_subtypes"] == ["medical_icu"]
    assert not b["explicit_icu_claim"] and b["icu_bed_count"] is None and b["dropped_fragments"] == 1
    assert {"llm_unverified_fragments_dropped:1", "llm_bed_count_unanchored"} <= set(b["suspicious_flags"])


def test_accounting_batches_and_resume(spark):
    asked = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "batch_id int, unique_id string")
    given = spark.createDataFrame([(0, "a"), (0, "a"), (0, "z"), (1, "c")], "batch_id int, unique_id string")
    got = {(r["batch_id"], r["unique_id"]): (r["problem"], r["batch_has_problems"]) for r in proposals.accounted(asked, given).collect()}
    assert got == {(0, "a"): ("duplicate", True), (0, "b"): ("missing", True), (0, "z"): ("unknown", True), (1, "c"): (None, False)}
    ids = spark.range(23).select(F.format_string("id-%05d", "id").alias("unique_id"))
    sizes = {r["batch_id"]: (r["n"], r["f"]) for r in proposals.batches(ids, "unique_id", 10).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("unique_id").alias("f")).collect()}
    assert sizes == {0: (10, "id-00000"), 1: (10, "id-00010"), 2: (3, "id-00020")}
    assert proposals.unfinished(ids, ids.limit(20)).count() == 3
    good, bad = proposals.split_by(spark.createDataFrame([("abcdef",), ("short",), ("has space here",), (None,)], "i string"), proposals.valid_id(F.col("i")))
    assert (good.count(), bad.count()) == (1, 3)


def test_ledger(spark):
    notes = spark.createDataFrame([("state", "K", " hello ", None), ("planet", "x", "y", "me"), ("state", "K", " ", "me")], "scope_type string, scope_id string, note string, author string")
    good, bad = ledger.checked_notes(notes)
    assert good.first()["note"] == "hello" and sorted(r["reason"] for r in bad.collect()) == ["blank note", "unknown scope type"]
    log = spark.createDataFrame([("1", 1, "save"), ("1", 2, "delete"), ("2", 1, "save")], "id string, created_at int, event string")
    assert [r["id"] for r in ledger.current_snapshots(log).collect()] == ["2"]
    df = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    assert ledger.fingerprint(df, "c").first() == ledger.fingerprint(df.orderBy(F.desc("c")).repartition(3), "c").first()


def test_sources(spark, tmp_path, golden):
    path = str(tmp_path / "f.csv")
    (tmp_path / "f.csv").write_text('a,b\n"x ""q"" y","line\nend"\n,null\n')
    rows = tables.raw_csv(spark, path).collect()
    assert rows[0]["a"] == 'x "q" y' and rows[0]["b"] == "line\nend" and rows[1]["a"] is None and rows[1]["b"] == "null"
    with pytest.raises(tables.MissingInput):
        tables.processed(spark, str(tmp_path / "none"), "region_state")
    with pytest.raises(ValueError):
        tables.region_summary(spark, str(tmp_path), "county")
    (tmp_path / "l.json").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert sorted(r["a"] for r in tables.json_lines(spark, str(tmp_path / "l.json"), "a int").collect()) == [1, 2]
    tables.write_tables({"facilities_scored": tables.json_columns(golden)}, str(tmp_path / "out"))
    back = tables.source(spark, "files", str(tmp_path / "out"))("facilities_scored")
    assert back.count() == len(GOLDEN) and dict(back.dtypes)["validation_flags"] == "string"
    schema = spark.createDataFrame([("n", 1)], "note string, n int").schema
    tables.create_if_missing(spark, "notes_t", schema)
    tables.append_rows(spark.createDataFrame([(1, "x")], "n int, note string"), "notes_t")
    assert spark.table("notes_t").first()["note"] == "x"
    with pytest.raises(ValueError):
        tables.catalog_table(spark, "notes", {"notes": "a; drop"})


def test_results_do_not_hang_on_order_or_partitions(spark, directory):
    df = records(spark, [c for _, c, _ in GOLDEN])
    a = plan.build(df, directory)["facilities_scored"].select("unique_id", "classification", "classification_reason")
    b = plan.build(df.orderBy(F.desc("unique_id")).repartition(5), directory)["facilities_scored"].select("unique_id", "classification", "classification_reason")
    assert sorted(a.collect()) == sorted(b.collect())
