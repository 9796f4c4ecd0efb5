from dataclasses import replace

from pyspark.sql import functions as F

from sievemark.operators import scoring, signals
from sievemark.policy import EvidenceWeights, Keywords, Policy, Thresholds

TEXTS = [
    "The unit provides intensive care with two ventilators. Resuscitation is at hand.",
    "No ICU here; referral to the district.",
    "Listed in a directory of partner hospitals with an ICU",
    "20 bed ICU with intensivist and BiPAP",
    "A clinic.",
    None,
    "Critical care and intubation in one sentence with a ventilator",
    "criticalcare",
    "We operate a dedicated NICU with 12 ICU beds and central oxygen.",
]


def rows(spark):
    data = []
    for i, a in enumerate(TEXTS):
        for j, b in enumerate(TEXTS):
            capability = [b] if b else []
            data.append((f"r-{i}-{j}", f"n{i}", "Pune", a, capability, [], [TEXTS[(i + j) % 9] or "x", a or "y"], [b or "z"] * 2, ["u"] if i % 2 else [], 10 * j if j != 3 else None, j if i % 3 else None, "ok" if j % 2 else "missing", "Goa" if i % 4 else None, None, False))
    return spark.createDataFrame(
        data,
        "unique_id string, name string, address_city string, description string, capability array<string>, specialties array<string>, procedure array<string>, equipment array<string>, urls array<string>, "
        "capacity_int int, number_doctors_int int, coord_status string, state_final string, state_from_pin string, geo_conflict boolean",
    ).withColumns({"source_urls": F.to_json("urls"), "state_from_field": F.lit("x"), "is_name_duplicate": F.lit(False)})


def test_ledger_scores_as_each_policy_does_by_itself(spark):
    base = Policy()
    kw = Keywords()
    policies = {
        "base": base,
        "weights": replace(base, evidence_weights=EvidenceWeights(explicit_claim=20, equipment=30, negation_penalty=5), thresholds=Thresholds(high_evidence=50, low_evidence=20, sufficient_completeness=85)),
        "words": replace(
            base,
            keywords=replace(kw, explicit_icu=(r"ventilator", r"\bnicu\b"), equipment=(r"bipap", r"intensive\s+care"), procedure=(r"ventilator", r"intubation"), negation=(r"clinic",), bed_count=(r"(\d+) bed",), service_verbs=(r"\bis\b",), cross_organization=(r"central",)),
        ),
        "none": replace(base, keywords=replace(kw, staffing=(), specialty_context=(), cross_organization=(r"zzz",), unit_statements=(r"qqq",))),
    }
    r = rows(spark)
    got = {(x["policy"], x["unique_id"]): x for x in signals.scored_under(signals.ledger(r, policies, listed=True), policies).collect()}
    assert len(got) == 4 * 81
    for name, p in policies.items():
        for w in scoring.scored(r, p, listed=True).collect():
            x = got[(name, w["unique_id"])]
            want = (w["capability_evidence_score"], w["data_completeness_score"], w["n_corroboration_categories"], w["explicit_icu_claim"], w["icu_bed_count"], w["description_corroboration"], w["classification"])
            assert tuple(x[c] for c in ("evidence", "completeness", "n_categories", "explicit_icu_claim", "icu_bed_count", "described", "classification")) == want, (name, w["unique_id"])
    assert len({x["classification"] for x in got.values()}) == 4
    moved = signals.moves(signals.scored_under(signals.ledger(r, policies, listed=True), policies), "base").collect()
    for x in moved:
        assert x["n"] == sum(got[(x["policy"], i)]["classification"] == x["other_classification"] for (p, i), b in got.items() if p == "base" and b["classification"] == x["classification"])
    assert sum(x["n"] for x in moved) == 3 * 81
    assert signals.scored_under(signals.ledger(r.where("false"), policies, listed=True), policies).count() == 0
