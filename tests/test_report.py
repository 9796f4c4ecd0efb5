import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import audit, quantiles, regions, report, scoring
from sievemark.policy import Policy, Thresholds

from .test_signals import rows


def table(df):
    return sorted((r["section"], r["metric"], r["key"] or "", None if r["value"] is None else round(r["value"], 6)) for r in df.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_one_grouping_says_what_the_parts_say(spark, empty):
    policy = Policy(thresholds=Thresholds(sufficient_completeness=40))
    r = rows(spark).withColumns({"geo_source": F.lit("none"), "district_final": F.when(F.col("number_doctors_int") > 2, F.col("name")), "organization_type": F.when(F.col("capacity_int") > 20, F.lit("dental clinic " * 5))})
    s = scoring.scored(r.where("false") if empty else r, policy, listed=True).cache()
    states, districts = (regions.rollup(s, x, policy) for x in ("state", "district"))
    want = audit.report(s, states, districts, policy).unionByName(audit.boundary_summary(s, policy))
    facts = report.facts(s, policy).cache()
    assert table(report.fused(facts, policy)) == table(want)


@pytest.mark.parametrize("few", [quantiles.FEW, 0])
def test_percentiles_of_a_hot_group(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(8)
    data = [("hot", float(x)) for x in rng.integers(0, 400, 3000)] + [(None, float(x)) for x in rng.normal(0, 1, 50)] + [("one", 7.0), ("none", None), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    names = {"p5": 0.05, "median": 0.5, "p95": 0.95, "least": 0.0, "most": 1.0}
    got = {r["g"]: r for r in quantiles.exact_percentiles(df, ["g"], "x", names).collect()}
    assert set(got) == {"hot", None, "one", "two", "same"}
    want = {r["g"]: r for r in df.groupBy("g").agg(F.count("x").alias("n"), *(F.percentile("x", q).alias(n) for n, q in names.items())).collect()}
    for g, r in got.items():
        assert tuple(r) == tuple(want[g][c] for c in r.asDict())
    whole = quantiles.exact_percentiles(df, [], "x", names).first()
    assert tuple(whole) == tuple(df.agg(F.count("x").alias("n"), *(F.percentile("x", q) for q in names.values())).first())
    assert quantiles.exact_percentiles(df.where("false"), ["g"], "x", names).count() == 0
    counted = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("times"))
    assert sorted(map(str, quantiles.exact_percentiles(counted, ["g"], "x", names, weight="times").collect())) == sorted(map(str, got.values()))


def test_spread_statistics_are_the_plain_ones(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 99.0), ("a", 100.0), (None, 5.0), (None, None), ("b", None)], "g string, s double")
    for keys in (None, ["g"]):
        a, b = (sorted(map(str, audit.score_stats(df, "s", keys, spread=x).collect())) for x in (False, True))
        assert a == b
