import json

from pyspark.sql import functions as F

from sievemark.operators import geography
from sievemark.operators.profile import run_counters
from sievemark.plans import build as plan

from .test_engine import records


def directory(spark):
    rows = [("411001", "maharashtra", "pune", "18.5", "73.8"), ("4110 01", "Maharastra", "PUNE", " 18.7", "73.6"), ("411001", "Goa", None, "0", "0"), ("x", "Goa", "a", "1", "2"), ("560001", None, "bengaluru", "na", ""), ("560001", "mars", "bengaluru", None, "77"), (None, "Goa", "b", "3", "4")]
    return spark.createDataFrame(rows, "pincode string, statename string, district string, latitude string, longitude string")


def test_counters_are_those_of_the_tables(spark, tmp_path):
    raw = records(spark, [{"address_zipOrPostcode": "411001", "description": "A 10 bed ICU"}, {"address_zipOrPostcode": "560001"}, {}])
    raw = raw.unionByName(raw.limit(1))
    tables = plan.run(spark, raw, directory(spark), str(tmp_path / "out"))
    seen = json.loads(spark.read.text(str(tmp_path / "out" / "run_summary")).first()[0])["counters"]
    want = {r["metric"]: r["value"] for r in run_counters(raw, tables["facilities_scored"], tables["facilities_scored"]).collect()}
    assert seen == want and seen["rows_in"] == 4 and seen["rows_out"] == 3
    assert tables["region_state"].agg(F.sum("facility_count")).first()[0] == 3


def test_rollup_reads_each_text_once(spark, monkeypatch):
    def said():
        return {r["pincode_clean"]: r for r in geography.postal_rollup(directory(spark)).collect()}

    got = said()
    assert set(got) == {"411001", "560001"}
    a, b = got["411001"], got["560001"]
    assert (a["pin_state"], a["pin_district"], a["n_offices"], a["n_valid_coords"], a["n_states_seen"]) == ("Maharashtra", "Pune", 3, 2, 2)
    assert round(a["pin_lat"], 6) == 18.6 and round(a["pin_lon"], 6) == 73.7
    assert (b["pin_state"], b["pin_district"], b["n_offices"], b["n_valid_coords"], b["pin_lat"], b["n_states_seen"]) == ("Mars", "Bengaluru", 2, 0, None, 1)
    monkeypatch.setattr(geography, "BROADCAST_TEXTS", 0)
    assert said() == got
