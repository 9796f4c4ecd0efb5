import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.functions.names import region_label
from sievemark.operators import evaluate, evidence, extractors, ledger, proposals, scoring
from sievemark.policy import Policy
from sievemark.sources import tables

from .test_signals import rows


def test_an_arrow_plugin_scores_as_the_keyword_scan_does(spark):
    policy = Policy()
    plugin = extractors.plugged(extractors.keyword_plugin(policy.keywords), policy, listed=True)
    columns = ["unique_id", "classification", "capability_evidence_score", "fragments", "explicit_icu_claim", "icu_bed_count", "supporting_fields", "missing_evidence", *(f"{g}_signals" for g in ("explicit_icu", "equipment", "procedure", "staffing"))]
    got, want = (sorted(map(str, scoring.scored(rows(spark), policy, e, listed=True).select(*columns).collect())) for e in (plugin, None))
    assert got == want


def bad(change):
    def run(batches):
        for b in batches:
            n = b.num_rows
            table = {"unique_id": b.column(0), "field": pa.array(["description"] * n), "group": pa.array(["equipment"] * n), "pattern": pa.array(["p"] * n), "text": b.column(3), "ord": pa.array(range(n), pa.int64())}
            table |= change(n)
            yield pa.RecordBatch.from_pydict(table)

    return run


@pytest.mark.parametrize(
    "change,said",
    [
        (lambda n: {"ord": pa.array(["x"] * n)}, "must return"), (lambda n: {"more": pa.array([1] * n)}, "must return"), (lambda n: {"group": pa.array(["odd"] * n)}, "unknown group"),
        (lambda n: {"field": pa.array(["name"] * n)}, "unknown field"), (lambda n: {"text": pa.array([None] * n, pa.string())}, "missing value"),
    ],
)
def test_a_plugin_that_returns_something_else_is_told_so(spark, change, said):
    batch = pa.RecordBatch.from_pydict({"unique_id": ["a"], "ord": pa.array([0], pa.int32()), "field": ["description"], "text": ["t"]})
    assert len(list(extractors.checked(bad(lambda n: {}))(iter([batch])))) == 1
    with pytest.raises((TypeError, ValueError), match=said):
        list(extractors.checked(bad(change))(iter([batch])))


def test_fragments_of_another_extractor_in_order(spark):
    records = spark.createDataFrame([("a",), ("b",)], "unique_id string")
    fragments = spark.createDataFrame([("a", "description", "equipment", "p", "second", 2), ("a", "description", "equipment", "p", "first", 1)], "unique_id string, field string, group string, pattern string, text string, ord long")
    got = {r["unique_id"]: [f["text"] for f in r["fragments"]] for r in evidence.contract(records, fragments).collect()}
    assert got == {"a": ["first", "second"], "b": []}


def test_ranges_that_drifted(spark):
    schema = "k long, v string, w int"
    saved = [(i, f"v{i}", i) for i in range(40)] + [(3, "v3", 3)]
    now = [*saved[::-1][:-5], (0, "v0", 0), (1, None, 1), (2, "v2", 2), (3, "v3", 3), (4, "v4", 4), (55, "new", 1)]
    now = [r for r in now if r[0] < 30 or r[0] > 50] + [(30, "", 30)] + [(i, f"v{i}", i) for i in range(31, 40)]
    of = lambda data: ledger.range_fingerprints(spark.createDataFrame(data, schema).repartition(3), ["k", "v", "w"], F.floor(F.col("k") / 10))
    got = {r["key_range"]: (r["n_saved"], r["n_now"], r["drift"]) for r in ledger.drifted_ranges(of(saved), of(now)).collect()}
    assert got == {0: (11, 11, "changed"), 1: (10, 10, "same"), 2: (10, 10, "same"), 3: (10, 10, "changed"), 5: (0, 1, "added")}
    parts = of(saved[:17]).unionByName(of(saved[17:]))
    assert {r["drift"] for r in ledger.drifted_ranges(ledger.merged_fingerprints(parts), of(saved[::-1])).collect()} == {"same"}
    assert ledger.drifted_ranges(of(saved[:1]), of(saved).where("false")).first()["drift"] == "removed"
    # a null is not an empty text, and cells don't run together
    assert ledger.drifted_ranges(of([(1, None, 1)]), of([(1, "", 1)])).first()["drift"] == "changed"


def test_deletions_and_row_hashes(spark):
    log = spark.createDataFrame([("a", "2024-01-01", "save"), ("b", "2024-01-01", "save"), ("b", "2024-01-02", "delete")], "id string, created_at string, event string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r["id"]: r["existed"] for r in ledger.deletions(ids, log).collect()} == {"a": True, "b": False, "c": False}
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "a int, b string")
    assert [len({r[0] for r in df.select(ledger.row_hash(["a", "b"], d)).collect()}) for d in (8, 16)] == [2, 2]
    assert df.select(ledger.row_hash(["b", "a"])).first()[0] == hashlib.sha256(b'{"b":"x","a":1}').hexdigest()[:16]


def test_what_forbids_to_go_on(spark):
    manifest = spark.createDataFrame([("m1", None, "5")], "model string, prompt string, size string")
    got = {r["field"]: (r["recorded"], r["current"]) for r in proposals.incompatibilities(manifest, {"model": "m1", "prompt": "p", "size": "6"}).collect()}
    assert got == {"prompt": (None, "p"), "size": ("5", "6")}


def test_rates_and_distributions(spark):
    results, errors = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "icu_subtypes array<string>"), spark.range(1)
    assert tuple(evaluate.error_rate(results, errors).first()) == (4, 1, 25.0)
    assert evaluate.error_rate(results.where("false"), errors.where("false")).first()["error_pct"] is None
    assert {r["subtype"]: r["n"] for r in evaluate.subtype_distribution(results).collect()} == {"a": 2, "b": 1}


def test_raw_files_as_tables_and_their_hash(spark, tmp_path):
    for name, text in (("a", "x,y\n1,\n"), ("b", "x,y\n2,z\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    tables.register_raw(spark, {"first": str(tmp_path / "a.csv")}, {"first": "raw_first"})
    assert [tuple(r) for r in spark.table("raw_first").collect()] in ([("1", None)], [("1", "")])
    tables.register_raw(spark, {"first": str(tmp_path / "b.csv")}, {"first": "raw_first"})
    assert [tuple(r) for r in spark.table("raw_first").collect()] == [("2", "z")]
    with pytest.raises(ValueError):
        tables.register_raw(spark, {"first": str(tmp_path / "b.csv")}, {"first": "raw; drop"})
    spark.sql("DROP TABLE raw_first")
    each = sorted(hashlib.sha256((tmp_path / f"{n}.csv").read_bytes()).hexdigest() for n in "ab")
    assert tables.file_hash(spark, str(tmp_path / "*.csv")) == hashlib.sha256("".join(each).encode()).hexdigest()[:16]


def test_region_labels(spark):
    df = spark.createDataFrame([("Goa", "North Goa"), ("Goa", None)], "state string, district string")
    assert [r[0] for r in df.select(region_label(F.col("state"), F.col("district"))).collect()] == ["Goa / North Goa", "Goa"]


def test_torn_lines_of_a_split_file_are_skipped_and_counted(spark, tmp_path):
    lines = [f'{{"k": {i}, "v": "{"x" * 50}"}}' for i in range(2000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n\n" + lines[0][:30])
    (tmp_path / "b.jsonl").write_text('{"k": "no number"}\nnull nonsense\n{"k": 5000}\n{}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, torn = tables.split_json_lines(spark, str(tmp_path), "k long, v string")
        assert rows.rdd.getNumPartitions() > 5
        keys = sorted((r["k"] is None, r["k"]) for r in rows.collect())
        assert [k for _, k in keys] == [*range(2000), 5000, None]
        assert sorted(r["line"] for r in torn.collect()) == sorted([lines[0][:30], '{"k": "no number"}', "null nonsense"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(tables.MissingInput):
        tables.split_json_lines(spark, str(tmp_path / "none"), "k long")
