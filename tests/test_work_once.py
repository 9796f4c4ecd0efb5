"""Work that is done once, or not at all: what is asked of the plans rather than of the results."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.functions.text import any_of, stripped
from sievemark.operators import evidence, extractors, proposals
from sievemark.plans.queries import QUERIES
from sievemark.policy import GROUPS, Keywords

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["q_gap_audit", "q_trusted_audit", "q_facility_table", "q_barely_trusted"])
def test_records_are_scored_before_they_are_sorted_or_counted(spark, name):
    # the parts and the sort's samples read the scored records, not the documents again
    assert not [f for f in QUERIES[name](spark, SF).inputFiles() if "documents" in f]


def test_a_text_block_works_out_its_items_once(spark):
    # F7
    item = F.struct(F.lit("description").alias("field"), F.concat("v", F.lit(" marked")).alias("text"))
    df = spark.createDataFrame([("a",), ("b",)], "v string").select(proposals.text_block(F.array(item)).alias("b"))
    assert plan(df).count(" marked") == 1
    assert sorted(r["b"] for r in df.collect()) == ["[description]\n- a marked", "[description]\n- b marked"]


def test_white_space_within_a_text_is_not_searched(spark):
    # F3 to F7, F9, F10: in time that grows with the text, whatever stands in it
    inside = "a" + " " * 400_000 + "b"
    began = time.time()
    got = spark.createDataFrame([("　\x85" + inside + " \n",)], "v string").select(stripped(F.col("v")).alias("v")).first()["v"]
    assert got == inside and time.time() - began < 20


def test_no_scan_for_any_pattern_where_all_have_literals(spark):
    # F8
    kw = Keywords()
    df = spark.createDataFrame([("x",)], "text string").select(evidence.all_fragments(F.array(F.struct(F.lit("description").alias("field"), "text")), kw, windows=False).alias("f"))
    assert any_of([p for g in GROUPS for p in kw.group(g)]) not in plan(df)


def test_the_plug_in_searches_for_literals_first(monkeypatch):
    # F6
    searched, compile_ = [], extractors.re.compile

    class Counted:
        def __init__(self, rx):
            self.rx = rx

        def search(self, text):
            searched.append(text)
            return self.rx.search(text)

    with monkeypatch.context() as m:
        m.setattr(extractors.re, "compile", lambda *a: Counted(compile_(*a)))
        run = extractors.keyword_plugin(Keywords(explicit_icu=("licen[sc]e",), equipment=(), procedure=(), staffing=("[a-z]+@[a-z]+",), specialty_context=(), negation=("all rights",)))
    batch = lambda *texts: pa.RecordBatch.from_arrays([pa.array(["a"] * len(texts)), pa.array([0] * len(texts)), pa.array(["description"] * len(texts)), pa.array(list(texts))], names=["unique_id", "ord", "field", "text"])
    assert sum(b.num_rows for b in run(iter([batch("nothing here")]))) == 0 and searched == []
    assert [x for b in run(iter([batch("a LİCENſE", "x@y")])) for x in b.column(2).to_pylist()] == ["explicit_icu", "staffing"]
    assert len(searched) == 2


def test_a_source_without_the_quotes_words_is_not_collapsed(spark):
    # found as before, whatever the white space
    rows = [("a  b", "x a\n\tb y", "a\n\tb"), (" b y ", "x a b  y", "b  y"), ("a c", "a b c", None), ("", "a", None), ("none of it", "a  b", None), (None, "a", None)]
    df = spark.createDataFrame(rows, "q string, s string, want string").withColumn("got", proposals.located("q", "s"))
    assert all(r["got"] == r["want"] for r in df.collect())
    assert "forall" in plan(df)
