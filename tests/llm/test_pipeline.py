from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm.queries import ORACLE_SQL, QUERIES

from .conftest import words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_empty_tables(spark, corpus, empty):
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    now = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert "bin_id" in last.columns and last.count() == 0


def test_run(spark):
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, SF)
    per = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert per and all(0 <= n <= len(words(docs[d])) for d, n in per.items())
    assert all(len(words(docs[d])) >= 50 for d in per)


def test_packed_sequences_follow_the_mix(spark, monkeypatch):
    # two sources of documents of one length, one source's ids all before the other's
    data = [(i, " ".join(f"w{i}x{j}" for j in range(512)), "a" if i < 60 else "b") for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)

    def packed(weights):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        out = corpus_pipeline.packing_stage(spark, corpus_pipeline.mixing_stage(spark, docs, ""), "").collect()
        assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, t) for i, t, _ in data)
        return [r["source"] for r in sorted(out, key=lambda r: (r["bin_id"], r["bin_offset"]))]

    even, more_b = packed({"a": 1.0, "b": 1.0}), packed({"a": 1.0, "b": 3.0})
    assert even != more_b
    # any stretch of the packed words stays near its sources' shares while neither has run out
    for order, share in ((even, 0.5), (more_b, 0.75)):
        for n in (16, 32, 48, 64):
            assert abs(order[:n].count("b") - share * n) <= 8


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(SF).is_dir():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    as_rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert as_rows(mine) == as_rows(theirs)
