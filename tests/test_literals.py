import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.functions.literals import folded, holds_any, required, required_by_any
from sievemark.operators.evidence import all_fragments
from sievemark.policy import GROUPS, Policy

KW = Policy().keywords
PATTERNS = [p for g in (*GROUPS, "negation", "service_verbs", "unit_statements", "operational_details", "bed_count", "cross_organization") for p in KW.group(g)]


@pytest.mark.parametrize(
    "pattern,literals",
    [
        (r"\bicu\b", ("icu",)), (r"licen[sc]e", ("licen",)), (r"[0-9]{3}-[0-9]{4}", ("-",)), (r"(a|b)?", ()), (r"x*", ()), (r"(?:abc|bcd)+z", ("abc", "bcd")), (r"(abc|.)", ()), (r"ab?cde", ("cde",)), ("é", ()), ("(", ()), (r"a(bc){2}d", ("bc",)), ("ABC", ("abc",)),
    ],
)
def test_required(pattern, literals):
    assert required(pattern) == literals


def test_required_by_any():
    assert required_by_any(["intensive care", "care", r"\bicu\b"]) == ("care", "icu") and required_by_any(["abc", ".*"]) == () and required_by_any([]) == ()


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_what_matches_holds_a_literal(data):
    pattern = data.draw(st.sampled_from(PATTERNS))
    text = data.draw(st.from_regex(re.compile(pattern, re.I | re.A)))
    low = text.translate(str.maketrans("ſıİ", "sii")).lower()
    assert any(x in low for x in required(pattern)) or not required(pattern)


def test_letters_that_fold(spark):
    texts = ["INTENſIVE care", "ıCU", "Keep İCU", "life ſupport", "no", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hit = lambda p: F.col("t").rlike(f"(?iU){p}")
    for p in ("intensive", "icu", "support", "keep"):
        rows = df.select(hit(p).alias("a"), holds_any(folded(F.col("t")), required(p)).alias("b")).collect()
        assert all(r["b"] for r in rows if r["a"]), p
    items = F.array(F.struct(F.lit("description").alias("field"), F.col("t").alias("text")))
    assert [len(r[0]) for r in df.select(all_fragments(items, KW)).collect()] == [2, 1, 1, 1, 0, 0]
