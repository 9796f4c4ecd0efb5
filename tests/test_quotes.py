import re

import numpy as np
import pytest

from sievemark.operators import quotes


def brute(asked, texts):
    out = []
    for q, quote in set(asked):
        tokens = (quote or "").split()
        if not tokens:
            continue
        for t, text in texts:
            if m := re.search(r"\s+".join(map(re.escape, tokens)), text or ""):
                out.append((q, quote, t, m.group(0)))
    return sorted(out, key=repr)


def test_passages_that_begin_or_end_inside_words(spark):
    asked = [(1, "heti. one two three"), (2, "alpha beta gamma delta"), (3, "eti"), (4, "ab cd"), (5, "  "), (6, None), (7, "x"), (8, "[a-z]+ (b) \\d \\E"), (9, "nowhere at all here"), (9, "two  three"), (10, "é ü"), (11, "beta"), (12, "🙂")]
    texts = [
        (1, "***heti. one\n two three***"), (2, "***alpha beta gamma delta***"), (2, "alphabeta gamma delta"), (3, "zzab cdzz"), (4, "ab  cd"), (5, ""), (6, None), (None, "alpha beta gamma deltas"), (7, "p[a-z]+ (b) \\d \\Eq"),
        (8, "heti. one two three heti. one two three"), (9, "aé ü🙂b"), (10, "ab\ncx"), (11, "ab cd"), (11, "ab cd"), (12, "x" * 100_000 + "beta"), (13, "word " * 50_000 + "alpha beta gamma delta"),
    ]
    a = spark.createDataFrame(asked, "item int, said string")
    t = spark.createDataFrame([(i, x, 1, "k") for i, x in texts], "doc int, body string, n int, key string").repartition(3)
    got = sorted((tuple(r) for r in quotes.found_quotes(a, t, "item", "said", "doc", "body").collect()), key=repr)
    assert got == brute(asked, texts)
    assert quotes.found_quotes(a.where("false"), t, "item", "said", "doc", "body").count() == 0
    assert quotes.found_quotes(a, t.where("false"), "item", "said", "doc", "body").count() == 0


@pytest.mark.parametrize("marks", [1 << 18, 2])
def test_random_quotes_against_brute_force(spark, monkeypatch, marks):
    monkeypatch.setattr(quotes, "MARKS", marks)
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(rng.choice(list("ab \n"), n, p=[0.35, 0.35, 0.25, 0.05]))
    texts = [(i, prose(int(rng.integers(0, 60)))) for i in range(40)]
    asked = [(i, prose(int(rng.integers(1, 14)))) for i in range(60)]
    a, t = spark.createDataFrame(asked, "item int, said string"), spark.createDataFrame(texts, "doc int, body string")
    got = sorted((tuple(r) for r in quotes.found_quotes(a, t, "item", "said", "doc", "body").collect()), key=repr)
    assert got == brute(asked, texts)
