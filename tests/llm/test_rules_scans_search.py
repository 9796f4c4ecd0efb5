import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import license_scan, quality_rules, topk

from .conftest import words


def measures(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)


def test_ledger_against_brute_force(corpus, rows, empty):
    book = quality_rules.judged(quality_rules.ledger(corpus))
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in book.collect())
    assert got == sorted((str(d), *measures(t)) for d, t in rows)
    for r in book.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.ledger(empty).count() == 0


def test_policies_are_bits_of_one_ledger(corpus):
    book = quality_rules.ledger(corpus)
    a, b = (quality_rules.judged(book, quality_rules.POLICIES[v]).where("kept").count() for v in (1, 2))
    assert a >= b
    table = {(r["policy_version"], r["rule"]): (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablations(book).collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    for v, p in quality_rules.POLICIES.items():
        for rule in p.rules:
            bit = 1 << quality_rules.RULES.index(rule)
            assert table[(v, rule)] == (sum(x & bit > 0 for x in bits), sum(x & p.mask == bit for x in bits))
    kept = quality_rules.filtered(corpus)
    assert kept.columns == corpus.columns and kept.count() == b


def test_license_scan_against_brute_force(spark):
    texts = [
        "Released under the MIT License. mit-license again", "APACHE\nlicense", None, "", "mit", "GNU Lesser General Public License", "x\n// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\nmore",
        "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: ((MIT", "ends with mit", "license starts here", "é mit license é", "Licensed under CC BY-NC 4.0.", "All rights reserved",
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string").coalesce(1)
    got = {r["doc_id"]: r for r in license_scan.scanned(df).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = sorted((k, label) for p, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[6]["labels"] == "apache-2.0,gpl-3.0-only,mit" and got[6]["score"] == 1.0
    assert got[7]["labels"] == "gpl-2.0" and got[7]["score"] == 0.4
    assert got[8]["labels"] == "unparsed" and got[12]["labels"] == "cc-by-nc" and got[13]["score"] == 0.0
    assert got[5]["labels"] == "gpl,lgpl"


def test_expressions():
    assert license_scan.to_postfix("MIT or Apache-2.0 and ISC") == ["mit", "apache-2.0", "isc", "and", "or"]
    assert license_scan.evaluate(license_scan.to_postfix("GPL-3.0 OR MIT"))[1] == 1.0
    for bad in ("", "MIT AND", "(MIT", "OR MIT", "MIT)"):
        if bad == "MIT)":
            with pytest.raises(ValueError):
                license_scan.to_postfix(bad)
        else:
            with pytest.raises(ValueError):
                license_scan.to_postfix(bad)


@pytest.mark.parametrize("tile_bytes", [1 << 20, 256])
def test_exact_topk(spark, monkeypatch, tile_bytes):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    data += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)]  # ties
    data += [(2000, None), (2001, [1.0, None, 1.0, 1.0]), (2002, [math.nan, 1.0, 1.0, 1.0]), (2003, [math.inf, 1.0, 1.0, 1.0]), (2004, [1.0, 2.0]), (2005, []), (2020, [3.0, 3.0])]
    df = spark.createDataFrame([(i, v, "q", 1) for i, v in data], "vec_id long, embedding array<double>, tile string, dim int").repartition(4)
    packed = topk.packed
    monkeypatch.setattr(topk, "packed", lambda rows: packed(rows, tile_bytes))
    got = sorted(tuple(r) for r in topk.top_k(df, df.where(F.col("vec_id") % 20 == 0), 20).collect())
    good = [(i, v) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:20]
            want += [(q, k + 1, i, int(-s)) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), df.where("false"), 5).count() == 0


def test_exact_topk_of_zero_vectors(spark):
    # all products of a tile are 0, and the tile holds more vectors than 2**63 / 2**53
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(1500)], "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id in (3, 1499)"), 5).collect())
    assert got == [(3, k + 1, i, 0) for k, i in enumerate([0, 1, 2, 4, 5])] + [(1499, k + 1, k, 0) for k in range(5)]


def test_license_scan_of_a_long_text_grows_with_its_length(spark, empty):
    text = "cc by nc " * 60_000 + "creative commons attribution sharealike"
    row = license_scan.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "cc-by-nc,cc-by-sa" and row["n_notices"] == 60_001 and row["n_base"] == 0
    assert license_scan.scanned(empty).count() == 0
