import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import chat_format, collocations, hard_negatives
from sievemark.llm.queries import ORACLE_SQL, QUERIES


def phrases(docs, longest, least, top):
    """Brute force: (lang, rank, phrase, a, l, r, n, score)."""
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            count.update((lang, *w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    candidates = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    inner = {(p[0], *p[i:j]): a for p, a in sorted(candidates.items(), key=lambda x: x[1]) for i in range(1, len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) - 1}
    out = {}
    for p, a in candidates.items():
        if 100 * inner.get(p, 0) >= 100 * a:
            continue
        lang, w = p[0], p[1:]
        cuts = [(1000 * a * total[lang] // (count[(lang, *w[:k])] * count[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[(lang, *w[:k])], count[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("max_bytes,most_bits", [(1 << 24, 28), (64, 15), (1 << 10, 3)])
def test_collocations_against_brute_force(spark, max_bytes, most_bits):
    rng = np.random.default_rng(3)
    lexicon = ["a", "of", "the", "Sea", "é", "ÉA", "x y", "river-bank", "z" * 70]
    prose = lambda n: "".join(w + s for w, s in zip(rng.choice(lexicon, n), rng.choice([" ", "  ", "\t", ", ", "\n", " ", " ", "\r\n", "!"], n)))
    docs = [(("en", "de", None, "und", "fr\nx", "")[i % 6], prose(60)) for i in range(40)]
    docs += [("en", None), (None, ""), ("en", " \t.\n"), ("en", "once only here"), ("long", prose(3000)), ("long", "one two " * 500), ("x", "the sea of a river")]
    docs += [docs[0], docs[0]]
    df = spark.createDataFrame([(t, lang, 1, "w", "p") for lang, t in docs], "text string, lang string, n int, w1 string, phrase string").repartition(3)
    for least, top in ((5, 10), (20, 2000)):
        got = sorted(tuple(r)[:8] for r in collocations.collocations(df, 5, least, top, max_bytes=max_bytes, most_bits=most_bits).collect())
        assert got == phrases(docs, 5, least, top)
    assert collocations.collocations(df.where("false")).count() == 0


def test_scores_pass_64_bits(spark):
    big = 2_000_000_000_000
    row = spark.range(1).select(collocations.score_of(*(F.lit(x) for x in (big, 3 * big, big + 1, big))).alias("s")).first()
    assert row["s"] == 1000 * big * 3 * big // ((big + 1) * big)


def negatives(rows, anchor, positives=5, k=10):
    good = [(i, lab, v) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in good:
        if not anchor(i):
            continue
        s = [(-sum(int(x) * int(y) for x, y in zip(v, w)), j, other) for j, other, w in good if j != i and len(v) == len(w)]
        for p, j, _ in sorted(x for x in s if x[2] == lab)[:positives]:
            window = sorted(x for x in s if x[2] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p)[:k]
            out += [(i, j, r + 1, n, -p, -sc, other) for r, (sc, n, other) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("tree_bytes,leaf,scale", [(1 << 21, 128, 1), (1 << 10, 4, 1), (1 << 10, 4, 10**8)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, tree_bytes, leaf, scale):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 4)), [float(scale * x) for x in rng.integers(-4, 9, 5)]) for i in range(260)]
    rows += [(1000 + i, i % 3, [float(2 * scale)] * 5) for i in range(60)]  # ties
    rows += [(10, 1, [float(scale)] * 5), (10, 1, [float(scale)] * 5), (30, 0, [3.0 * scale] * 5), (7, 2, [3.0 * scale] * 5)]  # repeated ids
    rows += [(2000, None, [1.0] * 5), (2001, 1, None), (2002, 1, [1.0, None, 1.0, 1.0, 1.0]), (2003, 1, [math.nan] * 5), (2004, 1, [math.inf] * 5), (None, 1, [1.0] * 5)]
    rows += [(3000, 0, []), (3001, 0, []), (3010, 1, []), (3020, 0, [1.0, 2.0]), (3021, 0, [2.0, 2.0]), (3022, 1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, key string, id int, dim int").repartition(4)
    trees, tree_of = hard_negatives.packed_trees, hard_negatives.tree_of
    monkeypatch.setattr(hard_negatives, "packed_trees", lambda r: trees(r, tree_bytes))
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "tree_of", lambda i, lab, d: tree_of(i, lab, d, leaf, 3))
    monkeypatch.setattr(hard_negatives, "FAN_IN", 3)
    got = sorted(tuple(r) for r in hard_negatives.mined(df, F.col("vec_id") % 10 == 0).collect())
    assert got == negatives(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mined(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_boxes_hold_their_rows_and_prune():
    rng = np.random.default_rng(2)
    ids, labels, data = np.arange(3000), rng.integers(0, 3, 3000), np.floor(rng.normal(0, 40, (3000, 2)))
    i, lab, d, nodes, low, high = hard_negatives.tree_of(ids, labels, data, 32, 8)
    assert sorted(i.tolist()) == ids.tolist() and (labels[i] == lab).all() and (data[i] == d).all()
    for (a, b, child, end, first, last), lo, hi in zip(nodes, low, high):
        assert (d[a:b].min(axis=0) == lo).all() and (d[a:b].max(axis=0) == hi).all() and first == lab[a:b].min() and last == lab[a:b].max()
        assert end == child or (nodes[child, 0], nodes[end - 1, 1]) == (a, b)
    assert (nodes[-1, 0], nodes[-1, 1]) == (0, 3000)
    tree = hard_negatives.Tree(2, *(np.ascontiguousarray(x).tobytes() for x in (i, lab, d, nodes, low, high)))
    tree.meet(np.array([[30.0, 40.0]]))
    found = tree.best(0, -1, 1, True, 5, None, None)
    scores = data @ np.array([30.0, 40.0])
    assert found == sorted((-scores[j], j, 1) for j in range(3000) if labels[j] == 1)[:5]
    assert len(tree._scores) < 12  # of about a hundred leaves


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "[\\[INST]", "<<SYS>><</SYS>>", "<<<SYS>>", "[", "<", "\\", "\\s>", "a\nb", "é😀", "", None, "[ROLE]x[SAYS]y[/ROLE]", "<s></s", "/s>"]
    rows = []
    for i, t in enumerate(nasty):
        rows += [(i, 0, "user", t), (i, 1, "assistant", t), (i, 2, "user", "more"), (i, 3, "assistant", nasty[i - 1])]
    rows += [(100, 0, "system", "s"), (100, 1, "user", "u"), (100, 2, "assistant", "a"), (101, 0, "user", "u"), (101, 1, "user", "u"), (101, 2, "assistant", "a"), (102, 0, "system", "s")]
    rows += [(103, 5, "tool[SAYS]", "t"), (103, 1, None, "n"), (103, None, "user", "first"), (103, 5, "assistant", "tie"), (103, 5, "assistant", "tie")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "a"), (104, 0, "user", "long " * 200_000), (104, 1, "assistant", "answer")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, place int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        out = chat_format.formatted(df)
        lines = out.collect()
        got = {r["conv_id"]: r for r in chat_format.read_back(out, in_order=True).collect()}
        # once more from rows in any order
        again = {r["conv_id"]: r for r in chat_format.read_back(out.repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == again and len(lines) == len(rows)
    assert chat_format.read_back(chat_format.formatted(df.where("false"))).count() == 0
    whole = Counter()
    for r in lines:
        body = "".join(s["text"] for s in r["segments"])
        whole[r["conv_id"]] += len(body)
        # marks stand at their places only
        for m in chat_format.DEFAULT.controls():
            assert body.count(m) == sum(s["text"] == m for s in r["segments"])
        assert [s["text"] for s in r["segments"] if s["loss"]] == ([chat_format.Escapes(chat_format.DEFAULT).put(next(t or "" for c, n, role, t in rows if (c, n, role) == (r["conv_id"], r["turn"], r["role"])))] if r["role"] == "assistant" else [])
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if n is None else n, role or "", t or "") for i, n, role, t in rows if i == c))
        learned = "".join(t for _, role, t in mine if role == "assistant")
        want = (c, len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), whole[c], c not in (101, 102, 103))
        assert tuple(got[c]) == want


def test_turn_order_machine():
    def state(*roles):
        s = chat_format.TURN_ORDER.start
        for r in roles:
            s = chat_format.TURN_ORDER.after(s, r)
        return s

    assert state("system", "user", "assistant", "user", "assistant") == "assistant"
    assert state("system", "user") == "user" and state("user", "system", "user", "assistant") == "bad"
    assert all(state(*x) == "bad" for x in (["assistant"], ["system", "system"], ["user", "user"], ["user", "tool"]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_hard_negatives", "op13_chat_format"])
def test_queries_say_what_their_sql_says(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, mine[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist()))
