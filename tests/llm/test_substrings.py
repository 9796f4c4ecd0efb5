"""The two substring operators and the near duplicates against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievemark.llm import near_dedup, rlz_dedup, suffix_dedup
from sievemark.llm.passages import anchor_rows, keyed
from sievemark.llm.wordscan import Runs, Words, anchors, leftmost_minima, text_chunks

from .conftest import words


def covered_words(w, starts, n):
    out, last = [False] * len(w), -1
    for i in range(len(w)):
        if i in starts:
            last = i + n - 1
        out[i] = i <= last
    return out


@pytest.mark.parametrize(("window", "seed"), [(35, 6), (10, 3)])
def test_rlz_removes_what_brute_force_removes(corpus, rows, window, seed):
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    want = []
    for d, t in rows:
        w = words(t)
        gone = covered_words(w, {i for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1}, window)
        want.append((str(d), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz_dedup.removed(corpus, window, seed).collect()]
    assert sorted(got) == sorted(want)


def test_suffix_array_finds_later_copies(spark, corpus, rows):
    n = 20
    unique = corpus.select("doc_id", "text").distinct()
    kept = [(r["doc_id"], r["text"]) for r in unique.collect()]
    ids = [d for d, _ in kept]
    # order among rows of one id is by a hash of the text: brute force looks at the other ids
    plain = unique.join(spark.createDataFrame([(d,) for d in {i for i in ids if i is not None and ids.count(i) == 1}], "doc_id long"), "doc_id", "left_semi")
    texts = sorted((r["doc_id"], r["text"]) for r in plain.collect() if r["text"] is not None)
    first, want = {}, set()
    for d, t in texts:
        w = words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), (d, i))
    for d, t in texts:
        w = words(t)
        gone = covered_words(w, {i for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] != (d, i)}, n)
        want |= {(d, i) for i, g in enumerate(gone) if g}
    spans = suffix_dedup.duplicate_spans(plain, n, 5).collect()
    assert {(r["doc_id"], i) for r in spans for i in range(r["start_word"], r["end_word"])} == want
    assert all(r["n_words"] >= n and r["ref_doc_id"] <= r["doc_id"] for r in spans)
    after = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(plain, n, 5).collect()}
    for d, t in texts:
        lost = {i for x, i in want if x == d}
        assert after[d] == (t if not lost else " ".join(x for i, x in enumerate(words(t)) if i not in lost))


@pytest.mark.parametrize(("n", "seed"), [(50, 8), (12, 3)])
def test_suffix_array_with_repeated_and_missing_ids(spark, corpus, n, seed):
    # beside the corpus: passages that share their beginnings, their ends and single words at many lengths
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 30, 400)]
    more = [(1000 + k % 7, " ".join([f"k{k}"] * (k % 5) + base[k * 3 : k * 3 + 40 + 5 * k] + [f"e{k}"] + base[: 45 + k])) for k in range(40)]
    more += [(None, " ".join(base[100:180])), (None, " ".join(base[90:170])), (1001, "w1 " * 200)]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts = keyed(docs)
    rows = {(r["doc_id"] is not None, r["doc_id"] or 0, r["fp"]): words(r["text"]) for r in texts.collect()}
    first, want = {}, set()
    for key in sorted(rows):
        w = rows[key]
        for i in range(len(w) - n + 1):
            if first.setdefault(tuple(w[i : i + n]), (key, i)) != (key, i):
                want.add((key, i))
    # small batches, too: neighbours are held against each other across them
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000 if n == 50 else 3)
    try:
        got = suffix_dedup.later_copies(texts, n, seed).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {((r["doc_id"] is not None, r["doc_id"] or 0, r["fp"]), i) for r in got for i in range(r["lo"], r["lo"] + r["cnt"])} == want and want


def test_suffix_array_rows(spark):
    texts = keyed(spark.createDataFrame([(k, " ".join(f"v{(k // 2 * 7 + j) % 1000}" for j in range(300))) for k in range(60)], "doc_id long, text string"))
    array = suffix_dedup.suffix_array(anchor_rows(texts, 50, 8, suffix=True), 50).collect()
    assert sum(r["cnt"] for r in array if r["again"]) >= 29 * 251 and all(0 < r["shared"] <= 50 and r["cnt"] > 0 for r in array)
    assert suffix_dedup.duplicate_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_keeps_rows_and_columns(corpus):
    out = suffix_dedup.deduplicated(corpus)
    assert out.columns == corpus.columns and out.count() == corpus.count()
    assert out.where("doc_id = 6").first()["text"] is None
    assert out.where("doc_id = 0").first()["text"] == corpus.where("doc_id = 0").first()["text"]
    assert out.where("doc_id = 1").first()["text"] == ""
    assert out.where("text is not null and n_chars <> char_length(text)").count() == 0


def test_greedy_factors():
    f = lambda *p: [x.tolist() for x in rlz_dedup.greedy_factors(*(np.array(c) for c in zip(*p)))]
    # two pieces of one reference are one factor, though another document has the first longer
    assert f((0, 40, 1, 5), (20, 60, 1, 5), (0, 45, 2, 9)) == [[0], [60]]
    # the farthest first, the next from where it ends
    assert f((0, 50, 1, 0), (30, 90, 2, 7), (100, 140, 1, 0)) == [[0, 50, 100], [50, 90, 140]]


def test_near_duplicate_classes(corpus, rows):
    threshold = 0.8
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for w in (words(t) for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= threshold * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = sorted((str(d), str(min((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for d in g)
    got = near_dedup.classes(corpus, threshold)
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got.collect()) == want


def test_near_dedup_keeps_one_of_each_class(corpus, empty):
    out = near_dedup.deduplicated(corpus)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert out.columns == corpus.columns and 0 in ids and 1 not in ids and 2 not in ids and ids.count(3) == 1
    assert {6, 7, 8, 9}.issubset(ids) and 10 not in ids
    assert near_dedup.deduplicated(empty).count() == 0


def test_near_dedup_judges_rows_not_ids(spark, corpus):
    # row 14 that copies document 0 goes, though another row 14 stays
    assert near_dedup.deduplicated(corpus).where("doc_id = 14").count() == 1
    rng = np.random.default_rng(11)
    lexicon = [f"w{i}" for i in range(500)]
    a, b, c, d = (list(rng.choice(lexicon, 150)) for _ in range(4))
    near = lambda w: " ".join([*w[:-1], "changed"])
    data = [(None, " ".join(a)), (None, near(a)), (None, " ".join(b)), (1, near(b)), (2, " ".join(c)), (2, near(c)), (2, " ".join(d)), (2, " ".join(d)), (3, near(d)), (None, None), (None, None), (4, "")]
    out = near_dedup.deduplicated(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    family = {**{" ".join(w): k for k, w in zip("abcd", (a, b, c, d))}, **{near(w): k for k, w in zip("abcd", (a, b, c, d))}}
    got = sorted((family.get(r["text"], "none"), str(r["doc_id"])) for r in out)
    assert got == [("a", "None"), ("b", "1"), ("c", "2"), ("d", "2"), ("none", "4"), ("none", "None")]


@pytest.mark.parametrize("changes, most", [(3, 8), (4, 1)])
def test_copies_that_are_not_near_are_not_measured(spark, monkeypatch, changes, most):
    """Copies of one text with words of their own are some 0.66 to 0.73 alike: all share a band and
    early shingles. Few pairs of them are measured (``most`` a text), and all near ones are found."""
    asked = []
    measured = near_dedup._measured

    def counting(pairs, sets):
        asked.append(pairs.count())
        return measured(pairs, sets)

    monkeypatch.setattr(near_dedup, "_measured", counting)
    rng = np.random.default_rng(changes)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    for n in (100, 300):
        texts = []
        for k in range(n):
            w = list(base)
            for at in rng.choice(200, changes, replace=False):
                w[at] = f"own{k}x{at}"
            texts.append(w)
        for k in range(0, n, 10):  # near copies of some: one word more is changed
            w = list(texts[k])
            w[int(rng.integers(200))] = f"more{k}"
            texts.append(w)
        sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in texts]
        comp = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                common = len(sets[i] & sets[j])
                if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                    old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                    comp = [new if c == old else c for c in comp]
        asked.clear()
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()} == dict(enumerate(comp))
        assert sum(asked) <= most * len(texts), (sum(asked), len(texts))


def test_weighted_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype("uint64")
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    sig = near_dedup.signatures(np.concatenate([a, b]), np.array([2000, 2000]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.09


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_anchors_give_each_run_one_place():
    import pyarrow as pa

    text = pa.array(["a b c d e f g h i j k l", "z z z z z z z z", "c d e f g h i j"])
    ((_, _, data, offsets),) = text_chunks(text)
    w = Words(data, offsets)
    at, seeds, lo, hi = anchors(w, Runs(w.hashes()), 2, 3)
    covered = [(w.text_of()[a], s) for a, x, y in zip(at, lo, hi) for s in range(x, y + 1)]
    assert len(covered) == len(set(covered)) == sum(max(0, c - 3) for c in w.counts())
    assert leftmost_minima(np.array([3, 1, 2, 1, 5]), 3).tolist() == [1, 1, 3]


def test_empty_tables(empty):
    assert rlz_dedup.removed(empty).count() == suffix_dedup.duplicate_spans(empty).count() == near_dedup.classes(empty).count() == suffix_dedup.deduplicated(empty).count() == 0
