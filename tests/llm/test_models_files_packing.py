import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import ctw, mixing, packing, shared, token_files
from sievemark.llm.shared import running_totals

from .conftest import words


def test_running_totals(spark):
    rng = np.random.default_rng(2)
    data = [(["a", "b", None][i], int(o), int(v)) for i, o, v in zip(rng.choice(3, 500, p=[0.9, 0.05, 0.05]), rng.permutation(500), rng.integers(0, 9, 500))]
    df = spark.createDataFrame(data, "k string, o int, v long")
    for keys in (["k"], []):
        total, seen = defaultdict(int), defaultdict(int)
        want = set()
        for k, o, v in sorted(data, key=lambda r: (str(r[0]), r[1]) if keys else r[1]):
            key = k if keys else 0
            want.add((o, total[key], seen[key]))
            total[key] += v
            seen[key] += 1
        assert {(r["o"], r["before"], r["rank"]) for r in running_totals(df, keys, ["o"], "v").collect()} == want


@pytest.mark.parametrize("bits", [16, 18])
def test_coder_round_trip(bits):
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 1 << bits, 5000), np.zeros(3000, int), np.tile(np.arange(7), 700), np.array([], int), np.array([(1 << bits) - 1])):
        ids = ids.astype("uint32")
        lengths = np.array([x for x in (len(ids) // 3, len(ids) - len(ids) // 3) if x], "int64")
        payload = b"".join(token_files.encode_blocks(ids, lengths, bits)) if len(ids) else b""
        assert (token_files.decode_blocks(token_files.split_payload(payload)) == ids).all()


def test_coder_learns_and_notices_damage():
    ids = np.tile(np.arange(50), 200).astype("uint32")
    payload = bytearray(token_files.encode_blocks(ids, np.array([len(ids)]))[0])
    assert len(payload) < len(ids) / 4
    payload[token_files.HEAD.size + 10] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_blocks(token_files.split_payload(bytes(payload)))
    with pytest.raises(ValueError):
        token_files.split_payload(b"nothing like a block at all....")


def test_coder_beats_a_stock_compressor_on_its_blocks(spark):
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from sievemark.llm.wordscan import Words, text_chunks

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    known = token_files.WordIds(public.path("word_bpe_49k.json"))
    ids = np.concatenate([known.of(Words(data, offsets), 2)[0] for _, _, data, offsets in text_chunks(pa.array(texts))])
    cuts = range(0, len(ids), token_files.BLOCK)
    lengths = np.array([len(ids[c : c + token_files.BLOCK]) for c in cuts])
    stock = sum(len(zlib.compress(ids[c : c + token_files.BLOCK].astype("<u2").tobytes(), 9)) for c in cuts)
    assert sum(map(len, token_files.encode_blocks(ids, lengths))) < 0.95 * stock


def test_words_that_a_polynomial_hash_takes_for_one(tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from sievemark.llm.wordscan import Words, text_chunks

    flip = str.maketrans("ab", "ba")
    a = "a"
    for _ in range(10):
        a += a.translate(flip)
    b = a.translate(flip)
    known = token_files.WordIds(public.path("word_bpe_49k.json"))
    for text in (a, b, f"{a} {b} {a}"):
        ((_, _, data, offsets),) = text_chunks(pa.array([text]))
        words_ = Words(data, offsets)
        assert known.of(words_, 2)[0].tolist() == [*known.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert len(set(words_.hashes().tolist())) == len(set(text.split()))


def test_words_come_over_from_the_older_half(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from sievemark.llm.wordscan import Words, text_chunks

    monkeypatch.setattr(token_files.WordIds, "LIMIT", 300)
    known = token_files.WordIds(public.path("word_bpe_49k.json"))
    for text in ("one two three", "four two five", "one six two", "seven one", "one two three four five six seven"):
        ((_, _, data, offsets),) = text_chunks(pa.array([text]))
        assert known.of(Words(data, offsets), 2)[0].tolist() == [*known.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_marks_and_capitals_make_no_words_of_their_own():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from sievemark.llm.wordscan import Words, text_chunks

    known = token_files.WordIds(public.path("word_bpe_49k.json"))

    def of(texts):
        ((_, _, data, offsets),) = text_chunks(pa.array(texts))
        return known.of(Words(data, offsets), 2)

    of(["word Word word, Word. word!", "Word?"])
    assert [x for x in known.known if b"ord" in x] == [b"word"]
    odd = "WORD wOrd w\u00f6rd, W\u00f6rd! H\u0308. H\u0331a h\u0331a \u1e96, I\u0307, \u0130! A<|endoftext|> <|endoftext|>. a<|ENDOFTEXT|>, A|endoftext|>. x's. It's, 's, 'S. 5. 12, ... ., ,a a.b. \u00e9, e\u0301. \u00d7. \u00f7! \u00b5, \u00df: \u00c0b \u00e0b \u2026. \u3002, \u0430. a\u037e b; c\u0338. Q\u00a0x. y\u0085z,"
    texts = [odd, "A", "B.", "", None, "c", "D", "\u00e9", ".", "Zoo"] + odd.split()
    ids, sizes = of(texts)
    want = [[*known.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == sum(want, [])


def test_token_files(spark, corpus, rows, empty, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, file = str(tmp_path / "ids"), public.path("word_bpe_49k.json")
    extra = [(500, "Don't STOP, it's <|endoftext|> 12,5 é́ naïve word"), (501, "x" * 5000)]
    df = corpus.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    token_files.write(df, path, file, 2)
    read = spark.read.parquet(path)
    tokenizer = Tokenizer.from_file(file)
    encoded = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in [*rows, *extra]]
    got = token_files.digests(read).collect()
    crc = lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(i), crc(i)) for d, i in encoded)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert sorted(map(str, (r["ids"] for r in token_files.read_ids(read).collect()))) == sorted(str(i) for _, i in encoded)
    token_files.write(empty, str(tmp_path / "none"), file, 2)
    assert token_files.digests(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def brute_tree(texts, least, depth):
    n = defaultdict(lambda: [0, 0])
    for s in texts:
        for i in range(depth, len(s)):
            for j in range(8):
                for d in range(depth + 1):
                    n[(s[i - d : i], (1 << j) | (s[i] >> (8 - j)))][(s[i] >> (7 - j)) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weight, below = {}, {}
    for d in range(depth, -1, -1):
        above = defaultdict(float)
        for (c, p), (a, b) in n.items():
            if len(c) == d:
                own = kt(a, b)
                if d == depth:
                    weight[c, p], total = 1.0, own
                else:
                    children = below[c, p]
                    weight[c, p] = 1 / (1 + math.exp(min(700, children - own)))
                    top = max(own, children)
                    total = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(children - top))
                above[c[1:], p] += total
        below = above

    def log10(s):
        total = 0.0
        for i in range(depth, len(s)):
            for j in range(8):
                p, prefix = None, (1 << j) | (s[i] >> (8 - j))
                for d in range(depth, -1, -1):
                    key = (s[i - d : i], prefix)
                    if key in n and sum(n[key]) >= least:
                        own = (n[key][1] + 0.5) / (sum(n[key]) + 1)
                        p = own if p is None else weight[key] * own + (1 - weight[key]) * p
                p = 0.5 if p is None else p
                total += math.log10(p if (s[i] >> (7 - j)) & 1 else 1 - p)
        return total

    return log10


@pytest.mark.parametrize("depth", [ctw.DEPTH, 6])
def test_context_tree_scores(corpus, rows, empty, spark, depth):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    framed = lambda t: b"\xff" * depth + low(t).encode() + b"\xff"
    train = [t for d, t in rows if not held(d)]
    count = Counter(w for t in train for w in [*words(low(t)), None])
    n, v = sum(count.values()), len(count)
    log10 = brute_tree([framed(t) for t in train], 1, depth)
    want = []
    for d, t in rows:
        tokens = [*words(low(t)), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((str(d), held(d), len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6), round(log10(framed(t)), 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ctw.scores(corpus, depth=depth).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5) and a[6] == pytest.approx(b[6], abs=1e-4)
    assert ctw.scores(empty, depth=depth).count() == 0
    with pytest.raises(ValueError, match="depth"):
        ctw.scores(corpus, depth=7)
    alone = ctw.scores(spark.createDataFrame([(5, "Ab")], "doc_id long, text string"), F.lit(True), depth).first()
    assert alone["train_tokens"] == 0 and alone["base_score"] == 0.0 and alone["score"] == pytest.approx(-24 * math.log10(2))


def test_rare_words_are_looked_up_in_their_part(corpus, monkeypatch):
    want = {(str(r["doc_id"]), r["n_tokens"]): round(r["base_score"], 6) for r in ctw.scores(corpus).collect()}
    monkeypatch.setattr(ctw, "WORD_SHARE", 3)  # nearly all words are rare
    assert {(str(r["doc_id"]), r["n_tokens"]): round(r["base_score"], 6) for r in ctw.scores(corpus).collect()} == want


def test_rare_nodes_count_in_scores(spark, monkeypatch):
    # over 2**19 training bytes, and beside one hot source rare contexts that are seen once or twice
    rng = np.random.default_rng(8)
    hot = " ".join(rng.choice(["the", "hot", "source", "says", "this"], 3000))
    rare = ["".join(chr(x) for x in rng.integers(0x3B1, 0x3C9, 200)) for _ in range(20)]
    data = [(i, hot) for i in range(60)] + [(100 + i, t) for i, t in enumerate(rare * 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert sum(len(t.encode()) for _, t in data) > 1.5 * 2**19
    got = {r["doc_id"]: r["score"] for r in ctw.scores(docs).collect()}
    monkeypatch.setattr(ctw, "NODE_SHARE", 40)  # all nodes are looked up in place
    want = {r["doc_id"]: r["score"] for r in ctw.scores(docs).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_grams_are_scored_in_their_part_of_the_tree(corpus, monkeypatch):
    want = sorted((str(r["doc_id"]), r["n_bytes"], round(r["score"], 5)) for r in ctw.scores(corpus).collect())
    monkeypatch.setattr(ctw, "NODE_SHARE", 6)  # most grams travel
    got = sorted((str(r["doc_id"]), r["n_bytes"], round(r["score"], 5)) for r in ctw.scores(corpus).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-4)


def slots_of(spark, weights, cycle):
    table = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
    slots, length = mixing.slots_of(table, cycle)
    return slots, length, {r["source"]: r["a"] for r in slots.collect()}


def largest_remainders(weights, cycle):
    """Whole slots by largest remainders, one at least, the largest giving back what is too much."""
    while cycle < 4 * len(weights):
        cycle *= 2
    total = math.fsum(weights.values())
    exact = {s: w / total * cycle for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: max(0, cycle - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > cycle:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return cycle, out


def test_slots_and_schedule_stay_within_a_block(spark):
    rng = np.random.default_rng(9)
    cases = [({"a": 5, "b": 3, "c": 1, "d": 0.01}, 64), ({"a": 1}, 8), ({f"s{i}": 1 for i in range(37)}, 64)]
    cases += [({"a": 50, "b": 49, **{f"t{i:02}": 0.001 for i in range(20)}}, 64), ({f"s{i}": float(w) for i, w in enumerate(rng.pareto(0.7, 40) + 1e-6)}, 32)]
    for weights, size in cases:
        slots, cycle, got = slots_of(spark, weights, size)
        want_cycle, want = largest_remainders(weights, size)
        assert cycle == want_cycle and sum(got.values()) == cycle and min(got.values()) > 0
        if weights["a" if "a" in weights else "s0"] != 50:
            assert got == want
        else:
            assert sorted(got.values()) == sorted(want.values())  # which of the largest gives back is free
        source = {(r["a"], r["nth"]): r["source"] for r in slots.collect()}
        plan = {s: [None] * a for s, a in got.items()}
        for r in mixing.plan_of(slots, cycle).collect():
            plan[source[r["a"], r["nth"]]][r["i"]] = r["t"]
        assert sorted(t for p in plan.values() for t in p) == list(range(cycle))
        for s, a in got.items():
            for t in range(cycle + 1):
                assert abs(sum(x < t for x in plan[s]) - a * t / cycle) < 1
    for bad in ({"a": -1, "b": 2}, {"a": 0, "b": 0}):
        with pytest.raises(ValueError):
            slots_of(spark, bad, 64)


def test_mixing(corpus, rows, empty):
    weights, block = {"s0": 2.0, "s1": 1.0, "s2": 1.0}, 100
    got = mixing.order_of(corpus, weights, block_words=block, cycle=8).collect()
    of = {(str(r["doc_id"]), r["text"]) for r in corpus.collect()}
    assert len({(str(r["doc_id"]), r["source"], r["rank"]) for r in got}) == len(rows) and of
    total = defaultdict(int)
    for r in got:
        total[str(r["doc_id"])] += r["n_words"]
    want = defaultdict(int)
    for d, t in rows:
        want[str(d)] += len(words(t))
    assert total == want
    # every block of a source is full but for its last, and stands in a slot of its own
    fill, slot = defaultdict(int), {}
    for r in got:
        fill[r["source"], r["block"]] += r["n_words"]
        assert slot.setdefault((r["source"], r["block"]), r["slot"]) == r["slot"]
    last = {s: max(b for x, b in fill if x == s) for s, _ in fill}
    assert all(n == block for (s, b), n in fill.items() if b < last[s])
    # word by word, until the first source runs out, every source is less than a block from its share
    length, slots = largest_remainders({s or "": weights.get(s, 1.0) for s in last}, 8)
    slots[None] = slots.pop("", None)
    end = min(slot[s, b] for s, b in last.items())
    for t in range(end):
        for s in last:
            placed = sum(fill[x, b] for (x, b), k in slot.items() if x == s and k < t)
            assert abs(placed - slots[s] * t * block / length) < block
    out = mixing.mixed(corpus)
    assert out.columns == corpus.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, corpus.collect()))
    assert mixing.order_of(empty).count() == mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("few", [1 << 17, 10])
def test_twenty_thousand_sources(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_ROWS", few)  # with 10, tables by source are merged, not sent to all tasks
    monkeypatch.setattr(shared, "FEW_ROWS", few)
    n, block = 20_000, 4
    # one source holds a third of all rows, one is null
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % n))
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit("a b").alias("text"))
    got = mixing.order_of(docs, block_words=block).toPandas()
    assert got["n_words"].sum() == 120_000 and got["doc_id"].nunique() == len(got) == 60_000
    got["source"] = got["source"].fillna("")
    blocks = got.groupby(["source", "block"]).agg(slot=("slot", "first"), slots=("slot", "nunique"), n=("n_words", "sum"))
    assert (blocks["slots"] == 1).all() and blocks["slot"].is_unique
    # each source's blocks lie in the windows of its share
    totals = got.groupby("source")["n_words"].sum()
    slots, length = mixing.slots_of(spark.createDataFrame([(s or None, float(w) ** 0.5) for s, w in totals.items()], "source string, weight double"))
    a = {r["source"] or "": r["a"] for r in slots.collect()}
    assert sum(a.values()) == length and length >= 4 * len(a)
    for (s, b), slot in blocks["slot"].items():
        assert b * length // a[s] <= slot < -(-(b + 1) * length // a[s])


def best_cost(lengths, sizes, cost):
    return sum(lengths) * min(cost(s) / s for s in sizes)


def test_plan_packs_everything():
    rng = np.random.default_rng(4)
    sizes = (64, 128, 256)
    histogram = dict(Counter(int(x) for x in np.minimum(rng.geometric(0.02, 3000), 255)))
    plan = packing.planned(histogram, sizes)
    dealt = Counter()
    for size, inside, bins in plan.groups:
        end = 0
        for length, offset in inside:
            assert offset == end
            end += length
            dealt[length] += bins
        assert end <= size and not any(s < size and s >= end for s in sizes)
    assert dealt == Counter(histogram)
    words_in = sum(n * c for n, c in histogram.items())
    assert plan.cost() <= 1.02 * best_cost([words_in], sizes, packing.cost_of) + packing.cost_of(256)
    assert packing.planned({}, sizes).groups == []


def test_packing(corpus, rows, empty):
    sizes = (64, 128, 256)
    got = packing.pieces(corpus, sizes).collect()
    per = defaultdict(list)
    bins = defaultdict(list)
    for r in got:
        per[str(r["doc_id"])].append((r["start"], r["n_words"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    want = defaultdict(int)
    for d, t in rows:
        want[str(d)] += len(words(t))
    assert {d: sum(n for _, n in p) for d, p in per.items()} == dict(want)
    for found in bins.values():
        found.sort(key=lambda r: r["bin_offset"])
        end = 0
        for r in found:
            assert r["bin_offset"] == end and r["bin_size"] == found[0]["bin_size"]
            end += r["n_words"]
        assert end == found[0]["bin_used"] <= found[0]["bin_size"]
    assert packing.pieces(empty, sizes).count() == 0
    texts = packing.sequences(corpus, sizes)
    back = defaultdict(list)
    for r in texts.collect():
        back[str(r["doc_id"])].append((r["piece"], r["text"]))
        assert len(r["text"].split()) == r["n_words"] or r["n_words"] == len(words(r["text"]))
    assert " ".join(t for _, t in sorted(back["12"])).split() == next(t for d, t in rows if d == 12).split()
