"""Language-model scores by context-tree weighting over bytes.

Texts are read as bytes, A-Z lower-cased, each followed by an end byte. Every byte is eight binary
decisions; for each bit prefix there is a context tree over the preceding bytes, and each node
holds a Krichevsky-Trofimov estimate. The weighted probability of a node is the even mixture of its
own estimate and the product of its children's, so the tree mixes all depths; the code length of a
text follows from the mixture along the path of each bit.

Training is counting: grams of context and byte are counted over all training texts, summed by
Spark, and folded from the deepest contexts to the root with one grouping for each depth. Nodes
visited by at least a 2**-NODE_SHARE part of the training bytes are looked up where the text lies,
a table of a size that the corpus cannot exceed. A gram with any bit whose deepest node is not
among them travels in bundles to the nodes of its part of the tree and back; so scores are exact
mixtures over all nodes, and no task ever holds the tree. (A context that training never saw
predicts as the one above it does.)

The base model is a smoothed word unigram. Words that make up at least a 2**-WORD_SHARE part of all
tokens, at most 2**WORD_SHARE words, are looked up where the text lies; the hashes of the others
travel in bundles to the counts of their part of the vocabulary and back, so that no task ever
holds the vocabulary.

Defined results: a null or empty text has one token, its end; a null doc_id is in training; repeated
rows count and are scored each for itself; with no training text all counts are 0, base scores 0 and
every bit has probability one half; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.shared import partitions, stored
from sievemark.llm.wordscan import Words, text_chunks

DEPTH = 4  # bytes of context; scores() takes up to six
NODE_SHARE, WORD_SHARE = 18, 18
END = 0xFF  # no byte of UTF-8
END_TOKEN = np.int64(0)  # the end counts as a token; no word hash is 0 in practice
LOWER = np.arange(256, dtype="uint8")
LOWER[65:91] += 32
CHUNK = 1 << 20
GRAM, WORD = 0, 1


def held_out(doc_id: Column, fold: int = 1, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each coded byte, where each text begins among them): every text and its end byte,
    in the context of bytes of the same text only."""
    n = len(offsets) - 1
    pad = np.repeat(offsets[1:], depth)
    line = np.concatenate([np.full(depth, END, "uint8"), np.insert(data, pad, END)]) if n else data
    key = line[depth:].astype("int64")
    for d in range(1, depth + 1):
        key |= line[depth - d : len(line) - d].astype("int64") << (8 * d)
    begin = offsets + depth * np.arange(n + 1)
    # of the end bytes only the first is coded
    coded = np.ones(len(key), bool)
    for d in range(1, depth):
        coded[begin[1:] - d] = False
    return key[coded], offsets + np.arange(n + 1)


def _add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, "int64")
    return key[new], np.add.reduceat(n, new) if len(new) else n


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, "int64")
    return values[new], np.diff(np.append(new, len(values)))


def _packed(grams: np.ndarray, depth: int) -> np.ndarray:
    """The grams as rows of depth + 1 bytes."""
    return grams.astype("<i8").view("uint8").reshape(-1, 8)[:, : depth + 1]


def _unpacked(raw: bytes, depth: int) -> np.ndarray:
    narrow = np.frombuffer(raw, "uint8").reshape(-1, depth + 1)
    wide = np.zeros((len(narrow), 8), "uint8")
    wide[:, : depth + 1] = narrow
    return wide.view("<i8").ravel()


def _number_type(n: int) -> str:
    """For the texts of a chunk by their place in it."""
    return "uint16" if n <= 1 << 16 else "uint32"


class _Tally:
    """Counts by key that add up within a task; handed on when they are many."""

    def __init__(self, limit: int = 1 << 20):
        self.parts, self.held, self.limit = [], 0, limit

    def add(self, values: np.ndarray) -> None:
        self.parts.append(_counted(values))
        self.held += len(self.parts[-1][0])
        if self.held > self.limit and len(self.parts) > 1:
            self.parts = [_add_up(self.parts)]
            self.held = len(self.parts[0][0])

    def full(self) -> bool:
        return self.held > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _add_up(self.parts) if self.parts else (np.zeros(0, "int64"), np.zeros(0, "int64"))
        self.parts, self.held = [], 0
        return out


def counts(train: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n) over all texts: byte grams and word hashes."""

    def run(batches):
        tallies = {GRAM: _Tally(), WORD: _Tally()}

        def rows(kind):
            key, n = tallies[kind].take()
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(key), kind, "int8")), "key": pa.array(key.astype("int64")), "n": pa.array(n.astype("int64"))})

        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(0), CHUNK):
                low = LOWER[data]
                tallies[GRAM].add(_grams(low, offsets, depth)[0])
                words = Words(low, offsets)
                tallies[WORD].add(np.concatenate([words.hashes().view("int64"), np.full(hi - lo, END_TOKEN)]))
                for kind, t in tallies.items():
                    if t.full():
                        yield rows(kind)
        for kind in tallies:
            yield rows(kind)

    return train.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: Column) -> Column:
    """log gamma for x >= 0.5: Stirling's series after seven steps up."""
    up = F.lit(0.0)
    for k in range(7):
        up = up + F.log(x + k)
    z = x + 7
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - up


def nodes(grams: DataFrame, deepest: int) -> DataFrame:
    """(depth, ctx, prefix, n0, n1, w): w is the weight of the node's own estimate against the
    mixture of its children."""
    j = F.col("j")
    bits = grams.select("key", "n", F.explode(F.array(*(F.lit(k) for k in range(8)))).alias("j"))
    byte = F.col("key").bitwiseAND(255)
    prefix = F.expr("cast(shiftleft(1, j) as bigint)").bitwiseOR(F.expr("shiftright(key & 255, 8 - j)"))
    bit = F.expr("shiftright(key & 255, 7 - j) & 1")
    level = (
        bits.select(F.expr("shiftright(key, 8)").alias("ctx"), prefix.alias("prefix"), bit.alias("bit"), "n")
        .groupBy("ctx", "prefix")
        .agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    )
    half = math.lgamma(0.5)
    out = None
    for depth in range(deepest, -1, -1):
        kt = _lgamma(F.col("n0") + 0.5) + _lgamma(F.col("n1") + 0.5) - 2 * half - _lgamma(F.col("n0") + F.col("n1") + 1.0)
        level = level.withColumn("kt", kt)
        if depth == deepest:
            level = level.withColumns({"w": F.lit(1.0), "pw": F.col("kt")})
        else:
            below = F.col("below")
            top = F.greatest(F.col("kt"), below)
            level = level.withColumns(
                {"w": 1 / (1 + F.exp(F.least(below - F.col("kt"), F.lit(700.0)))), "pw": math.log(0.5) + top + F.log(F.exp(F.col("kt") - top) + F.exp(below - top))}
            )
        level = stored(level, "ctw-level")
        rows = level.select(F.lit(depth).alias("depth"), "ctx", "prefix", "n0", "n1", "w")
        out = rows if out is None else out.union(rows)
        if depth:
            shorter = F.col("ctx").bitwiseAND(F.lit((1 << (8 * (depth - 1))) - 1).cast("long"))
            level = level.groupBy(shorter.alias("ctx"), "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
    return out


class Tree:
    """The nodes as sorted arrays, and log10 probabilities of grams with a memory of those seen."""

    SLOT_BITS = 21

    def __init__(self, key: np.ndarray, own: np.ndarray, weight: np.ndarray, depth: int, complete: bool = True):
        """key: (depth of the node, ctx, prefix) as one number, ascending; own: probability of a 1; complete: no
        node was left out."""
        self.key, self.own, self.weight, self.depth, self.complete = key, own, weight, depth, complete
        self.forget()

    def forget(self) -> None:
        self.slot_key = np.full(1 << self.SLOT_BITS, -1, "int64")
        self.slot_log = np.zeros(1 << self.SLOT_BITS)

    @classmethod
    def of(cls, table: pd.DataFrame, depth: int, complete: bool = True) -> Tree:
        key = (table["depth"].to_numpy("int64") << (8 * depth + 8)) | (table["ctx"].to_numpy("int64") << 8) | table["prefix"].to_numpy("int64")
        n0, n1 = table["n0"].to_numpy("float64"), table["n1"].to_numpy("float64")
        order = np.argsort(key)
        return cls(key[order], ((n1 + 0.5) / (n0 + n1 + 1))[order], table["w"].to_numpy("float64")[order], depth, complete)

    def exact(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte in the context of the others; NaN if
        nodes of the gram may be missing here."""
        byte, total, whole = grams & 255, np.zeros(len(grams)), np.ones(len(grams), bool)
        for j in range(8):
            prefix = (1 << j) | (byte >> (8 - j))
            p = np.full(len(grams), np.nan)
            for depth in range(self.depth, -1, -1):
                want = (depth << (8 * self.depth + 8)) | (((grams >> 8) & ((1 << (8 * depth)) - 1)) << 8) | prefix
                at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
                has = self.key[at] == want if len(self.key) else np.zeros(len(grams), bool)
                if depth == self.depth:
                    whole &= has
                if not has.any():
                    continue
                own, w = self.own[at], self.weight[at]
                p = np.where(has, np.where(np.isnan(p), own, w * own + (1 - w) * p), p)
            p = np.where(np.isnan(p), 0.5, p)
            total += np.log10(np.where((byte >> (7 - j)) & 1 == 1, p, 1 - p))
        # a node's ancestors are visited as often as it is, or more
        return total if self.complete else np.where(whole, total, np.nan)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)).astype("int64")

    def log10(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        out = self.slot_log[slot]
        miss = np.flatnonzero(self.slot_key[slot] != grams)
        if len(miss):
            found, back = np.unique(grams[miss], return_inverse=True)
            value = self.exact(found)
            out[miss] = value[back]
            place = self._slot(found)
            empty = self.slot_key[place] < 0  # who came first stays
            self.slot_key[place[empty]] = found[empty]
            self.slot_log[place[empty]] = value[empty]
            # two new grams of one slot: the last written holds it
            wrong = self.slot_key[place] == found
            self.slot_log[place[wrong]] = value[wrong]
        return out


def part_of(ctx, parts: int):
    """The part of the tree where a context's nodes of depth 2 and more are: by its last two bytes,
    so that a context and the shorter one lie together. Takes a column or an array."""
    return (ctx & 65535) * 40503 % 65536 % parts if isinstance(ctx, np.ndarray) else ctx.bitwiseAND(65535) * 40503 % 65536 % parts


def trained(train: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(word counts, nodes, how often a node that is looked up in place is visited, number of
    training tokens)."""
    tallied = stored(counts(train, depth), "tallied")
    words = tallied.where(F.col("kind") == WORD).select(F.col("key").alias("word"), "n")
    grams = tallied.where(F.col("kind") == GRAM).select("key", "n")
    total = tallied.groupBy("kind").agg(F.sum("n").alias("n")).collect()  # two rows
    sums = {r["kind"]: r["n"] for r in total}
    least = max(1, sums.get(GRAM, 0) >> NODE_SHARE)
    return words, nodes(grams, depth), least, sums.get(WORD, 0)


def scores(docs: DataFrame, held: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, n_bytes and bits_per_byte. ``depth``: bytes of context, 2 to 6 (a node is one 64-bit number)."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    spark = docs.sparkSession
    held = held_out(F.col("doc_id")) if held is None else held
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words, tree_nodes, least, n_train = trained(texts.where(~F.col("held_out")), depth)
    n_vocabulary = words.count()
    frequent = words.where(F.col("n") >= max(1, -(-n_train >> WORD_SHARE))).toPandas().sort_values("word")  # at most 2**WORD_SHARE words
    often = tree_nodes.where(F.col("n0") + F.col("n1") >= least)
    given = spark.sparkContext.broadcast((often.toPandas(), frequent["word"].to_numpy("int64"), frequent["n"].to_numpy("float64")))
    denominator = n_train + 0.5 * (n_vocabulary + 1)
    buckets = 4 * partitions(docs)
    schema = "chunk long, bucket int, ids binary, held binary, tokens binary, known binary, base binary, score binary, bytes binary, doc binary, word binary, gram binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        table, hot, hot_n = given.value
        tree = Tree.of(table, depth, least == 1)
        value = np.log10((hot_n + 0.5) / denominator) if len(hot) else np.zeros(0)
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(2), CHUNK):
                low = LOWER[data]
                grams, begin = _grams(low, offsets, depth)
                log = tree.log10(grams)
                afar = np.flatnonzero(np.isnan(log))
                log[afar] = 0
                score = np.add.reduceat(log, begin[:-1])
                words = Words(low, offsets)
                n = hi - lo
                doc = np.concatenate([words.text_of(), np.arange(n)])
                token = np.concatenate([words.hashes().view("int64"), np.full(n, END_TOKEN)])
                at = np.minimum(np.searchsorted(hot, token), max(0, len(hot) - 1))
                known = hot[at] == token if len(hot) else np.zeros(len(token), bool)
                base = np.bincount(doc[known], value[at[known]], n) if len(hot) else np.zeros(n)
                chunk = (part << 32) + made
                made += 1
                ids = b.column(0).slice(lo, n)
                rows = {k: [] for k in names}

                def put(**fields):
                    for k in names:
                        v = fields.get(k)
                        rows[k].append(v.tobytes() if isinstance(v, np.ndarray) else v)

                gone = ids.is_null().to_numpy(zero_copy_only=False)
                put(
                    chunk=chunk, bucket=-1, ids=np.concatenate([np.nan_to_num(ids.to_numpy(zero_copy_only=False)).astype("int64"), gone.astype("int64")]),
                    held=b.column(1).slice(lo, n).to_numpy(zero_copy_only=False).astype("uint8"), tokens=words.counts().astype("int64") + 1,
                    known=np.bincount(doc[known], minlength=n).astype("int64"), base=base, score=score, bytes=np.diff(offsets) + 1,
                )

                def bundle(field, doc, value, bucket):
                    order = np.argsort(bucket, kind="stable")
                    doc, value, bucket = doc[order].astype(_number_type(n)), value[order], bucket[order]
                    new = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                    for s, e in zip(new, np.append(new[1:], len(bucket)) if len(bucket) else []):
                        put(chunk=chunk, bucket=int(bucket[s]), doc=doc[s:e], **{field: value[s:e]})

                # the other words, bundled by part of the vocabulary, and the other grams, by part of the tree
                doc, token = doc[~known], token[~known]
                bundle("word", doc, token, (token.view("uint64") % np.uint64(buckets)).astype("int64"))
                bundle("gram", np.searchsorted(begin, afar, side="right") - 1, _packed(grams[afar], depth), part_of(grams[afar] >> 8, buckets))
                types = {"chunk": pa.int64(), "bucket": pa.int32()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.binary())) for k, v in rows.items()})

    scanned = stored(texts.mapInArrow(scan, schema), "scanned")
    asked = scanned.where("word is not null").select("bucket", "chunk", "doc", "word")
    # word hashes are spread evenly, and frequent words are not among those asked
    parts = words.where(F.col("n") < max(1, -(-n_train >> WORD_SHARE))).select(F.pmod(F.col("word"), F.lit(buckets)).cast("int").alias("bucket"), "word", "n")
    # pmod of the signed number and the remainder of the unsigned one differ: 2**64 mod buckets is taken off
    shift = pow(2, 64, buckets)
    parts = parts.withColumn("bucket", F.when(F.col("word") < 0, F.pmod(F.col("bucket") + shift, F.lit(buckets))).otherwise(F.col("bucket")).cast("int"))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        key, n = right["word"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        out = {"chunk": [], "doc": [], "n": []}
        for chunk, doc, word in zip(left["chunk"].to_pylist(), left["doc"].to_pylist(), left["word"].to_pylist()):
            word = np.frombuffer(word, "int64")
            at = np.minimum(np.searchsorted(key, word), max(0, len(key) - 1))
            has = key[at] == word if len(key) else np.zeros(len(word), bool)
            out["chunk"].append(chunk)
            out["doc"].append(doc)
            out["n"].append(np.where(has, n[at] if len(key) else 0, 0).astype("uint32" if not len(n) or n.max() < 2**32 else "uint64").tobytes())
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "doc": pa.array(out["doc"], pa.binary()), "n": pa.array(out["n"], pa.binary())})

    answered = asked.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(look_up, "chunk long, doc binary, n binary")

    # the two upper levels have a fixed size, at most 257 contexts of 255 nodes
    upper = spark.sparkContext.broadcast(tree_nodes.where("depth < 2").toPandas() if least > 1 else None)

    def score_grams(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"chunk": left["chunk"].to_pylist(), "doc": [], "log": []}
        grams = [_unpacked(g, depth) for g in left["gram"].to_pylist()]
        if grams:
            tree = Tree.of(pd.concat([upper.value, right.select(upper.value.columns.to_list()).to_pandas()]), depth)
            found = np.unique(np.concatenate(grams))
            log = np.concatenate([tree.exact(found[i : i + (1 << 16)]) for i in range(0, len(found), 1 << 16)])
            # added up by text; the texts of a bundle ascend
            for g, doc in zip(grams, left["doc"].to_pylist()):
                doc = np.frombuffer(doc, "uint16" if len(doc) == 2 * len(g) else "uint32")
                new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                out["doc"].append(doc[new].tobytes())
                out["log"].append(np.add.reduceat(log[np.searchsorted(found, g)], new).tobytes())
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "doc": pa.array(out["doc"], pa.binary()), "log": pa.array(out["log"], pa.binary())})

    answered = answered.withColumn("log", F.lit(None).cast("binary"))
    if least > 1:
        far = scanned.where("gram is not null").select("bucket", "chunk", "doc", "gram")
        deep = tree_nodes.where("depth >= 2").withColumn("bucket", part_of(F.col("ctx"), buckets).cast("int"))
        scored = far.groupBy("bucket").cogroup(deep.groupBy("bucket")).applyInArrow(score_grams, "chunk long, doc binary, log binary")
        answered = answered.unionByName(scored.withColumn("n", F.lit(None).cast("binary")))

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {k: left[k][0].as_py() for k in ("ids", "held", "tokens", "known", "base", "score", "bytes")}
        both = np.frombuffer(row["ids"], "int64")
        n = len(both) // 2
        base, known = np.frombuffer(row["base"], "float64").copy(), np.frombuffer(row["known"], "int64").copy()
        score = np.frombuffer(row["score"], "float64").copy()
        for doc, c, log in zip(right["doc"].to_pylist(), right["n"].to_pylist(), right["log"].to_pylist()):
            doc = np.frombuffer(doc, _number_type(n))
            if log is not None:
                score += np.bincount(doc, np.frombuffer(log, "float64"), n)
                continue
            c = np.frombuffer(c, "uint32" if len(c) == 4 * len(doc) else "uint64").astype("float64")
            base += np.bincount(doc, np.log10((c + 0.5) / denominator), n)
            known += np.bincount(doc[c > 0], minlength=n)
        size = np.frombuffer(row["bytes"], "int64")
        return pa.table(
            {
                "doc_id": pa.array(both[:n], mask=both[n:] > 0),
                "held_out": pa.array(np.frombuffer(row["held"], "uint8") > 0),
                "n_tokens": pa.array(np.frombuffer(row["tokens"], "int64")),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, n_train, "int64")),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "n_bytes": pa.array(size - 1),
                "bits_per_byte": pa.array(-score * math.log2(10) / size),
            }
        )

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return scanned.where("bucket = -1").groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(add_up, out)
