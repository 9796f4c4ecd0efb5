"""Near-duplicate classes by DartMinHash.

The shingles of a text (five words; with ``weighted``, as often as they occur) are regions of width
one or of their weight. Hashed darts fall into them as a Poisson process along a rank axis, slice
by slice; each dart names a coordinate, and the earliest dart of each coordinate is the signature.
Slices go on only while a text has an empty coordinate, so a long text needs few darts a shingle.
Texts that agree in a band of coordinates are candidates.

Among those that share a band with any other text, pairs are met by rare shingles: all shingles of
these texts are put in one order, rarest first, and two texts of similarity t or more must share a
shingle that stands early in both, as at most ``n - o`` of n shingles may come before it (o: the
number that both must have in common). A text with changes of its own begins with shingles that no
other has; so in a group of thousands of copies, each changed in its own way, only those meet that
can be near, where a band's bucket would list all pairs. Of a shingle's texts a few lead and are
compared with the others of other components; more lead, 512 times as many each round, only while
its texts span several components and some have not led; so no link is missed, and a group of alike
texts costs a few comparisons each. Copies that are each changed a little too much to be near share
their rarest common shingles all the same; so each text also carries the parities of its shingles
that other sets have, dealt into 256 classes. Two such sets differ in no fewer shingles than they have
parities unlike, and near ones may differ only in what their own shingles leave over, so a pair that
can't be near is mostly seen by four words of 64 bits: then it never leaves the join, and no set moves.
Every pair that is left is measured once: its exact Jaccard similarity from the sets, if it shares a
band. The classes are the connected components of the pairs at or above
the threshold. Texts of the same words are one node throughout. Nothing is gathered on the driver;
components come from joins over written tables.

Defined results: texts without words (null, empty) are classes of their own; texts shorter than a
shingle have one shingle, all their words; very long texts are taken whole; ties in rarity go by the
shingle's hash; repeated rows share a class with their likes; rows that share an id are judged each
by its text; the class id is the least doc_id of the class; an empty table gives an empty result;
other columns are not read, and ``deduplicated`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.shared import sized, stored
from sievemark.llm.wordscan import Runs, U, Words, mix, text_chunks

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
FIRST_LEADERS, LEADER_GROWTH = 2, 512
PARITIES = ("p0", "p1", "p2", "p3")  # 64 parities each
FIRST_SLICE = -8  # the first slice of the rank axis ends at 2**-8, each later one at twice the last


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    top = int(mean + 12 * math.sqrt(mean) + 30)
    k = np.arange(top)
    logs = -mean + k * math.log(mean) - np.cumsum(np.log(np.maximum(k, 1)))
    return np.cumsum(np.exp(logs))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype("float64") * 2.0**-53


def signatures(columns: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The dart signatures of sets of 64-bit region hashes, laid end to end with their sizes; empty
    sets get zeros."""
    n = len(size)
    out = np.zeros((n, k), U)
    filled = np.zeros((n, k), bool)
    owner = np.repeat(np.arange(n), size)
    active = size > 0
    slice_no, lo, hi = 0, 0.0, 2.0**FIRST_SLICE
    while active.any():
        use = active[owner]
        h, doc = columns[use], owner[use]
        salt = mix(np.array([slice_no + 1], U))[0]
        base = mix(h ^ salt)
        darts = np.searchsorted(_poisson(hi - lo), _unit(base))
        el = np.repeat(np.arange(len(h)), darts)
        nth = np.arange(len(el)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(base[el] + (nth.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
        cell = doc[el] * k + (mix(dart ^ U(0x5851F42D4C957F2D)) % U(k)).astype("int64")
        free = ~filled.ravel()[cell]
        cell, dart = cell[free], dart[free]
        # earliest first: the hash of the dart is also its place within the slice
        order = np.argsort(dart)
        cell, dart = cell[order], dart[order]
        seen, first = np.unique(cell, return_index=True)
        out.ravel()[seen] = dart[first]
        filled.ravel()[seen] = True
        active &= ~filled.all(axis=1)
        slice_no, lo, hi = slice_no + 1, hi, hi * 2
    return out


def shingle_sets(words: Words, shingle: int, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted region hashes of each text laid end to end, their numbers, hash of all words of each text)."""
    hashes = words.hashes()
    whole, grams = words.whole(hashes), Runs(hashes).all(shingle)
    parts, size = [], np.zeros(len(whole), "int64")
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b == a:
            continue
        if b - a < shingle:
            found = whole[i : i + 1]
        elif weighted:
            value, count = np.unique(grams[a : b - shingle + 1], return_counts=True)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = np.sort(mix(np.repeat(value, count) + nth.astype(U)))
        else:
            found = np.sort(grams[a : b - shingle + 1])
            found = found[np.append(True, found[1:] != found[:-1])]
        parts.append(found)
        size[i] = len(found)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), size, whole


def _signed(docs: DataFrame, shingle: int, weighted: bool, bands: int, rows: int) -> DataFrame:
    """doc_id, fp, node (the content: null without words) and the hashes of its bands."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(2), 1 << 17):
                words = Words(data, offsets)
                columns, size, whole = shingle_sets(words, shingle, weighted)
                # texts of the same words have the same darts: thrown once
                node, first = np.unique(whole, return_index=True)
                begin = np.cumsum(size) - size
                pick = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in first]) if len(first) else np.zeros(0, "int64")
                sig = signatures(columns[pick], size[first], bands * rows)[np.searchsorted(node, whole)]
                band = np.arange(bands, dtype=U)[None, :] * U(0xD6E8FEB86659FD93) + U(1)
                for r in range(rows):
                    band = mix(band ^ sig[:, r::rows])
                none = size == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        b.column(1).slice(lo, hi - lo),
                        pa.array(whole.view("int64"), mask=none),
                        pa.ListArray.from_arrays(np.arange(0, len(none) * bands + 1, bands, dtype="int32"), pa.array(band.ravel().view("int64"))),
                    ],
                    names=["doc_id", "fp", "node", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, fp long, node long, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of (a, b) edges: comp is the least node that edges reach.

    Each round takes the least label among a node and its neighbours and then the label of one's
    label, so that long chains halve; every round is written. Labels only fall, so rounds end when
    their sum stays.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    both = stored(edges.select(ends.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), "labels")
    total = None
    while True:
        up = sized(labels).select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        labels = stored(labels.join(up, "comp").select("node", F.col("_up").alias("comp")), "labels")
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(sized(labels).withColumnRenamed("node", "b"), "b")
        labels = stored(near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("comp")), "labels")


def _sets_of(docs: DataFrame, nodes: DataFrame, shingle: int, weighted: bool) -> DataFrame:
    """The region hashes of the contents in ``nodes`` (node, bands, doc_id and fp of one document with it)."""

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(1)):
                columns, size, whole = shingle_sets(Words(data, offsets), shingle, weighted)
                begin = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(whole.view("int64")),
                        b.column(2).slice(lo, hi - lo),
                        pa.array([columns[s : s + n].tobytes() for s, n in zip(begin.tolist(), size.tolist())], pa.binary()),
                    ],
                    names=["node", "found", "bands", "regions"],
                )

    nodes = nodes.withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    texts = docs.join(nodes.hint("merge"), docs["doc_id"].eqNullSafe(nodes["_d"]) & (docs["fp"] == nodes["_f"])).select("node", "text", "bands")
    # one document for each content, however often its row is repeated
    return texts.mapInArrow(run, "node long, found long, bands array<long>, regions binary").where("node = found").drop("found").dropDuplicates(["node"])


def _rare_first(sets: DataFrame, threshold: float) -> DataFrame:
    """(shingle, node, n, m, o, pos, p0 to p3): of each set of n shingles those, but for what no other set
    has, that stand so early in the common order that a similar set could share them first; how many
    of the set's shingles others have, and the parities of these."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                shingles = np.frombuffer(b.column(1)[i].as_buffer(), "int64")
                n = len(shingles)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column(0)[i].as_py())), pa.array(np.full(n, n, "int32")), pa.array(shingles)], names=["node", "n", "shingle"])

    tokens = sets.select("node", "regions").mapInArrow(run, "node long, n int, shingle long")
    often = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    bit, word = F.expr("shiftleft(1L, cast(shingle & 63 as int))"), F.expr("shiftright(shingle, 6) & 3")
    known = tokens.join(often.hint("merge"), "shingle").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("_s"),
        *(F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0)).cast("long").alias(p) for k, p in enumerate(PARITIES)),
    )
    # what only one set has comes first and is not listed
    alone = F.col("n") - F.size("_s")
    last = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9)
    early = known.select("node", "n", *PARITIES, F.size("_s").alias("m"), alone.alias("_u"), F.slice("_s", F.lit(1), F.greatest(F.lit(0), last - alone + 1).cast("int")).alias("_s"))
    rank = F.size("_s").cast("long") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    places = early.select("node", "n", "m", *PARITIES, rank.alias("o"), "_u", F.posexplode("_s").alias("_i", "_x"))
    return places.select(F.col("_x.shingle").alias("shingle"), "node", "n", "m", "o", (F.col("_u") + F.col("_i")).cast("int").alias("pos"), *PARITIES)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``sim`` to (a, b) rows: the Jaccard similarity of the sets, 0 where they share no band."""

    def run(batches):
        for b in batches:
            x_bands, y_bands = (np.asarray(b.column(j).flatten()).reshape(b.num_rows, -1) for j in (3, 5))
            banded = (x_bands == y_bands).any(axis=1) if b.num_rows else []
            sim = np.zeros(b.num_rows)
            for i in np.flatnonzero(banded):
                x, y = (np.frombuffer(b.column(j)[i].as_buffer(), "uint64") for j in (2, 4))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                sim[i] = common / (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], names=["a", "b", "sim"])

    # of the sets only those that are asked move
    x = sets.join(sized(pairs).withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), "b", F.col("regions").alias("a_set"), F.col("bands").alias("a_bands"))
    y = sets.join(sized(stored(pairs.select(F.col("b").alias("node")).distinct(), "ends")), "node").select(F.col("node").alias("b"), F.col("regions").alias("b_set"), F.col("bands").alias("b_bands"))
    return x.join(y.hint("merge"), "b").select("a", "b", "a_set", "a_bands", "b_set", "b_bands").mapInArrow(run, "a long, b long, sim double")


def _content(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _links(sets: DataFrame, threshold: float) -> DataFrame | None:
    """(node, comp) of the sets that are linked to another; None if there are none."""
    state = stored(_rare_first(sets, threshold).withColumn("used", F.lit(False)), "early")
    linked, comp, seen, leaders = None, None, None, FIRST_LEADERS
    while True:
        if comp is None:
            state = state.withColumn("comp", F.col("node"))
        else:
            state = state.drop("comp").join(sized(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        span = state.groupBy("shingle").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("used").alias("_all")).where("_lo < _hi and not _all").select("shingle")
        state = stored(state.join(span.hint("merge"), "shingle"), "open")
        part = F.pmod(F.xxhash64("node"), F.lit(leaders))
        lead = state.where("not used").groupBy("shingle", part.alias("_p")).agg(F.max(F.struct("o", "node", "comp", "n", "m", "pos", *PARITIES)).alias("_l"))
        lead = stored(lead.select(F.col("shingle").alias("_b"), *(F.col(f"_l.{c}").alias(f"l_{c}") for c in ("node", "comp", "n", "m", "pos", *PARITIES))), "lead")
        if not lead.limit(1).count():
            return comp
        # as many must be in common, and what comes before the first shared shingle isn't
        common = F.ceil((F.col("n") + F.col("l_n")) * (threshold / (1 + threshold)) - 1e-9)
        near = (F.col("pos") <= F.col("n") - common) & (F.col("l_pos") <= F.col("l_n") - common)
        unlike = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"l_{p}"))) for p in PARITIES), F.lit(0))
        can = unlike <= F.col("m") + F.col("l_m") - 2 * common
        met = state.join(sized(lead), (F.col("shingle") == F.col("_b")) & (F.col("comp") != F.col("l_comp")) & near & can)
        pairs = met.select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(sized(seen), ["a", "b"], "left_anti")
        fresh = stored(_measured(stored(pairs, "pairs"), sets), "measured")
        seen = fresh.select("a", "b") if seen is None else seen.union(fresh.select("a", "b"))
        close = fresh.where(F.col("sim") >= threshold - 1e-9).select("a", "b")
        if close.limit(1).count():
            linked = close if linked is None else close.union(linked)
            comp = components(linked)
        led = lead.select(F.col("_b").alias("shingle"), F.col("l_node").alias("node"), F.lit(True).alias("_led"))
        state = state.join(sized(led), ["shingle", "node"], "left").withColumn("used", F.col("used") | F.coalesce("_led", F.lit(False))).drop("_led")
        leaders *= LEADER_GROWTH


def _classed(docs: DataFrame, threshold: float, shingle: int, weighted: bool, bands: int, rows: int) -> DataFrame:
    """One row for each document: doc_id, fp (hash of the text) and node, the least content of its
    class; null without words."""
    text = _content(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    signed = stored(_signed(texts, shingle, weighted, bands, rows), "signed")
    contents = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "fp")).alias("_w"), F.min("bands").alias("bands")).select("node", "_w.doc_id", "_w.fp", "bands")
    contents = stored(contents, "contents")
    buckets = contents.select("node", F.explode("bands").alias("bucket"))
    full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    candidates = stored(buckets.join(full.hint("merge"), "bucket").select("node").distinct(), "candidates")
    nodes = contents.join(candidates.hint("merge"), "node")
    comp = _links(stored(_sets_of(texts, nodes, shingle, weighted), "sets"), threshold)
    named = signed.select("doc_id", "fp", "node")
    if comp is not None:
        named = named.join(comp.hint("merge"), "node", "left").withColumn("node", F.coalesce("comp", "node")).drop("comp")
    return named.select("doc_id", "fp", "node")


def classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, weighted: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, class_id, class_size."""
    named = _classed(docs, threshold, shingle, weighted, bands, rows).drop("fp")
    least = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(least.hint("merge"), "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The documents with one of each class: the one of the least doc_id (a null id only where the
    class has no other), and of rows that share that id, the one of the least hash of its text. Of
    rows that repeat id and text one stays. All columns as they were."""
    found = stored(_classed(docs, threshold, shingle, False, BANDS, ROWS), "classed")
    # the row that stays of each class; rows without words are classes of their own
    first = F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "fp")).alias("_w")
    keep = found.where("node is not null").groupBy("node").agg(first).select("_w.doc_id", "_w.fp")
    keep = keep.union(found.where("node is null").select("doc_id", "fp").distinct()).toDF("_d", "_f")
    text = _content(docs["text"])
    out = docs.join(keep.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(keep["_d"]) & (F.xxhash64(text) == keep["_f"]), "left_semi")
    twice = found.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not twice.limit(1).count():
        return out
    columns = out.columns
    return out.withColumn("_f", F.xxhash64(_content(F.col("text")))).dropDuplicates(["doc_id", "_f"]).select(*columns)
