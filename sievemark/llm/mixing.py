"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their id, are laid end to end and cut into blocks
of as many words; a document that reaches over the end of a block goes on in the next, so a long one
takes several. Weights are rounded to whole slots of a cycle. Within a cycle the i-th block of a
source with a of A slots is released at floor((i - 1) A / a) and due at ceil(i A / a); the earliest
deadline among the released goes first. So after any number of slots each source is less than one
block from its share, and as all shares come out whole at the end of a cycle, one cycle's schedule,
of a size fixed by the number of sources, serves corpora of any size: the slot of any block follows
from its number. ``order_of`` gives the blocks' pieces of documents, for which the bound holds word
by word; ``mixed`` keeps documents whole, each where its first piece stands.

Any number of sources will do. Their shares, slots and ranks are columns, rounded over the cluster.
Sources of as many slots have the same releases and deadlines, so the schedule is made of them
together: it holds no more at once than there are different numbers of slots, at most the root of
2.5 cycles (a sum of so many different numbers would not fit), and gives its slots out as rows. One
task makes them, in time that grows with the slots of a cycle, some four to eight for each source
and never with the documents. Nothing by source passes through the driver.

Every document is kept. The bound holds until the first source runs out; from there on its slots
stay empty and the others close up, in the same proportions among themselves.

Defined results: a null source is a source of its own; documents without words (null, empty) take
the block where they stand, as one piece; repeated rows are placed each for itself; ties in the hash
go by doc_id, then text; sources of equal claim to a slot go by name; an empty table gives an empty
result; all columns are kept, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.shared import FEW_ROWS, partitions, running_totals, stored

BLOCK_WORDS, CYCLE, TEMPERATURE = 4096, 1024, 0.5
SALTS = 64


def word_count(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def slots_of(sources: DataFrame, cycle: int = CYCLE) -> tuple[DataFrame, int]:
    """((source, a, nth), cycle length) of (source, weight) rows: whole slots by largest remainders, at
    least one each, and the number of the source among those of as many; the cycle grows with the
    number of sources if it must."""
    known = stored(sources.select("source", F.col("weight").cast("double").alias("weight")), "weights")
    n, least, most = known.agg(F.count(F.lit(1)), F.min("weight"), F.max("weight")).first()
    if not n or least < 0 or most <= 0:
        raise ValueError("weights must not be negative, and not all zero")
    while cycle < 4 * n:
        cycle *= 2
    # summed as decimals: the same whatever the order of the tasks
    total = float(known.agg(F.sum((F.col("weight") / F.lit(most)).cast("decimal(38,18)"))).first()[0])
    exact = F.col("weight") / F.lit(most) / F.lit(total) * F.lit(cycle)
    whole = stored(known.select("source", exact.alias("exact"), F.greatest(F.lit(1), F.floor(exact)).cast("long").alias("a")), "shares")
    short = cycle - whole.agg(F.sum("a")).first()[0]
    if short >= 0:
        top, more, first = cycle, short, F.floor("exact") - F.col("exact")
    else:
        # sources raised to one slot took too many: the largest give them back, down to one level
        sizes = {r["a"]: r["n"] for r in whole.groupBy("a").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the root of 2.5 cycles
        over = lambda level: sum((a - level) * k for a, k in sizes.items() if a > level)
        top, high = 1, max(sizes)
        while top < high:
            at = (top + high + 1) // 2
            top, high = (at, high) if over(at) >= -short else (top, at - 1)
        more, first = over(top) + short, F.when(F.col("a") > top, 0.0).otherwise(1.0)
    ranked = running_totals(whole.select("source", "a", first.alias("first"), F.lit(0).cast("long").alias("zero")), [], ["first", "source"], "zero")
    given = F.least(F.col("a"), F.lit(top)) + (F.col("rank") < more).cast("long")
    slots = ranked.select("source", given.cast("long").alias("a"), "zero")
    return stored(running_totals(slots, ["a"], ["source"], "zero").select("source", "a", F.col("rank").alias("nth")), "slots"), cycle


def schedule(sizes: dict[int, int], cycle: int) -> Iterator[tuple[int, int, int, int, int]]:
    """One cycle, earliest deadline first, for ``sizes[a]`` sources of a slots each: (a, i, first, n, t)
    gives the slots from t on to the i-th blocks of n sources, from number ``first`` on."""
    coming = [(0, a, 0) for a in sorted(sizes)]
    ready: list = []
    t = 0
    while t < cycle:
        while coming and coming[0][0] <= t:
            _, a, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * cycle // a), a, i, 0))
            if i + 1 < a:
                heapq.heappush(coming, ((i + 1) * cycle // a, a, i + 1))
        deadline, a, i, done = heapq.heappop(ready)
        n = min(sizes[a] - done, (coming[0][0] if coming else cycle) - t)
        if t + n > deadline:
            raise AssertionError("a deadline was missed")
        yield a, i, done, n, t
        t += n
        if done + n < sizes[a]:
            heapq.heappush(ready, (deadline, a, i, done + n))


def plan_of(slots: DataFrame, cycle: int) -> DataFrame:
    """(a, nth, i, t): the slot of each block of a cycle, for ``slots_of``'s sources."""

    def run(batches):
        sizes: dict[int, int] = {}
        for b in batches:
            sizes |= zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        held, rows = [], 0

        def made():
            a, i, first, n, t = np.array(held, "int64").T
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = (np.repeat(a, n), np.repeat(first, n) + step, np.repeat(i, n), np.repeat(t, n) + step)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "nth", "i", "t"])

        for a, i, first, n, t in schedule(sizes, cycle) if sizes else ():
            for lo in range(0, n, 1 << 16):
                k = min(1 << 16, n - lo)
                held.append((a, i, first + lo, k, t + lo))
                rows += k
                if rows >= 1 << 16:
                    yield made()
                    held, rows = [], 0
        if held:
            yield made()

    counted = slots.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.repartition(1).mapInArrow(run, "a long, nth long, i long, t long"), "plan")


def target_weights(totals: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, weight) from the sources' sizes ``n``: temperature 1 is in proportion, 0 is alike."""
    return totals.select("source", F.pow(F.greatest(F.lit(1), F.col("n")), F.lit(temperature)).alias("weight"))


def _given_weights(totals: DataFrame, weights: dict) -> DataFrame:
    """(source, weight) as the caller wants them; sources left out share the least."""
    if not weights:
        raise ValueError("weights name no source")
    given = totals.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], f"_s {totals.schema['source'].dataType.simpleString()}, _w double")
    side = F.broadcast(given) if len(weights) <= FEW_ROWS else given.hint("merge")
    joined = totals.join(side, totals["source"].eqNullSafe(given["_s"]), "left")
    return joined.select("source", F.coalesce("_w", F.lit(float(min(weights.values())))).alias("weight"))


def _planned(rows: DataFrame, weights: dict | None, cycle: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int]:
    """((doc_id, source, n_words, tie) rows with what stands before them in their source, the sources'
    slots in a cycle, its plan, its length)."""
    runs = stored(running_totals(rows.withColumn("_o", F.xxhash64("doc_id")), ["source"], ["_o", "doc_id", "tie"], "n_words"), "placed")
    totals = stored(runs.groupBy("source").agg(F.sum("n_words").alias("n")), "sources")
    if not totals.limit(1).count():
        return runs, None, None, cycle
    slots, length = slots_of(target_weights(totals) if weights is None else _given_weights(totals, weights), cycle)
    return runs, slots, plan_of(slots, length), length


def _slotted(rows: DataFrame, slots: DataFrame, plan: DataFrame, length: int) -> DataFrame:
    """Adds ``slot`` to rows with a source and a ``block`` of it."""
    table = slots.withColumnRenamed("source", "_s")
    if table.count() <= FEW_ROWS:
        met = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_s"]))
    else:
        # a source with a third of all rows is met by many tasks
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "block"), F.lit(SALTS)))
        table = table.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = rows.join(table.hint("merge"), (rows["_salt"] == table["_at"]) & rows["source"].eqNullSafe(table["_s"]))
    of = plan.withColumnsRenamed({"a": "_a", "nth": "_nth", "i": "_i"})
    nth_of = (F.col("a") == F.col("_a")) & (F.col("nth") == F.col("_nth")) & (F.col("block") % F.col("a") == F.col("_i"))
    if of.count() <= FEW_ROWS:
        met = met.join(F.broadcast(of), nth_of)
    else:
        met = met.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "block"), F.lit(SALTS)))
        of = of.withColumn("_pick", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = met.join(of.hint("merge"), nth_of & (F.col("_salt") == F.col("_pick")))
    return met.select(*(c for c in rows.columns if c != "_salt"), (F.floor(F.col("block") / F.col("a")) * F.lit(length) + F.col("t")).cast("long").alias("slot"))


def placed(rows: DataFrame, weights: dict | None = None, block_words: int = BLOCK_WORDS, cycle: int = CYCLE) -> DataFrame:
    """Adds to (doc_id, source, n_words, tie) rows the block and slot of their first word, and the
    words and rows before them in their source.

    ``weights`` by source; sources that it leaves out share the least weight. Without it they follow
    from the sources' sizes over all documents.
    """
    runs, slots, plan, length = _planned(rows, weights, cycle)
    names = ["doc_id", "source", "n_words", "tie", "block", "slot", "before", "rank"]
    runs = runs.withColumn("block", F.floor(F.col("before") / F.lit(block_words)).cast("long"))
    if slots is None:
        return runs.withColumn("slot", F.lit(0).cast("long")).select(*names)
    return _slotted(runs, slots, plan, length).select(*names)


def _rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("n_words"), F.hash("text").alias("tie"))


def places(docs: DataFrame, weights: dict | None = None, block_words: int = BLOCK_WORDS, cycle: int = CYCLE) -> DataFrame:
    """``placed`` for documents; by (slot, rank) they stand in the mixed order, without ties."""
    return placed(_rows_of(docs), weights, block_words, cycle)


def order_of(docs: DataFrame, weights: dict | None = None, block_words: int = BLOCK_WORDS, cycle: int = CYCLE) -> DataFrame:
    """The blocks' pieces, one row or more for each document: doc_id, source, piece (from 0), start_word
    in the document, n_words of the piece, block of the source, slot, and rank of the document in its
    source. By (slot, rank) the pieces stand in the mixed order."""
    runs, slots, plan, length = _planned(_rows_of(docs), weights, cycle)
    names = ["doc_id", "source", "piece", "start_word", "n_words", "block", "slot", "rank"]
    if slots is None:
        zero = F.lit(0).cast("long")
        return runs.select("doc_id", "source", zero.alias("piece"), zero.alias("start_word"), "n_words", zero.alias("block"), zero.alias("slot"), "rank")
    first, size = F.floor(F.col("before") / F.lit(block_words)).cast("long"), F.lit(block_words).cast("long")
    last = F.greatest(first, F.floor((F.col("before") + F.col("n_words") - 1) / F.lit(block_words)).cast("long"))
    cut = runs.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * size - F.col("before"), F.lit(0).cast("long"))
    end = F.least((F.col("block") + 1) * size - F.col("before"), F.col("n_words"))
    each = cut.select("doc_id", "source", (F.col("block") - first).alias("piece"), start.alias("start_word"), (end - start).alias("n_words"), "block", "rank")
    return _slotted(each, slots, plan, length).select(*names)


def mixed(docs: DataFrame, weights: dict | None = None, block_words: int = BLOCK_WORDS, cycle: int = CYCLE) -> DataFrame:
    """The documents, all columns as they were, in the mixed order over the partitions."""
    found = places(docs, weights, block_words, cycle).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("tie").alias("_t")).agg(F.min("slot").alias("_slot"), F.min("rank").alias("_rank"))
    on = docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & docs["source"].eqNullSafe(found["_s"]) & (F.hash(docs["text"]) == found["_t"])
    joined = docs.join(found.hint("merge"), on).select(*(docs[c] for c in docs.columns), found["_slot"], found["_s"], found["_rank"])
    ordered = joined.repartitionByRange(partitions(docs), "_slot", "_rank").sortWithinPartitions("_slot", "_rank")
    return ordered.drop("_slot", "_s", "_rank")
