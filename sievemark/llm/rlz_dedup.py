"""Substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference. It is indexed by blocks: one for each anchor, the stretch of words
that holds all windows of the anchor, known by the hash of its words. Every document is parsed
against all blocks at once by looking up its own: a block found whole elsewhere is a piece, pieces
that continue one another in the same reference are one stretch, and the document is factored
greedily, the stretch that reaches farthest first from the left. What the factors cover is removed.
Where a block is not found whole though its seed occurs elsewhere, a factor begins or ends: there,
and only there, each window is checked by itself, and goes too if it also starts elsewhere.

Defined results: a null or empty text has no words and keeps the hash of nothing; texts shorter
than a window lose nothing; very long texts are parsed whole; ties between references go to the
least document and place; a row that repeats id and text of another loses all its windows, as both
do; rows that share an id but not the text are judged apart; a null doc_id is an id like any other;
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.passages import KEY, anchor_rows, greedy_factors, keyed, removal_digest, window_rows, with_spans  # noqa: F401
from sievemark.llm.shared import stored

WINDOW, SEED = 35, 6


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Spans of window starts that also occur elsewhere: doc_id, fp, lo, cnt, and where else
    (``ref_doc``, ``ref_lo``; -1 where the windows were found one by one)."""
    rows = stored(anchor_rows(docs, window, seed), "blocks")
    # written, so that both sides of the join are dealt by seed and Spark can split one with a third of all rows
    often = stored(rows.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("seed"), "shared-seeds")
    shared = stored(rows.join(often.hint("merge"), "seed"), "shared-blocks")
    place = F.struct("doc_id", "fp", "lo", "cnt")
    classes = shared.groupBy("seed", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    whole = classes.where("n > 1").select("seed", "ctx", "a", "b")
    found = shared.join(whole.hint("merge"), ["seed", "ctx"])
    own = F.struct("doc_id", "fp", "lo", "cnt") == F.col("a")
    ref = F.when(own, F.col("b")).otherwise(F.col("a"))
    found = found.select(*KEY, "lo", "cnt", F.hash(ref["doc_id"], ref["fp"]).cast("long").alias("ref_doc"), ref["lo"].alias("ref_lo"))
    # borders of factors: seeds with several blocks of which one is found nowhere else
    border = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("_m"), F.min("n").alias("_least")).where("_m > 1 and _least = 1").select("seed")
    asked = classes.join(border.hint("merge"), "seed").select(F.col("a.doc_id"), F.col("a.fp"), F.col("a.lo"), F.col("a.cnt"))
    wins = stored(window_rows(with_spans(docs, asked, "inner"), window), "windows")
    twice = wins.groupBy("win").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("win")
    single = wins.join(twice.hint("merge"), "win").select(*KEY, F.col("at").alias("lo"), F.lit(1).alias("cnt"), F.lit(-1).cast("long").alias("ref_doc"), F.lit(-1).alias("ref_lo"))
    return found.unionByName(single)


def removed(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    texts = keyed(docs)
    return removal_digest(with_spans(texts, repeated_spans(texts, window, seed)), window)
