"""Suffix-array dedup: a sparse suffix array over the whole corpus.

Suffixes are retained at minimiser positions only. The array is sorted across the cluster word by
word (in the order of 16-bit numbers, the upper bits of the words' hashes), then by a 64-bit hash of
all the words around, then by document and place, so that a suffix that thousands of documents
share is spread over many tasks. Neighbours are compared for the words they share; where two words have one number, they
seem to share more, which asks for more windows and never for fewer. A suffix that agrees with its
neighbour in all words, by the hash of those to the left as well, repeats that neighbour. Of the
others, no suffix anywhere shares more words than a neighbour does: that is how far a match can
reach to the right, and it leaves few windows to be extended to the left. At the borders of tasks,
where a neighbour is not seen, the full reach is assumed, which asks for more windows and changes
no result.

Of every passage of ``length`` or more words that occurs more than once, the first copy (by doc_id,
then place) stays, and the later ones are duplicate spans.

Defined results: null, empty and short texts have no spans; rows that repeat both id and text are
one document and no copies of one another; rows that share an id but not the text are ordered by
a hash of the text; a null doc_id comes first; an empty table gives an empty result. In
``deduplicated`` all columns of the input are kept; a text with no span stays as it is, byte for
byte, and a null text stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.passages import KEY, _runs_of_spans, anchor_rows, covered, keyed, kept_bytes, window_rows, with_spans
from sievemark.llm.shared import partitions, stored
from sievemark.llm.wordscan import Words, text_chunks

LENGTH, SEED = 50, 8
ORDER = ["suffix", "ctx", "doc_id", "fp", "lo"]
ARRAY_SCHEMA = "doc_id long, fp int, lo int, cnt int, again boolean, ref_doc long, ref_fp int, ref_lo int, shared int"


def _shared_words(suffixes: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each suffix; how many of them, from the first on, it shares with the one before)."""
    bounds = np.frombuffer(suffixes.buffers()[1], "int32")[suffixes.offset : suffixes.offset + len(suffixes) + 1] // 2
    flat = np.frombuffer(suffixes.buffers()[2], "uint16")
    size = np.diff(bounds)
    place = np.arange(most)
    table = flat[np.minimum(bounds[:-1, None] + place, len(flat) - 1)]
    common = np.zeros(len(size), "int64")
    least = np.minimum(size[1:], size[:-1])
    same = (table[1:] == table[:-1]) & (place < least[:, None])
    common[1:] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return size, common


def suffix_array(rows: DataFrame, length: int) -> DataFrame:
    """The anchor rows in suffix order, each compared with its neighbours. ``again``: it agrees with
    the one before, ``ref_*``, in all words. The others are the first of their context: ``shared``
    is the most words from the anchor on that a neighbour has too, and ``cnt`` is cut to the windows
    that end within them; those with no such window are left out."""
    names = [x.split()[0] for x in ARRAY_SCHEMA.split(", ")]

    def run(batches):
        before: pa.Table | None = None  # the last row seen
        held: tuple | None = None  # the last context's first row, whose next neighbour is not known yet

        def firsts(t: pa.RecordBatch, at: np.ndarray, size: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
            lo, cnt = (t.column(i).to_numpy()[at].astype("int64") for i in (4, 5))
            anchor = lo + cnt - 1 + length - size
            cnt = np.minimum(cnt, anchor + shared - length - lo + 1)
            keep = np.flatnonzero(cnt > 0)
            idx, none = pa.array(at[keep]), pa.nulls(len(keep))
            return pa.RecordBatch.from_arrays(
                [t.column(2).take(idx), t.column(3).take(idx), t.column(4).take(idx), pa.array(cnt[keep].astype("int32")), pa.array(np.zeros(len(keep), bool)),
                 none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), pa.array(shared[keep].astype("int32"))],
                names=names,
            )

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if before is None else pa.concat_tables([before, pa.Table.from_batches([b])])
            t = t.combine_chunks().to_batches()[0]
            known = 0 if before is None else 1  # row 0 is there only to be compared with
            size, common = _shared_words(t.column(6), length)
            ctx = t.column(1).to_numpy()
            again = np.zeros(t.num_rows, bool)
            again[1:] = (common[1:] >= size[1:]) & (size[1:] == size[:-1]) & (ctx[1:] == ctx[:-1])
            at = np.flatnonzero(again)
            if len(at):
                idx, prev = pa.array(at), pa.array(at - 1)
                yield pa.RecordBatch.from_arrays(
                    [*(t.column(i).take(idx) for i in (2, 3, 4, 5)), pa.array(np.ones(len(at), bool)), *(t.column(i).take(prev) for i in (2, 3, 4)), pa.array(size[at].astype("int32"))],
                    names=names,
                )
            at = np.flatnonzero(~again[known:]) + known
            if len(at):
                back = common[at]
                if not known:
                    back[0] = length
                if held is not None:
                    row, n, shared = held
                    yield firsts(row, np.zeros(1, "int64"), n, np.maximum(shared, back[:1]))
                yield firsts(t, at[:-1], size[at[:-1]], np.maximum(back[:-1], back[1:]))
                held = pa.Table.from_batches([t.slice(int(at[-1]), 1)]).take([0]).combine_chunks().to_batches()[0], size[at[-1:]], back[-1:]
            before = pa.Table.from_batches([t.slice(t.num_rows - 1, 1)]).take([0])
        if held is not None:
            yield firsts(held[0], np.zeros(1, "int64"), held[1], np.full(1, length))

    ordered = rows.repartitionByRange(partitions(rows), *ORDER).sortWithinPartitions(*ORDER)
    return stored(ordered.mapInArrow(run, ARRAY_SCHEMA), "suffixes")


def later_copies(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Spans of window starts that also occur earlier: doc_id, fp, lo, cnt, ref_doc, ref_lo."""
    array = suffix_array(anchor_rows(docs, length, seed, suffix=True), length)
    itself = F.col("doc_id").eqNullSafe(F.col("ref_doc")) & (F.col("fp") == F.col("ref_fp")) & (F.col("lo") == F.col("ref_lo"))
    again = array.where(F.col("again") & ~itself).select(*KEY, "lo", "cnt", "ref_doc", "ref_lo")
    # the first suffix of each context, where neighbours share enough words: extended window by window
    asked = array.where(~F.col("again")).select(*KEY, "lo", "cnt")
    wins = stored(window_rows(with_spans(docs, asked, "inner"), length), "windows")
    place = F.struct("doc_id", "fp", "at")
    first = wins.groupBy("win").agg(F.min(place).alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("win", "a")
    extended = wins.join(first.hint("merge"), "win").where(~(F.struct("doc_id", "fp", "at").eqNullSafe(F.col("a"))))
    extended = extended.select(*KEY, F.col("at").alias("lo"), F.lit(1).alias("cnt"), F.col("a.doc_id").alias("ref_doc"), F.col("a.at").alias("ref_lo"))
    return again.unionByName(extended)


def _merged(a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the spans, where a new stretch begins in it, and the stretches' ends."""
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate(e[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > e[:-1]
    at = np.flatnonzero(new)
    return order, at, np.maximum.reduceat(e, at)


def duplicate_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The duplicate spans themselves, one row for each maximal stretch: doc_id, start_word,
    end_word (exclusive), n_words, and one earlier copy of its beginning (ref_doc_id, ref_word)."""
    texts = keyed(docs)
    spans = later_copies(texts, length, seed)
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "cnt", "ref_doc", "ref_lo")).alias("spans"))

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "start_word", "end_word", "n_words", "ref_doc_id", "ref_word")}
            size, field = _runs_of_spans(b.column(1))
            begin = np.cumsum(size) - size
            for i in range(b.num_rows):
                s = slice(begin[i], begin[i] + size[i])
                a = field["lo"][s]
                order, at, ends = _merged(a, a + field["cnt"][s] + length - 1)
                for k, end in zip(order[at].tolist(), ends.tolist()):
                    start = int(a[k])
                    for name, v in zip(out, (b.column(0)[i].as_py(), start, end, end - start, field["ref_doc"][s][k], field["ref_lo"][s][k])):
                        out[name].append(None if v is None or v != v else int(v))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return lists.select("doc_id", "spans").mapInArrow(run, "doc_id long, start_word long, end_word long, n_words long, ref_doc_id long, ref_word long")


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The documents without later copies: texts that lose words have the rest joined by single
    spaces, and ``n_chars``, where there is such a column, follows. A text that loses all its
    words stays as an empty one."""
    texts = keyed(docs)
    spans = later_copies(texts, length, seed)
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "cnt")).alias("_spans")).withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    fp = F.hash(F.coalesce(docs["text"].cast("string"), F.lit("")))
    joined = docs.join(lists.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(lists["_d"]) & (fp == lists["_f"]), "left").select(*(docs[c] for c in docs.columns), lists["_spans"])
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for b in batches:
            size, field = _runs_of_spans(b.column(b.num_columns - 1))
            begin = np.cumsum(size) - size
            at = np.flatnonzero(size)
            texts = b.column(place).take(pa.array(at))
            new = []
            for lo, hi, data, offsets in text_chunks(texts):
                words = Words(data, offsets)
                for i in range(lo, hi):
                    first = int(words.first[i - lo])
                    n = int(words.first[i - lo + 1]) - first
                    s = slice(begin[at[i]], begin[at[i]] + size[at[i]])
                    a = field["lo"][s]
                    new.append(kept_bytes(words, first, covered(n, a, a + field["cnt"][s] + length - 1)).decode("utf-8", "replace"))
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            if len(at):
                # the changed texts follow the others and are then taken in place
                both = pa.concat_arrays([b.column(place), pa.array(new, b.column(place).type)])
                pick = np.arange(b.num_rows)
                pick[at] = b.num_rows + np.arange(len(at))
                columns[place] = both.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out
