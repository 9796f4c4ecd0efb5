"""Repeated passages: the anchor rows of a corpus, the hashes of the windows around chosen anchors,
and texts without given spans. Shared by the two substring operators.

A window is ``length`` consecutive words of one text. Each belongs to exactly one anchor, chosen by
its own words (see wordscan.anchors), so equal windows have equal anchors: only anchors whose seed
occurs twice can stand for repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.wordscan import Runs, Words, anchors, text_chunks

#: A row is known by its doc_id and a hash of its text: repeated ids with other texts stay apart.
KEY = ["doc_id", "fp"]
ANCHOR_SCHEMA = "seed long, ctx long, doc_id long, fp int, lo int, cnt int"


def keyed(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.hash(t).alias("fp"), t.alias("text"))


def anchor_rows(docs: DataFrame, length: int, seed: int, suffix: bool = False) -> DataFrame:
    """One row for each anchor of the keyed texts: its seed, a hash of all words of its windows
    (``ctx``), and the first of its ``cnt`` window starts (``lo``). With ``suffix``, also the words
    from the anchor to the end of its last window, as a binary of 16-bit word numbers that compares
    word by word."""

    def run(batches):
        for b in batches:
            ids, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_chunks(b.column(2)):
                words = Words(data, offsets)
                hashes = words.hashes()
                runs = Runs(hashes)
                at, seeds, first, last = anchors(words, runs, seed, length - seed + 1)
                if not len(first):
                    continue
                doc = np.searchsorted(words.first, first, side="right") - 1
                row = lo + doc
                columns = [
                    pa.array(seeds.view("int64")),
                    pa.array(runs.of(first, last + length).view("int64")),
                    pa.array(np.nan_to_num(ids[row]).astype("int64"), mask=missing[row]),
                    pa.array(fps[row]),
                    pa.array((first - words.first[doc]).astype("int32")),
                    pa.array((last - first + 1).astype("int32")),
                ]
                if suffix:
                    columns.append(_word_numbers(hashes, at, last + length))
                yield pa.RecordBatch.from_arrays(columns, names=["seed", "ctx", "doc_id", "fp", "lo", "cnt", "suffix"][: len(columns)])

    return docs.mapInArrow(run, ANCHOR_SCHEMA + (", suffix binary" if suffix else ""))


def _word_numbers(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words from ``start`` to ``end`` of each run, each as the upper 16 bits of its hash."""
    size = end - start
    bounds = np.append(0, np.cumsum(size))
    place = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
    flat = (hashes >> np.uint64(48)).astype(">u2")[place]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * bounds).astype("int32")), pa.py_buffer(flat)])


def with_spans(docs: DataFrame, spans: DataFrame, how: str = "left") -> DataFrame:
    """Each keyed text with ``spans``, the list of its (lo, cnt, ...) structs. The texts move once
    in a plan, however often this is asked in it: the exchange is the same and is reused."""
    fields = [c for c in spans.columns if c not in KEY]
    lists = spans.groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias("spans"))
    lists = lists.withColumnsRenamed({"doc_id": "_d", "fp": "_f"})
    on = docs["doc_id"].eqNullSafe(lists["_d"]) & (docs["fp"] == lists["_f"])
    return docs.join(lists.hint("merge"), on, how).select(*docs.columns, "spans")


def _runs_of_spans(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(spans of each row, flat fields) of a list-of-structs column."""
    size = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype="float64")).astype("int64")
    flat = column.flatten()
    return size, {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def window_rows(texts: DataFrame, length: int) -> DataFrame:
    """The hash of every window that the spans of the texts stand for: ``win``, doc_id, fp, ``at``."""

    def run(batches):
        for b in batches:
            ids, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
            size, field = _runs_of_spans(b.column(3))
            begin = np.cumsum(size) - size
            for lo, hi, data, offsets in text_chunks(b.column(2)):
                words = Words(data, offsets)
                win = Runs(words.hashes()).all(length)
                some = slice(begin[lo], begin[lo] + size[lo:hi].sum())
                row = np.repeat(np.arange(lo, hi), size[lo:hi])
                first, cnt = field["lo"][some], field["cnt"][some]
                at = np.repeat(first, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
                row = np.repeat(row, cnt)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(win[words.first[row - lo] + at].view("int64")),
                        pa.array(np.nan_to_num(ids[row]).astype("int64"), mask=missing[row]),
                        pa.array(fps[row]),
                        pa.array(at.astype("int32")),
                    ],
                    names=["win", "doc_id", "fp", "at"],
                )

    return texts.mapInArrow(run, "win long, doc_id long, fp int, at int")


def covered(n: int, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    step = np.zeros(n + 1, "int32")
    np.add.at(step, lo, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def kept_bytes(words: Words, first: int, gone: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    at = np.flatnonzero(~gone) + first
    start, end = words.start[at].tolist(), words.end[at].tolist()
    low = start[0] if start else 0
    text = words.data[low : end[-1] if end else 0].tobytes()
    return b" ".join([text[s - low : e - low] for s, e in zip(start, end)])


def greedy_factors(a: np.ndarray, e: np.ndarray, ref_doc: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the factors of one text, from pieces found in the index: words ``a`` to ``e``
    stand in document ``ref_doc``, ``shift`` words further on. Pieces that continue one another in
    the same reference are one stretch; from the left, the stretch that reaches farthest is taken,
    and the next factor begins where it ends, or at the next piece."""
    order = np.lexsort((a, shift, ref_doc))
    a, e, ref_doc, shift = a[order], e[order], ref_doc[order], shift[order]
    new = np.ones(len(a), bool)
    new[1:] = (ref_doc[1:] != ref_doc[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > e[:-1])
    at = np.flatnonzero(new)
    start, end = a[at], np.maximum.reduceat(e, at)
    by = np.argsort(start, kind="stable")
    start, end = start[by], end[by]
    farthest = np.maximum.accumulate(end)
    starts, ends, here, k = [], [], -1, 0
    while k < len(start):
        # the stretches that begin where this factor may begin, or before
        here = max(here, int(start[k]))
        k = int(np.searchsorted(start, here, side="right"))
        if (reach := int(farthest[k - 1])) > here:
            starts.append(here)
            ends.append(reach)
            here = reach
    return np.array(starts, "int64"), np.array(ends, "int64")


def removal_digest(texts: DataFrame, length: int) -> DataFrame:
    """For each text with its spans: how many words it has, how many are removed, and the SHA-256 of
    the rest. The text is parsed greedily into factors against the index (spans with a reference,
    ``ref_doc`` and ``ref_lo``); what its factors cover goes, and so do the windows that reach over
    a factor's border and were found elsewhere by themselves (``ref_lo`` -1)."""

    def run(batches):
        for b in batches:
            size, field = _runs_of_spans(b.column(3))
            begin = np.cumsum(size) - size
            out = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for lo, hi, data, offsets in text_chunks(b.column(2)):
                words = Words(data, offsets)
                for i in range(lo, hi):
                    first = int(words.first[i - lo])
                    n = int(words.first[i - lo + 1]) - first
                    s = slice(begin[i], begin[i] + size[i])
                    a, ref = field["lo"][s], field["ref_lo"][s]
                    e = a + field["cnt"][s] + length - 1
                    piece = ref >= 0
                    starts, ends = greedy_factors(a[piece], e[piece], field["ref_doc"][s][piece], (ref - a)[piece])
                    gone = covered(n, np.concatenate([starts, a[~piece]]), np.concatenate([ends, e[~piece]]))
                    out["n_words"].append(n)
                    out["n_removed"].append(int(gone.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept_bytes(words, first, gone)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), **{k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()}})

    return texts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
