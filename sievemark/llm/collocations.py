"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word with the words that follow it in its piece, up to
``longest``, in lead columns that are padded where the piece ends. One Spark ROLLUP over these columns
then adds up every shorter prefix, so that phrases of each length, words and the number of all words
come from one grouping, and no text is taken apart once for each length.

Before that, windows of one, two and three words are counted by hash, one length after the other; a
phrase can't occur ``least`` times if a run of its words doesn't, so windows are padded from the first
such run on that is too rare. A bit array of bounded size for each length says which runs are frequent. It may call
a rare one frequent, never the reverse, so it only saves work: the counts of all phrases with ``least``
occurrences or more are whole.

Defined results: a null text counts as empty, a null language as ``und``; rows with the same text are
counted each. Texts of any length are taken whole: longer ones are read in parts that end where a
piece ends. An empty table gives an empty result. Only the text and the language are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.llm.shared import sized, stored
from sievemark.llm.wordscan import LEFT, RIGHT, U, Words, byte_class, mix, text_chunks

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD_ENDS = b" \x09"
PIECE_BYTES = ~byte_class(PIECE_ENDS)
WORDS = byte_class(PIECE_ENDS + WORD_ENDS)
LOWER = np.arange(256, dtype="uint8")
LOWER[ord("A") : ord("Z") + 1] += 32
CHUNK_BYTES = 1 << 21
#: Windows of so many words at most are counted by hash beforehand.
PRUNED = 3
#: Bits for each frequent run of one length, and most bits of a length: 32 MB.
BITS_EACH, LOG_MOST_BITS = 16, 28
EXACT = "decimal(38,0)"


def parts(column: pa.Array, max_bytes: int):
    """(first row, end row, lower-cased bytes, offsets) of runs of whole texts, or of a part of one
    long text that ends where a piece does."""
    for lo, hi, data, offsets in text_chunks(column, max_bytes):
        data = LOWER[data]
        if hi - lo > 1 or len(data) <= max_bytes:
            yield lo, hi, data, offsets
            continue
        ends = np.flatnonzero(PIECE_BYTES[data]) + 1
        begin = 0
        while begin < len(data):
            # the last end of a piece within reach, or the next one
            k = int(np.searchsorted(ends, begin + max_bytes, side="right")) - 1
            end = int(ends[k]) if k >= 0 and ends[k] > begin else int(ends[k + 1]) if k + 1 < len(ends) else len(data)
            yield lo, hi, data[begin:end], np.array([0, end - begin])
            begin = end


class Pieces:
    """The words of a run of texts, their languages, and which of them have a next word in their piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        self.words = words = Words(data, offsets, WORDS)
        text = words.text_of()
        self.lang = lang[text]
        piece = np.cumsum(PIECE_BYTES[data], dtype="int32")[words.start]
        self.linked = np.zeros(words.n, bool)
        self.linked[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])

    def hashes(self, lang_hash: np.ndarray) -> np.ndarray:
        """Of each word in its language."""
        return mix(self.words.hashes() ^ lang_hash[self.lang])

    def windows(self, lang_hash: np.ndarray, filters: list, longest: int):
        """For k from 1 to ``longest``: the hashes of the windows of k words, and at which words one
        begins that may be frequent, as far as the filters (of windows of up to so many words) tell."""
        h = self.hashes(lang_hash)
        on = np.ones(len(h), bool)
        for k in range(1, longest + 1):
            if k > 1:
                h = np.append(mix(h[:-1] * LEFT + h[1:] * RIGHT), U(0))[: len(h)]
                on = on & _ahead(on, 1, False)
                if k == 2:
                    on &= self.linked
            if k <= len(filters):
                on[on] = _set(*filters[k - 1], h[on])
            yield h, on

    def strings(self) -> pa.Array:
        """The words, each distinct one stored once."""
        w = self.words
        size = w.end - w.start
        inside = np.zeros(len(w.data) + 1, "int8")
        inside[w.start] += 1
        inside[w.end] -= 1
        flat = w.data[np.cumsum(inside[:-1], dtype="int8") > 0]
        offsets = np.append(0, np.cumsum(size)).astype("int32")
        return pa.Array.from_buffers(pa.string(), w.n, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct languages of a batch, a hash of each, and the number of each row's."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    return names, np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], U), coded.indices.to_numpy(zero_copy_only=False)


def run_hashes(docs: DataFrame, filters: list, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Hashes of the windows of one word more than the filters know (``h``), and how often each occurs
    (``n``). Only windows whose parts may be frequent are counted."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            _, lang_hash, lang = _languages(b.column(0))
            for lo, hi, data, offsets in parts(b.column(1), max_bytes):
                *_, (h, on) = Pieces(data, offsets, lang[lo:hi]).windows(lang_hash, shared.value, len(shared.value) + 1)
                h, n = np.unique(h[on], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view("int64")), pa.array(n.astype("int64"))], names=["h", "n"])

    return docs.select("lang", "text").mapInArrow(run, "h long, n long")


def _slots(h: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << log_bits) - 1)
    return h & mask, (h >> U(32)) & mask


def frequent_bits(counted: DataFrame, least: int, most_bits: int = LOG_MOST_BITS) -> tuple[int, np.ndarray]:
    """The bit array of the hashes that occur ``least`` times: its size as a power of two, and its bytes.
    Tasks set the bits of blocks of 32,768; only the blocks, of bounded size in all, come to the driver."""
    often = stored(counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "runs")
    log_bits = min(most_bits, max(15, (BITS_EACH * max(1, often.count()) - 1).bit_length()))
    mask = F.lit((1 << log_bits) - 1)
    slots = often.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("slot"))
    block = slots.groupBy((F.shiftright("slot", 15)).alias("block")).agg(F.bitmap_construct_agg((F.col("slot").bitwiseAND(F.lit((1 << 15) - 1)))).alias("bits"))
    out = np.zeros(1 << max(12, log_bits - 3), "uint8")
    for r in block.collect():
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), "uint8")
    return log_bits, out


def _set(log_bits: int, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _slots(h, log_bits)
    return ((bits[a >> U(3)] >> (a & U(7)).astype("uint8")) & (bits[b >> U(3)] >> (b & U(7)).astype("uint8")) & 1).astype(bool)


def _ahead(x: np.ndarray, k: int, rest) -> np.ndarray:
    """What stands ``k`` places on, for each place."""
    out = np.full(len(x), rest, x.dtype)
    out[: max(0, len(x) - k)] = x[k:]
    return out


def lead_windows(docs: DataFrame, longest: int, filters: list = (), max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The longest window of every word: lang, w1 to w``longest`` (padded with empty words from the
    end of the piece on, or from where the filters rule it out), and how often it occurs (``n``).
    Words that are rare themselves are windows of padding, so that all are counted."""
    columns = [f"w{k + 1}" for k in range(longest)]
    shared = docs.sparkSession.sparkContext.broadcast(list(filters))

    def run(batches):
        for b in batches:
            names, lang_hash, lang = _languages(b.column(0))
            for lo, hi, data, offsets in parts(b.column(1), max_bytes):
                pieces = Pieces(data, offsets, lang[lo:hi])
                if not pieces.words.n:
                    continue
                coded = pieces.strings()
                here = coded.indices.to_numpy(zero_copy_only=False).astype("int32")
                # the lead columns: the number of the word k places on, or -1
                lead = [np.where(on, _ahead(here, k, -1), -1) for k, (_, on) in enumerate(pieces.windows(lang_hash, shared.value, longest))]
                table = pa.table({"lang": pa.array(pieces.lang), **{c: pa.array(x) for c, x in zip(columns, lead)}})
                counts = table.group_by(["lang", *columns]).aggregate([([], "count_all")])
                # the last of the dictionary is the padding
                values = pa.concat_arrays([coded.dictionary, pa.array([""])])
                pad = len(values) - 1
                out = [pa.array(names, pa.string()).take(counts["lang"].combine_chunks())]
                for c in columns:
                    x = counts[c].combine_chunks().to_numpy()
                    out.append(values.take(pa.array(np.where(x < 0, pad, x))))
                yield pa.RecordBatch.from_arrays([*out, counts["count_all"].combine_chunks().cast(pa.int64())], names=["lang", *columns, "n"])

    return docs.select("lang", "text").mapInArrow(run, f"lang string, {', '.join(c + ' string' for c in columns)}, n long")


def phrase_counts(docs: DataFrame, longest: int, least: int, max_bytes: int = CHUNK_BYTES, most_bits: int = LOG_MOST_BITS) -> DataFrame:
    """lang, words (0: all words of the language), phrase, f: phrases that occur ``least`` times or more."""
    filters: list = []
    for _ in range(min(PRUNED, longest)):
        filters.append(frequent_bits(run_hashes(docs, filters, max_bytes), least, most_bits))
    columns = [f"w{k + 1}" for k in range(longest)]
    # equal windows are added up first: the rollup then makes its rows of each distinct one, not of each task's
    windows = lead_windows(docs, longest, filters, max_bytes).groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    summed = windows.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id("lang", *columns).alias("g"))
    # of ``longest`` columns the last ones are summed up: their bits are set
    words = F.lit(longest) - F.bit_count("g")
    last = F.coalesce(F.try_element_at(F.array(*columns), F.greatest(words, F.lit(1))), F.lit(""))
    named = summed.where(F.col("lang").isNotNull()).select("lang", words.cast("int").alias("words"), F.concat_ws(" ", *columns).alias("phrase"), "f", last.alias("_last"))
    return named.where((F.col("words") == 0) | ((F.col("_last") != "") & (F.col("f") >= least))).drop("_last")


def score_of(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact in 38 digits."""
    return F.call_function("div", F.lit(1000).cast(EXACT) * a.cast("decimal(19,0)") * n.cast("decimal(19,0)"), left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", max_bytes: int = CHUNK_BYTES, most_bits: int = LOG_MOST_BITS) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l,
    r, n, score, words, cut (words before it)."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = stored(phrase_counts(rows, longest, least, max_bytes, most_bits), "phrases")
    known = counts.where("words > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias("_f"))
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), words.alias("list"))

    # as long a part as can be is as often as the whole: the same then holds for every part between
    longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array(F.slice("list", 1, F.col("words") - 1), F.slice("list", 2, F.col("words") - 1))).alias("part"))
    swallowed = longer.select(F.col("lang").alias("_lang"), F.array_join("part", " ").alias("_phrase"), F.col("a").alias("_a")).distinct()
    kept = candidates.join(swallowed.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (F.col("a") == F.col("_a")), "left_anti")

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "words", "phrase", "a", "cut", F.array_join(F.slice("list", 1, F.col("cut")), " ").alias("left"), F.array_join(F.slice("list", F.col("cut") + 1, F.col("words")), " ").alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.hint("merge"), (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).withColumnRenamed("_f", name).drop("_lang", "_phrase")
    # one row a language
    totals = stored(counts.where("words = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n")), "totals")
    cuts = cuts.join(sized(totals), F.col("lang") == F.col("_lang")).drop("_lang")
    cuts = cuts.withColumn("score", score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n", "words")).alias("x")).select("lang", "phrase", "x.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return weakest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "words", "cut")
