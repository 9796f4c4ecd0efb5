"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut: full pieces are sequences of their own, the rest
is packed. Packing looks at lengths only, so it is planned on the histogram of lengths, which has
no more entries than the largest length has words, however many documents there are: longest
first, each length goes to the open bins with the least room that takes it; where none does, the
bin size is opened whose expected cost for a word is least, given how much smaller stock is left
to fill it; at the end every bin is downsized to the smallest length that holds its contents. The
plan's bins are then dealt to the documents by their rank among those of the same length: by
doc_id, or where the documents' places in a mixed order are given, by place; all bins then fill
evenly along that order, and are numbered by the place of their first document.

Defined results: documents without words (null, empty) are in no bin (bin_id null, length 0), as one
piece; repeated rows and ties are packed each for itself, by doc_id; a null doc_id is an id like
any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.mixing import word_count
from sievemark.llm.shared import partitions, running_totals, stored

SIZES = (512, 1024, 2048, 4096)
RUN = 1 << 16


def cost_of(size: int) -> float:
    """Cost of a sequence: its length, and a fixed part."""
    return size + 16.0


class Plan:
    """Bins in groups of equals. ``groups``: (size, [(length, offset), ...], number of bins)."""

    def __init__(self, histogram: dict[int, int], sizes: tuple[int, ...], cost: Callable[[int], float] = cost_of):
        sizes = tuple(sorted(sizes))
        stock = sum(n * c for n, c in histogram.items())
        contents: list[tuple[int, int, int]] = []  # of a group: (group before, length, how many of it)
        count: list[int] = []
        room: dict[int, list[int]] = {}
        rooms: list[int] = []
        used: list[int] = []

        def put(parent: int, length: int, each: int, bins: int, left: int, full: int) -> None:
            contents.append((parent, length, each))
            count.append(bins)
            used.append(full)
            if left > 0:
                if left not in room:
                    insort(rooms, left)
                room.setdefault(left, []).append(len(count) - 1)

        for length in sorted(histogram, reverse=True):
            n = histogram[length]
            stock -= n * length
            while n:
                k = bisect_left(rooms, length)
                if k < len(rooms):
                    left = rooms[k]
                    g = room[left].pop()
                    if not room[left]:
                        del room[left]
                        rooms.pop(k)
                    # as many of the same as fit, in as many bins as there are
                    each = min(left // length, n)
                    bins = min(count[g], n // each)
                    if bins < count[g]:
                        put(*contents[g], count[g] - bins, left, used[g])
                        count[g] = 0
                    put(g if count[g] else len(count) - 1, length, each, bins, left - each * length, used[g] + each * length)
                    count[g] = 0
                    n -= each * bins
                    continue
                size = self._open(length, n, stock, sizes, cost)
                each = min(size // length, n)
                bins = n // each
                put(-1, length, each, bins, size - each * length, each * length)
                n -= each * bins
        self.groups: list[tuple[int, list[tuple[int, int]], int]] = []
        for g, bins in enumerate(count):
            if bins:
                chain, at = [], g
                while at >= 0:
                    parent, length, each = contents[at]
                    chain.append((length, each))
                    at = parent
                offset, inside = 0, []
                for length, each in chain[::-1]:
                    for _ in range(each):
                        inside.append((length, offset))
                        offset += length
                self.groups.append((next(s for s in sizes if s >= offset), inside, bins))

    @staticmethod
    def _open(length: int, n: int, stock: int, sizes: tuple[int, ...], cost: Callable[[int], float]) -> int:
        """The size of the least expected cost for each word that it will hold."""

        def price(size: int) -> float:
            each = min(size // length, n)
            filled = each * length
            bins = max(1, n // each)
            filled += min(size - filled, stock // bins)
            final = next(s for s in sizes if s >= filled)
            return cost(final) / filled

        return min((s for s in sizes if s >= length), key=lambda s: (price(s), s))

    def cost(self, cost: Callable[[int], float] = cost_of) -> float:
        return sum(cost(size) * bins for size, _, bins in self.groups)


def planned(histogram: dict[int, int], sizes: tuple[int, ...], cost: Callable[[int], float] = cost_of) -> Plan:
    """The cheapest plan over all choices of the largest size that may be opened; whatever the
    choice, bins are downsized at the end."""
    longest = max(histogram, default=0)
    options = [tuple(s for s in sorted(sizes) if s <= top) for top in sizes if top >= longest]
    options += [(top,) for top in sizes if top >= longest and len(sizes) > 1]
    plans = []
    for option in options:
        plan = Plan(histogram, option, cost)
        plan.groups = [(next(s for s in sorted(sizes) if s >= inside[-1][0] + inside[-1][1]), inside, bins) for _, inside, bins in plan.groups]
        plans.append(plan)
    return min(plans, key=lambda p: p.cost(cost))


def _deal_table(plan: Plan) -> tuple[np.ndarray, ...]:
    """Places in the bins by length and rank: for each length, runs of ranks that go one by one to
    consecutive bins at one offset."""
    rows, first_bin = [], 0
    for size, inside, bins in plan.groups:
        for length, offset in inside:
            rows.append((length, bins, first_bin, offset, size, inside[-1][0] + inside[-1][1]))
        first_bin += bins
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    table = np.array(rows, "int64").reshape(-1, 6)
    length, bins = table[:, 0], table[:, 1]
    start = np.cumsum(bins) - bins
    new = np.append(True, length[1:] != length[:-1]) if len(length) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(new, start, 0)) if len(length) else start
    return length, start - base, table[:, 2], table[:, 3], table[:, 4], table[:, 5], first_bin


def _spread(spark: SparkSession, plan: Plan) -> DataFrame:
    """The places in the bins, one row each, numbered among those of one length (``_length``,
    ``_nth``) so that the bins of every group fill evenly from the first document to the last."""
    runs, first_bin = [], 0
    for size, inside, bins in plan.groups:
        for length, offset in inside:
            # a run in parts, so that no task makes many more rows than another
            runs += [(length, bins, lo, min(lo + RUN, bins) - 1, first_bin, offset, size, inside[-1][0] + inside[-1][1]) for lo in range(0, bins, RUN)]
        first_bin += bins
    table = spark.createDataFrame(runs, "_length long, _bins long, _lo long, _hi long, _first long, bin_offset long, bin_size int, bin_used long")
    each = table.repartition(partitions(table)).withColumn("_j", F.explode(F.sequence("_lo", "_hi")))
    each = each.select("_length", ((F.col("_j") + 0.5) / F.col("_bins")).alias("_t"), (F.col("_first") + F.col("_j")).alias("bin_id"), "bin_size", "bin_offset", "bin_used")
    return running_totals(each, ["_length"], ["_t", "bin_id", "bin_offset"], "bin_used").drop("before").withColumnRenamed("rank", "_nth")


def packed_lengths(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = cost_of, order: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, tie, ..., length) rows as pieces: all columns but the length, then piece, start,
    n_words, bin_id, bin_size, bin_offset, bin_used. With ``order``, documents that are near each
    other in it come into the same bins, as far as their lengths allow."""
    top = max(sizes)
    by = list(order or ("doc_id", "tie"))
    rows = stored(lengths, "lengths")
    own = [c for c in rows.columns if c != "length"]
    whole_pieces = F.floor(F.col("length") / F.lit(top)).cast("long")
    full_runs = running_totals(rows.where(F.col("length") >= top).select(*own, "length", whole_pieces.alias("n_full")), [], by, "n_full")
    rest = rows.select(*own, (F.col("length") % top).alias("rest"), whole_pieces.alias("piece")).where("rest > 0")
    # a histogram of at most max(sizes) - 1 lengths
    histogram = {r["rest"]: r["n"] for r in rest.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = planned(histogram, sizes, cost)
    length, lo, first_bin, offset, size, used, n_bins = _deal_table(plan)
    first_of = np.searchsorted(length, np.arange(top + 1))
    k = len(own)

    def deal(batches):
        for b in batches:
            rest, rank, piece = (b.column(i) for i in (k, k + 1, k + 2))
            rest, rank = rest.to_numpy(), rank.to_numpy()
            # the runs of a length ascend by rank: one search over (length, rank) pairs
            wide = np.int64(1) << np.int64(62 - int(top).bit_length())
            at = np.searchsorted(length * wide + lo, rest * wide + rank, side="right") - 1
            assert (at >= first_of[rest]).all()
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(k)), piece, pa.array(piece.to_numpy() * top), b.column(k)]
                + [pa.array(x) for x in (first_bin[at] + rank - lo[at], size[at].astype("int32"), offset[at], used[at])],
                names=[*own, "piece", "start", "n_words", "bin_id", "bin_size", "bin_offset", "bin_used"],
            )

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    schema = f"{types}, piece long, start long, n_words long, bin_id long, bin_size int, bin_offset long, bin_used long"
    ranked = running_totals(rest, ["rest"], by, "rest").select(*own, "rest", "rank", "piece")
    if order is None:
        dealt = ranked.mapInArrow(deal, schema)
    else:
        spread = _spread(rows.sparkSession, plan)
        met = ranked.join(spread.hint("merge"), (F.col("rest") == F.col("_length")) & (F.col("rank") == F.col("_nth")))
        dealt = met.select(*own, "piece", (F.col("piece") * top).alias("start"), F.col("rest").alias("n_words"), "bin_id", "bin_size", "bin_offset", "bin_used")
    whole = full_runs.select(*own, "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("piece")).select(
        *own, "piece", (F.col("piece") * top).alias("start"), F.lit(top).cast("long").alias("n_words"),
        (F.col("before") + F.col("piece") + F.lit(n_bins)).alias("bin_id"), F.lit(top).alias("bin_size"), F.lit(0).cast("long").alias("bin_offset"), F.lit(top).cast("long").alias("bin_used"),
    )
    zero = F.lit(0).cast("long")
    none = rows.where("length = 0").select(*own, zero.alias("piece"), zero.alias("start"), zero.alias("n_words"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_size"), F.lit(None).cast("long").alias("bin_offset"), F.lit(None).cast("long").alias("bin_used"))
    return dealt.unionByName(whole).unionByName(none)


def pieces(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Where the words of each document go."""
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tie"), word_count().alias("length"))
    return packed_lengths(lengths, sizes)


def placed_pieces(places: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``pieces`` of the documents in the mixed order that ``places`` (mixing.places) gives, with
    their sources; bins are numbered by the place of the first document in them."""
    lengths = places.select("doc_id", "tie", "source", F.col("n_words").alias("length"), "slot", F.col("rank").alias("place"))
    found = stored(packed_lengths(lengths, sizes, order=("slot", "place")), "pieces")
    bins = found.where("bin_id is not null").groupBy("bin_id").agg(F.min(F.struct("slot", "place")).alias("_f"))
    bins = running_totals(bins.select(F.col("bin_id").alias("_b"), F.col("_f.slot").alias("_slot"), F.col("_f.place").alias("_place"), F.lit(1).cast("long").alias("_one")), [], ["_slot", "_place", "_b"], "_one")
    numbered = found.join(bins.select("_b", F.col("rank").alias("_n")).hint("merge"), F.col("bin_id") == F.col("_b"), "left")
    return numbered.withColumn("bin_id", F.col("_n")).drop("_b", "_n", "slot", "place")


def sequences(docs: DataFrame, sizes: tuple[int, ...] = SIZES, places: DataFrame | None = None) -> DataFrame:
    """The pieces with their texts and sources: doc_id, source, piece, bin_id, bin_size, bin_offset,
    n_words, text. Rows that repeat id and text (and source, with ``places``) are dealt their pieces
    one by one."""
    text = F.coalesce(docs["text"], F.lit(""))
    nth = ["piece", "start", "n_words", "bin_id", "bin_size", "bin_offset"]
    listed = F.sort_array(F.collect_list(F.struct(*nth))).alias("_p")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.hash(docs["text"]).alias("tie"), docs["source"], text.alias("text"))
    if places is None:
        lists = pieces(docs, sizes).groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t")).agg(listed)
        rows = rows.groupBy("doc_id", "tie").agg(F.min("source").alias("source"), F.min("text").alias("text"))
    else:
        lists = placed_pieces(places, sizes).groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), F.col("source").alias("_s")).agg(listed)
        rows = rows.groupBy("doc_id", "tie", "source").agg(F.min("text").alias("text"))
    on = rows["doc_id"].eqNullSafe(lists["_d"]) & (rows["tie"] == lists["_t"])
    if places is not None:
        on = on & rows["source"].eqNullSafe(lists["_s"])
    cut = rows.join(lists.hint("merge"), on).select("doc_id", "source", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("_w"), "_p")
    each = cut.select("doc_id", "source", F.explode(F.transform("_p", lambda p: F.struct(p.alias("p"), F.array_join(F.slice(F.col("_w"), (p["start"] + 1).cast("int"), p["n_words"].cast("int")), " ").alias("text")))).alias("x"))
    return each.select("doc_id", "source", *(F.col("x.p." + c).alias(c) for c in nth if c != "start"), F.col("x.text").alias("text"))
