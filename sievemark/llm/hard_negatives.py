"""Hard-negative mining: rows of another label whose inner product with an anchor lies in a window
below that of a positive, found through STR-packed R-trees.

Vectors are dealt out by label and by their most varied coordinate and packed, where they then lie, by
sort-tile-recursive into trees of a bounded number of bytes: leaves with the vectors, and above them
nodes with the minimum bounding box of what they hold. A box gives, coordinate by coordinate, the
interval of any inner product with a vector inside. A search goes through a tree best first: a queue
hands out the node with the highest product possible, boxes outside the score window or with no row of
a label asked for are left, and so are those strictly below the k-th row found (equal ones may hold a
smaller id). Every block of anchors meets every tree of its length once; k rows of each search leave a
task, and these short lists are merged in a tree. Nothing is broadcast, and no task holds more than a
tree and a block of anchors, whatever the number of rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no
part; vectors of different lengths never meet, and empty ones score 0. Ties go to the smaller id, and
then to the smaller label. An anchor never meets rows of its own id; rows that share an id are rows
each for itself, as anchors too. Products are exact: in floating point below 2**53, in whole numbers
of any size beyond; a result that is no 64-bit number is an error. An empty table gives an empty
result. Components are whole numbers, as they come from rounding. Only the id, the label and the
vector are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.llm.shared import partitions, sized, stored

TREE_BYTES, BLOCK_BYTES = 1 << 21, 1 << 17
LEAF, FAN_OUT, FAN_IN = 128, 8, 16
TREE_SCHEMA = "dim int, tree long, ids binary, labels binary, data binary, nodes binary, low binary, high binary"
BLOCK_SCHEMA = "dim int, block long, n int, data binary"
#: The fields of a node: first and end of its rows, of its children (none for a leaf), and its labels' bounds.
NODE = ("row", "row_end", "child", "child_end", "label", "label_end")


def usable(rows: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label and v of the rows that take part, their components as doubles."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


def matrices(column: pa.Array):
    """(length, rows, matrix) for each length of the vectors of a batch."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    begin = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield dim, at, flat[begin[at][:, None] + np.arange(dim)]


def _tiled(data: np.ndarray, rows: np.ndarray, axes: list[int], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive: the rows sorted by the first axis and cut into slabs, these by the next."""
    if len(rows) <= leaf:
        return [rows]
    rows = rows[np.argsort(data[rows, axes[0]], kind="stable")] if axes else rows
    slabs = -(-len(rows) // leaf) if len(axes) <= 1 else max(2, round((len(rows) / leaf) ** (1 / len(axes))))
    cut = np.linspace(0, len(rows), min(slabs, len(rows)) + 1).astype("int64")
    out = []
    for lo, hi in zip(cut[:-1], cut[1:]):
        out += _tiled(data, rows[lo:hi], axes[1:], leaf)
    return out


def tree_of(ids: np.ndarray, labels: np.ndarray, data: np.ndarray, leaf: int = LEAF, fan_out: int = FAN_OUT):
    """ids, labels and vectors in the order of the leaves; nodes, leaves first and the root last;
    and the lower and upper corners of the nodes' boxes."""
    spread = np.argsort(-data.var(axis=0), kind="stable")[:3].tolist() if data.shape[1] else []
    groups: list[np.ndarray] = []
    for value in np.unique(labels):
        groups += _tiled(data, np.flatnonzero(labels == value), spread, leaf)
    order = np.concatenate(groups)
    ids, labels, data = ids[order], labels[order], data[order]
    end = np.cumsum([len(g) for g in groups])
    nodes = [(e - len(g), e, 0, 0, labels[e - len(g)], labels[e - 1]) for g, e in zip(groups, end)]
    low, high = [data[a:b].min(axis=0) for a, b, *_ in nodes], [data[a:b].max(axis=0) for a, b, *_ in nodes]
    lo, hi = 0, len(nodes)
    while hi - lo > 1:
        for a in range(lo, hi, fan_out):
            b = min(a + fan_out, hi)
            nodes.append((nodes[a][0], nodes[b - 1][1], a, b, nodes[a][4], nodes[b - 1][5]))
            low.append(np.min(low[a:b], axis=0))
            high.append(np.max(high[a:b], axis=0))
        lo, hi = hi, len(nodes)
    return ids, labels, data, np.array(nodes, "int64"), np.array(low).reshape(len(nodes), -1), np.array(high).reshape(len(nodes), -1)


def packed_trees(rows: DataFrame, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """The usable rows as R-trees of bounded size, one row each."""
    # slabs of the first two keys: label, and the coordinate that varies most (of each length)
    sums = rows.select(F.size("v").alias("dim"), F.posexplode("v")).groupBy("dim", "pos").agg(F.var_pop("col").alias("spread"))
    axes = sums.groupBy("dim").agg(F.max_by("pos", F.struct("spread", -F.col("pos"))).alias("axis")).withColumnRenamed("dim", "_dim")
    slabs = (
        rows.withColumn("dim", F.size("v"))
        .join(sized(stored(axes, "axes")), F.col("dim") == F.col("_dim"), "left")
        .select("id", "label", "v", "dim", F.try_element_at("v", F.col("axis") + 1).alias("slab"))
    )
    order = ["dim", "label", "slab", "id"]
    slabs = slabs.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select("id", "label", "v")

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}

        def tree(dim: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            held = waiting.pop(dim)
            ids, labels, data, nodes, low, high = tree_of(*(np.concatenate([x[k] for x in held]) for k in range(3)))
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "tree": pa.array([(part << 32) + made], pa.int64())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in {"ids": ids, "labels": labels, "data": data, "nodes": nodes, "low": low, "high": high}.items()}
            )

        for b in batches:
            ids, labels = b.column(0).to_numpy().astype("int64"), b.column(1).to_numpy().astype("int64")
            for dim, at, data in matrices(b.column(2)):
                most = max(LEAF, tree_bytes // (8 * max(1, dim)))
                for lo in range(0, len(at), most):
                    some = at[lo : lo + most]
                    waiting.setdefault(dim, []).append((ids[some], labels[some], data[lo : lo + most]))
                    if sum(len(x[0]) for x in waiting[dim]) >= most:
                        yield tree(dim)
        for dim in list(waiting):
            yield tree(dim)

    return slabs.mapInArrow(run, TREE_SCHEMA)


ASK = "key long, id long, label long, v array<double>, asks array<struct<ask: long, low: long, high: long>>"


def blocks(asks: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Anchors with their searches, in blocks of bounded size: pickled Arrow batches of ASK rows."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            size = b.column(3).value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                most = max(1, block_bytes // (8 * max(1, dim)))
                for lo in range(0, len(at), most):
                    made += 1
                    some = b.take(pa.array(at[lo : lo + most]))
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, some.schema) as w:
                        w.write_batch(some)
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "block": pa.array([(part << 32) + made], pa.int64()), "n": pa.array([len(some)], pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return asks.mapInArrow(run, BLOCK_SCHEMA)


class Tree:
    """A packed tree as the searches of one block of anchors see it."""

    def __init__(self, dim: int, ids, labels, data, nodes, low, high):
        self.ids, self.labels = np.frombuffer(ids, "int64"), np.frombuffer(labels, "int64")
        self.data = np.frombuffer(data, "float64").reshape(len(self.ids), dim)
        self.nodes = np.frombuffer(nodes, "int64").reshape(-1, len(NODE))
        self.low, self.high = (np.frombuffer(x, "float64").reshape(len(self.nodes), dim) for x in (low, high))

    def meet(self, anchors: np.ndarray) -> None:
        """The interval of the products of each anchor with each box. Beyond 2**53 everything is
        worked out in whole numbers."""
        most = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))
        exact = most * np.abs(anchors).max(initial=0) * max(1, anchors.shape[1]) < 2.0**53

        def whole(x: np.ndarray) -> np.ndarray:
            return x if exact else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)

        self.anchors, self.data, low, high = whole(anchors), whole(self.data), whole(self.low), whole(self.high)
        up, down = np.maximum(self.anchors, 0), np.minimum(self.anchors, 0)
        self.least, self.most = (up @ low.T + down @ high.T), (up @ high.T + down @ low.T)
        self._scores: dict[int, np.ndarray] = {}

    def scores(self, leaf: int) -> np.ndarray:
        if leaf not in self._scores:
            a, b = self.nodes[leaf, 0], self.nodes[leaf, 1]
            self._scores[leaf] = self.anchors @ self.data[a:b].T
        return self._scores[leaf]

    def best(self, row: int, own: int, label: int, same: bool, k: int, low: int | None, high: int | None) -> list[tuple]:
        """(-score, id, label) of the k best rows, from low to high, of the anchor's label or of another."""
        least, most = self.least[row], self.most[row]
        found: list[tuple] = []
        queue = [(-most[len(self.nodes) - 1], len(self.nodes) - 1)]
        while queue:
            bound, n = heapq.heappop(queue)
            if len(found) == k and -bound < -found[-1][0]:
                break  # strictly below the k-th, and so is all that is still queued
            a, b, child, child_end, first_label, last_label = self.nodes[n].tolist()
            if (low is not None and -bound < low) or (high is not None and least[n] > high):
                continue
            if not (first_label <= label <= last_label) if same else first_label == label == last_label:
                continue
            if child_end > child:
                for c in range(child, child_end):
                    heapq.heappush(queue, (-most[c], c))
                continue
            s = self.scores(n)[row]
            ok = (self.labels[a:b] == label) == same
            ok &= self.ids[a:b] != own
            if low is not None:
                ok &= (s >= low).astype(bool)
            if high is not None:
                ok &= (s <= high).astype(bool)
            if len(found) == k:
                ok &= (s >= -found[-1][0]).astype(bool)
            at = np.flatnonzero(ok)
            if len(at):
                found = heapq.nsmallest(k, found + list(zip((-s[at]).tolist(), self.ids[a:b][at].tolist(), self.labels[a:b][at].tolist())))
        return found


def searched(trees: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows of each ask, of the anchor's own label (``same``) or of any other: key, ask,
    rank (from 1), id, label, score."""
    n_trees = trees.count()
    groups = max(1, -(-n_trees // 2))
    ask = stored(blocks(asks), "asks")
    b = ask.select("dim", F.col("data").alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # each tree is sent once, to a group that every block of anchors visits
    t = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int"))
    pairs = b.join(t.hint("merge"), ["dim", "g"]).select("dim", "tree", "asks", "ids", "labels", "data", "nodes", "low", "high")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, tree_id = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                given = pa.ipc.open_stream(batch.column(2)[i].as_buffer()).read_all().combine_chunks().to_batches()[0]
                tree = Tree(dim, *(batch.column(j)[i].as_buffer() for j in range(3, 9)))
                tree.meet(given.column(3).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(given.num_rows, dim))
                out = []
                for row, (key, own, label, asked) in enumerate(zip(*(given.column(j).to_pylist() for j in (0, 1, 2, 4)))):
                    for one in asked:
                        for s, vec, other in tree.best(row, own, label, same, k, one["low"], one["high"]):
                            out.append((key, one["ask"], vec, other, -int(s), tree_id))
                columns = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "ask", "id", "label", "score", "grp"])

    lists = pairs.mapInArrow(run, "key long, ask long, id long, label long, score long, grp long")
    width = max(1, n_trees)
    lists = lists.withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(width)))

    def level(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("key", "ask", *by).orderBy(F.desc("score"), "id", "label")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    while width > FAN_IN:
        width = -(-width // FAN_IN)
        lists = level(lists.withColumn("grp", F.pmod("grp", F.lit(width))), "grp").drop("rank")
    return level(lists).select("key", "ask", "rank", "id", "label", "score")


def mined(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each anchor (rows where the column ``is_anchor`` holds) and each of its best positives, the
    best rows of other labels that score from ``least`` to ``most`` hundredths of the positive:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score, negative_label."""
    marked = vectors.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    trees = stored(packed_trees(usable(vectors, id_column, label, vector)), "trees")
    anchors = usable(marked.where("_anchor"), id_column, label, vector).withColumn("key", F.monotonically_increasing_id())
    anchors = stored(anchors, "anchors")
    none = F.lit(None).cast("long")
    all_rows = F.array(F.struct(F.lit(0).cast("long").alias("ask"), none.alias("low"), none.alias("high")))
    near = stored(searched(trees, anchors.select("key", "id", "label", "v", all_rows.alias("asks")), positives, True), "positives")
    window = near.select(
        "key",
        F.struct(
            F.col("rank").cast("long").alias("ask"),
            F.ceil(F.col("score").cast("decimal(20,0)") * least / 100).cast("long").alias("low"),
            F.floor(F.col("score").cast("decimal(20,0)") * most / 100).cast("long").alias("high"),
        ).alias("one"),
    )
    # at most ``positives`` windows an anchor
    windows = window.groupBy("key").agg(F.collect_list("one").alias("asks"))
    asks = anchors.join(windows.hint("merge"), "key").select("key", "id", "label", "v", "asks")
    hard = searched(trees, asks, negatives, False)
    found = hard.select("key", F.col("ask").alias("prank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("label").alias("negative_label"))
    of = near.select("key", F.col("rank").cast("long").alias("prank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        found.join(of.hint("merge"), ["key", "prank"])
        .join(anchors.select("key", F.col("id").alias("anchor_id")).hint("merge"), "key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "negative_label")
    )
