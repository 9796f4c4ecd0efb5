"""Exact top-k search by inner product: tiled matrix products.

Vectors are packed into tiles of a bounded number of bytes. Each query tile meets each candidate
tile once, in one matrix product; of every product only the k best of each query leave the task;
the short lists are merged in a tree of bounded fan-in. Nothing is broadcast and no task holds
more than two tiles, whatever the number of vectors.

Defined results: vectors that are null or hold a null or non-finite component take no part; an
empty vector scores 0 against other empty ones; vectors of different lengths never meet. Ties go
to the smaller id. Rows that share an id are candidates each for itself; a query never meets rows
of its own id, and repeated query rows of one id are asked each for itself, then merged. Empty
tables give an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.llm.shared import stored

TILE_BYTES = 1 << 20
TILE_SCHEMA = "dim int, tile long, n int, ids binary, data binary"
FAN_IN = 16


def packed(rows: DataFrame, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(id, vector) rows as tiles of vectors of one length, made where the rows lie."""

    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}

        def tile(dim, parts):
            nonlocal made
            made += 1
            ids, data = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "tile": pa.array([(part << 32) + made], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([data[order].tobytes()], pa.binary())}
            )

        for b in batches:
            ids, vec = b.column(0).to_numpy(zero_copy_only=False).astype("int64"), b.column(1)
            length = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype("float64")
            begin = np.cumsum(length) - length
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                most = max(1, tile_bytes // (8 * max(1, int(dim))))
                for k in range(0, len(at), most):
                    some = at[k : k + most]
                    held = waiting.setdefault(int(dim), [])
                    held.append((ids[some], flat[begin[some][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held) >= most:
                        yield tile(int(dim), waiting.pop(int(dim)))
        for dim, held in waiting.items():
            yield tile(dim, held)

    return rows.mapInArrow(run, TILE_SCHEMA)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query row, candidate column) of the k best of each row; ids ascend along the columns."""
    n = scores.shape[1]
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    k = min(k, n)
    finite = scores[np.isfinite(scores)]
    bound = np.abs(finite).max() if finite.size else 0
    if bound < 2**62 / (n + 1) and bound < 2**53:
        # score and place in one whole number: the order has no ties
        key = np.where(np.isfinite(scores), scores, -(bound + 1.0)).astype("int64") * n + (n - 1 - np.arange(n))
        col = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        col = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), col.shape[1])
    col = col.ravel()
    ok = np.isfinite(scores[row, col])
    return row[ok], col[ok]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", integer: Column | None = None) -> DataFrame:
    """For each row of ``queries``, its k best rows of ``vectors``: query_id, rank, vec_id, score.

    Components should be whole numbers of moderate size (below 2**53 in the products) for exact scores.
    """

    def tiles(df: DataFrame, name: str) -> DataFrame:
        good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & good)
        return stored(packed(rows), name)

    cand, ask = tiles(vectors, "tiles"), tiles(queries, "asks")
    n_cand, n_ask = cand.count(), ask.count()
    groups = max(1, -(-n_cand // 4))
    q = ask.select("dim", F.col("tile").alias("q"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # each candidate tile is sent once, to a group that every query tile visits
    c = cand.select("dim", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("g"), F.col("tile"), "ids", "data")
    pairs = q.join(c.hint("merge"), ["dim", "g"]).select("dim", "tile", "q_ids", "q_data", "ids", "data")

    def product(batches):
        for b in batches:
            for i in range(b.num_rows):
                dim, tile, q_ids, q_data, ids, data = (b.column(j)[i] for j in range(6))
                d = dim.as_py()
                qi, ci = np.frombuffer(q_ids.as_buffer(), "int64"), np.frombuffer(ids.as_buffer(), "int64")
                qm, cm = np.frombuffer(q_data.as_buffer(), "float64").reshape(len(qi), d), np.frombuffer(data.as_buffer(), "float64").reshape(len(ci), d)
                step = max(1, (4 << 20) // max(1, 8 * len(ci)))
                for lo in range(0, len(qi), step):
                    s = qm[lo : lo + step] @ cm.T
                    row, col = _best(s, ci, qi[lo : lo + step], k)
                    yield pa.RecordBatch.from_pydict(
                        {"query_id": pa.array(qi[lo + row]), "vec_id": pa.array(ci[col]), "score": pa.array(s[row, col].astype("int64")), "grp": pa.array(np.full(len(row), tile.as_py(), "int64"))}
                    )

    lists = pairs.mapInArrow(product, "query_id long, vec_id long, score long, grp long")
    merged = lists.withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(max(1, n_cand))).cast("long"))
    width = n_cand

    def level(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    while width > FAN_IN:
        width = -(-width // FAN_IN)
        merged = level(merged.withColumn("grp", F.pmod("grp", F.lit(width))), "grp").drop("rank")
    return level(merged).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
