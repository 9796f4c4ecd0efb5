"""Append-only ledgers: reviewer notes and planning snapshots, validated as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.functions.text import stripped

SCOPES = ("facility", "district", "state")


def checked_notes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes to append, with id and time; rejected ones, with the reason)."""
    reason = F.when(~F.coalesce(F.col("scope_type").isin(*SCOPES), F.lit(False)), "unknown scope type").when(stripped(F.coalesce("note", F.lit(""))) == "", "blank note")
    marked = notes.withColumn("reason", reason)
    good = marked.where("reason is null").select(
        F.uuid().alias("id"), F.date_trunc("second", F.current_timestamp()).alias("created_at"), "scope_type", "scope_id", stripped(F.col("note")).alias("note"), F.coalesce("author", F.lit("")).alias("author")
    )
    return good, marked.where("reason is not null")


def scoped_notes(notes: DataFrame, scope_type: str | None = None, scope_id: str | None = None) -> DataFrame:
    out = notes
    if scope_type is not None:
        out = out.where(F.col("scope_type") == scope_type)
    if scope_id is not None:
        out = out.where(F.col("scope_id") == scope_id)
    return newest_first(out)


def newest_first(df: DataFrame, at: str = "created_at", id_column: str = "id") -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(id_column))


def checked_snapshots(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots to append as ``save`` events, rejected ones)."""
    reason = F.when(stripped(F.coalesce("name", F.lit(""))) == "", "blank name")
    marked = snapshots.withColumn("reason", reason)
    good = marked.where("reason is null").drop("reason").withColumns(
        {"id": F.uuid(), "created_at": F.date_trunc("second", F.current_timestamp()), "name": stripped(F.col("name")), "event": F.lit("save")}
    )
    return good, marked.where("reason is not null")


def tombstones(ids: DataFrame) -> DataFrame:
    """Deletion events for the given ids."""
    return ids.select("id", F.current_timestamp().alias("created_at"), F.lit("delete").alias("event"))


def deletions(ids: DataFrame, log: DataFrame) -> DataFrame:
    """The given ids with ``existed``: whether there is such a snapshot to delete."""
    now = current_snapshots(log).select("id", F.lit(True).alias("_there"))
    return ids.join(now, "id", "left").select("id", F.coalesce("_there", F.lit(False)).alias("existed"))


def latest(log: DataFrame, keys: list[str], order: list[Column], deleted: Column) -> DataFrame:
    """The last event of each key, unless it is a deletion."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & ~deleted).drop("_r")


def current_snapshots(log: DataFrame) -> DataFrame:
    return newest_first(latest(log, ["id"], [F.desc("created_at"), F.asc("event")], F.col("event") == "delete"))


def drifted(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Saved snapshots with ``stale``: the data (``data_snapshot_id``) is not what it was."""
    now = current.select(F.col("data_snapshot_id").alias("_now")).limit(1)
    return saved.join(F.broadcast(now), F.lit(True)).withColumn("stale", F.col("data_snapshot_id") != F.col("_now")).drop("_now")  # one row


def fingerprint(df: DataFrame, column: str) -> DataFrame:
    """One row: the number of rows and twelve hex digits of the SHA-256 of the sorted counts of a column."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws("=", x["k"], x["n"].cast("string")))
    named = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.array_join(parts, ";").alias("_t"))
    return named.select("n_rows", F.substring(F.sha2("_t", 256), 1, 12).alias("digest"), F.concat_ws("-", F.col("n_rows").cast("string"), F.substring(F.sha2("_t", 256), 1, 12)).alias("data_snapshot_id"))


def range_fingerprints(df: DataFrame, columns: list[str], range_of: Column) -> DataFrame:
    """One row for each range of keys: its number of rows, and two sums over its rows of numbers cut from
    a hash of the whole row. Neither order nor partitions matter, equal rows count each, and the sums of
    parts of a table add up (see ``merged_fingerprints``). Null and empty text differ."""
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    digest = F.md5(F.concat_ws("\x1f", *(cell(c) for c in columns)))
    # sixty bits each: a sum passes 64 bits, so it is kept as a decimal
    number = lambda at: F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(38,0)")
    rows = df.select(range_of.alias("key_range"), digest.alias("_d"))
    return rows.groupBy("key_range").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(number(1)).alias("sum_a"), F.sum(number(16)).alias("sum_b"))


def merged_fingerprints(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key_range").agg(*(F.sum(c).alias(c) for c in ("n_rows", "sum_a", "sum_b")))


def drifted_ranges(saved: DataFrame, current: DataFrame) -> DataFrame:
    """key_range, n_saved, n_now, drift: ``same``, ``changed``, ``added`` or ``removed`` between two tables
    of range fingerprints."""
    a = saved.select(F.col("key_range").alias("_k"), F.col("n_rows").alias("n_saved"), F.struct("n_rows", "sum_a", "sum_b").alias("_saved"))
    b = current.select("key_range", F.col("n_rows").alias("n_now"), F.struct("n_rows", "sum_a", "sum_b").alias("_now"))
    both = a.hint("merge").join(b, F.col("_k").eqNullSafe(F.col("key_range")), "full_outer")
    drift = F.when(F.col("_saved").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_saved") == F.col("_now"), "same").otherwise("changed")
    return both.select(F.coalesce("key_range", "_k").alias("key_range"), F.coalesce("n_saved", F.lit(0)).alias("n_saved"), F.coalesce("n_now", F.lit(0)).alias("n_now"), drift.alias("drift"))


def row_hash(columns: list[str], digits: int = 16) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, digits)
