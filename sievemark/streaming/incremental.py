"""New record files scored as they come, each record once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def _known(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: Ranges of ids that one batch names one by one; a batch that touches more reads the whole target.
MOST_SLOTS = 10_000
#: Folders, about, that one batch is laid out in; a batch that touches more ranges is laid out in wider
#: ones, each as wide as 16 of the step before, so that its folders and files don't grow with it.
MOST_FOLDERS = 256
STEP, STEPS = 4, 16
#: Rows that one task writes to a folder, about.
FILE_ROWS = 1_000_000


def id_range(id_column: str, ids: int = 1_000_000) -> Column:
    """The range that a whole-number id lies in; each holds at most so many."""
    return F.floor(F.col(id_column) / ids).cast("long")


def _wider(slot: Column, width: int) -> Column:
    return F.shiftright(slot.cast("long"), STEP * width)


def _folder(slot: Column, width: int) -> Column:
    """The name of a range: its number, and behind ``w`` how many steps wider it is."""
    return F.concat(_wider(slot, width).cast("string"), F.lit(f"w{width}")) if width else slot.cast("string")


def _width(batch: DataFrame, slot: Column) -> tuple[int, int]:
    """(steps, tasks for each folder): how wide the ranges must be for a batch to be laid out in few folders.
    The counts are estimates that depend on the batch alone, so a batch that is tried again is laid out the same."""
    counts = batch.agg(F.count(F.lit(1)).alias("rows"), *(F.approx_count_distinct(_wider(slot, w)).alias(f"n{w}") for w in range(STEPS))).first()
    width = next((w for w in range(STEPS) if counts[f"n{w}"] <= MOST_FOLDERS), STEPS - 1)
    return width, 1 + counts["rows"] // (FILE_ROWS * max(1, counts[f"n{width}"]))


def _place(target: str, names: list[str | None], batch: str) -> str:
    return f"{target}/slot={{{','.join('__HIVE_DEFAULT_PARTITION__' if x is None else x for x in names)}}}/batch={batch}"


def _earlier(spark: SparkSession, target: str, ids: StructType, wanted: DataFrame, number: int) -> DataFrame:
    """Ids that earlier batches have written to the ranges of ``wanted`` (a column ``slot``), or to wider
    ones around them. Only the folders of these ranges are read, however long the history is."""
    slots = [r["slot"] for r in wanted.select("slot").distinct().limit(MOST_SLOTS + 1).collect()]
    if not slots:
        return spark.createDataFrame([], ids)
    names = [None if x is None else str(x) for x in slots]
    wide = {f"{int(x) >> STEP * w}w{w}" for w in range(1, STEPS) for x in slots if x is not None}
    place = _place(target, names + sorted(wide), "*") if len(slots) <= MOST_SLOTS else f"{target}/slot=*/batch=*"
    try:
        return spark.read.option("basePath", target).schema(ids.add("batch", "long")).parquet(place).where(F.col("batch") != number)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ids)


def scored_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    valid: Callable[[DataFrame], DataFrame],
    target: str,
    quarantine: str,
    checkpoint: str,
    id_column: str,
    slot: Column | None = None,
    sums: Callable[[DataFrame], DataFrame] | None = None,
    partials: str | None = None,
) -> StreamingQuery:
    """Starts the job over what is there and stops when it is done.

    ``valid`` adds a boolean column ``valid`` (and may add ``reason``). Each batch is one folder of
    the target, named by its number, and is written over if it is tried again, so a batch that
    failed half-way adds nothing twice. Ids that the target holds from other batches are left out
    by an anti join, not by state that grows with the stream.

    With ``slot`` (a number worked out from the id, see ``id_range``) the target is laid out by ranges
    of ids, then batches, and a batch reads the ids of the ranges that it touches itself. A batch that
    touches many ranges is laid out in wider ones. With ``sums``
    the new rows' mergeable sums go to ``partials``, a folder for each batch; whoever reads them adds
    them up, so that totals of all batches cost no pass over the rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = valid(batch)
        bad = marked.where(~F.coalesce("valid", F.lit(False)))
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        good = score(marked.where("valid").select(*batch.columns).dropDuplicates([id_column]))
        ids = StructType([f for f in good.schema if f.name == id_column])
        if slot is None:
            done = _known(spark, target, StructType(ids.fields).add("batch", "long")).where(F.col("batch") != number)
        else:
            done = _earlier(spark, target, ids, batch.select(slot.alias("slot")), number)
        new = good.join(done.select(id_column), id_column, "left_anti")
        if slot is None:
            new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        else:
            width, parts = _width(batch, slot)
            own_slots = batch.select(_folder(slot, width).alias("slot")).distinct()
            # a folder is written by one task, or by a few if it gets many rows
            own = {"slot": _folder(slot, width), "batch": F.lit(number).cast("long"), "_part": F.pmod(F.xxhash64(id_column), F.lit(parts))}
            laid = new.withColumns(own).repartition("slot", "_part").drop("_part")
            # folders of this batch's number alone are written over
            laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(target)
        if sums is not None:
            own = spark.read.schema(new.schema).parquet(f"{target}/batch={number}") if slot is None else _written(spark, target, new.schema, [r["slot"] for r in own_slots.collect()], number)
            sums(own).write.mode("overwrite").parquet(f"{partials}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark: SparkSession, target: str, schema: StructType, names: list[str | None], number: int) -> DataFrame:
    """The rows of one batch, from the ranges that it was laid out in."""
    if not names:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.option("basePath", target).schema(schema).parquet(_place(target, names, str(number)))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def file_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(kind).load(folder)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Counts of a stream by window of event time, closed once events are later than ``lateness``."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
