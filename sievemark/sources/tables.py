"""Reading raw and processed tables, and writing them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

REGION_TABLES = {"state": "region_state", "district": "region_district"}
DATASETS = ("facilities_scored", "pin_lookup", "indicators", "region_state", "region_district")
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}$")


class MissingInput(FileNotFoundError):
    """An input that isn't there, and what to do about it."""


def _there(df_of, path: str) -> DataFrame:
    try:
        return df_of()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingInput(f"{path} does not exist: write the tables first or correct the path") from e
        raise


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, every column as text, quoted line ends and ``"`` escapes kept. Without
    ``columns`` their names are the header's; types are never guessed."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(text_schema(columns))
    return _there(lambda: reader.csv(path), path)


def processed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown table {name!r}; known: {DATASETS}")
    return _there(lambda: spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}")


def region_summary(spark: SparkSession, folder: str, level: str) -> DataFrame:
    if level not in REGION_TABLES:
        raise ValueError(f"level must be one of {sorted(REGION_TABLES)}, not {level!r}")
    return processed(spark, folder, REGION_TABLES[level])


def catalog_table(spark: SparkSession, dataset: str, names: dict[str, str]) -> DataFrame:
    """A table of the catalog by its dataset's name; only names on the list, of plain identifiers."""
    if dataset not in names:
        raise ValueError(f"unknown dataset {dataset!r}")
    if not NAME.match(names[dataset]):
        raise ValueError(f"not a table name: {names[dataset]!r}")
    return spark.table(names[dataset])


def source(spark: SparkSession, mode: str, place: str | dict[str, str]):
    """A function from a dataset's name to its table: ``files`` under a folder (local, or any store
    that Spark reads) or ``catalog`` tables."""
    if mode == "files":
        return lambda name: processed(spark, place, name)
    if mode == "catalog":
        return lambda name: catalog_table(spark, name, place)
    raise ValueError(f"unknown source mode {mode!r}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir. A local session
    may lack one; it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer pieces than the cluster has cores (one file of one row group, say) dealt out to
    all of them, for work that costs more than moving the rows once. A scan of more is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: worked out once, however often it is used, and
    kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def register_tables(tables: dict[str, DataFrame], names: dict[str, str]) -> None:
    """Creates or replaces catalog tables."""
    for dataset, df in tables.items():
        if not NAME.match(names[dataset]):
            raise ValueError(f"not a table name: {names[dataset]!r}")
        df.write.mode("overwrite").saveAsTable(names[dataset])


def register_raw(spark: SparkSession, files: dict[str, str], names: dict[str, str]) -> None:
    """Creates or replaces catalog tables straight from raw files, every column as text."""
    register_tables({dataset: raw_csv(spark, path) for dataset, path in files.items()}, names)


def file_hash(spark: SparkSession, path: str, digits: int = 16) -> str:
    """SHA-256 over the sorted hashes of the files at ``path``, wherever Spark can read them."""
    each = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"))
    return each.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256), 1, digits)).first()[0]


def create_if_missing(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    if not NAME.match(name):
        raise ValueError(f"not a table name: {name!r}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return spark.table(name)


def append_rows(df: DataFrame, name: str) -> None:
    df.select(*df.sparkSession.table(name).columns).write.mode("append").insertInto(name)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and torn ones are passed over."""
    return _there(lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), path)


def split_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, torn or malformed lines as ``line``). Files are read by ranges of bytes, so a
    large one is shared by many tasks, and a torn last line costs the line alone; blank lines are passed
    over. Fields may be missing, as in ``json_lines``."""
    kept = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    marked = T.StructType([*kept.fields, T.StructField("_torn", T.StringType())])
    lines = _there(lambda: spark.read.text(path), path).where(F.trim("value") != "")
    read = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return read.where(F.col("r._torn").isNull()).select("r.*").drop("_torn"), read.where(F.col("r._torn").isNotNull()).select(F.col("r._torn").alias("line"))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A review file: all text, blanks as empty texts."""
    return raw_csv(spark, path).fillna("")


def write_labels(df: DataFrame, path: str) -> None:
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_summary(counters: DataFrame, path: str) -> None:
    """The counters of a run as one JSON document."""
    one = counters.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("counters"))
    one.write.mode("overwrite").json(path)


def json_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, for an export that takes flat tables only."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
