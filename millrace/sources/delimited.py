"""Tables as delimited text: one row a line, ``|`` between fields, empty fields null.

Readers take files, folders or numbered chunks at any path Spark can open
(local, HDFS, object stores) and fail on missing files rather than read less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from millrace.operators.relational import contiguous_slices

SEPARATOR = "|"
ROWS_PER_BLOCK = 625_000  # fixed value: rows of a text block


def _options(reader, schema: str | StructType):
    return reader.schema(schema).option("sep", SEPARATOR).option("mode", "PERMISSIVE").option("dateFormat", "yyyy-M-d")


def read_table(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Rows of one or several files; a delimiter at a line's end is ignored, missing last fields are null."""
    return _options(spark.read, schema).csv(path)


def chunk_paths(prefix: str, start: int, n: int) -> list[str]:
    return [f"{prefix}_{i}.dat" for i in range(start, start + n)]


def read_chunks(spark: SparkSession, prefix: str, start: int, n: int, schema: str | StructType) -> DataFrame:
    """The chunks ``prefix_start.dat`` and following, as one table."""
    return read_table(spark, chunk_paths(prefix, start, n), schema)


def stream_table(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 100) -> DataFrame:
    reader: DataStreamReader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return _options(reader, schema).csv(path)


def write_table(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_BLOCK) -> None:
    """One folder of text files with at most ``rows_per_file`` rows each, written in parallel."""
    df.write.option("sep", SEPARATOR).option("maxRecordsPerFile", rows_per_file).option("emptyValue", "").csv(path)


def write_single(df: DataFrame, path: str) -> None:
    """One file, for small results."""
    df.coalesce(1).write.option("sep", SEPARATOR).option("emptyValue", "").csv(path)


def write_slices(df: DataFrame, order: list[str], n: int, path: str) -> None:
    """n slices of equal row count in the given order, the last with the remainder, as ``slice=i`` folders."""
    sliced = contiguous_slices(df, order, n)
    sliced.repartition(n, "slice").sortWithinPartitions("slice", *order).write.partitionBy("slice").option("sep", SEPARATOR).option("emptyValue", "").csv(path)


def read_slices(spark: SparkSession, path: str, slices: list[int], schema: str | StructType) -> DataFrame:
    """Only the named slices: the folders of others are not opened."""
    return _options(spark.read, schema).csv([f"{path}/slice={i}" for i in slices])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``key value`` lines of a results log as (path, record, key, value); a record ends where a key comes again."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    parts = F.split(F.trim("line"), r"[:\s]+")
    keyed = lines.where(F.trim("line") != "").select("path", "pos", parts[0].alias("key"), F.try_to_number(parts[1], F.lit("999999999999.999999")).cast("double").alias("value"))
    from pyspark.sql.window import Window

    return keyed.withColumn("record", F.row_number().over(Window.partitionBy("path", "key").orderBy("pos")) - 1).select("path", "record", "key", "value")
