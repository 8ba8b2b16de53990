"""JSON-lines tables: questions, hard negatives, predictions, reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path, schema: T.StructType, strict: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of JSON-lines files (gzip included).  Tolerant reading skips
    malformed lines, strict reading fails on them."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(schema).option("mode", mode).json(path)
    return rows if limit is None else rows.limit(limit)


def read_with_position(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Rows with the file and the byte block they came from, and their order in
    it, for "the last line wins" rules."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"),
    )
    parsed = lines.select(F.from_json("value", schema).alias("_r"), F.struct("_file", "_block", "_n").alias("position"))
    return parsed.where("_r is not null").select("_r.*", "position")


def write(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """One folder per value combination of ``by``."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_report(entries: DataFrame, path: str) -> None:
    """A small table of JSON texts as one file."""
    entries.coalesce(1).write.mode("overwrite").text(path)
