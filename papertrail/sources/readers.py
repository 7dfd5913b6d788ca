"""Readers: tables, uploaded files, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail import fixed_values as V


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def _file_row(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        F.col("length").alias("file_size"), F.col("modificationTime").alias("uploaded_at"), "content")


def _within(files: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of all files, with the content of those within ``max_bytes`` only."""
    small = _file_row(files.filter(F.col("length") <= max_bytes))
    # Without its content column the scan does not open the files.
    large = _file_row(files.filter(F.col("length") > max_bytes)
                      .withColumn("content", F.lit(None).cast("binary")))
    return small.unionByName(large)


def read_files(spark: SparkSession, folder: str, glob: str = "*",
               max_bytes: int = V.MAX_UPLOAD_BYTES) -> DataFrame:
    """Uploaded files as rows (file_path, original_filename, file_size, uploaded_at, content).

    Content is read for files within ``max_bytes`` only; larger ones keep their row, so that
    admission can reject them by size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "true").load(folder)
    return _within(files, max_bytes)


def stream_files(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000,
                 max_bytes: int = V.MAX_UPLOAD_BYTES) -> DataFrame:
    """The same rows from files as they arrive; the content of files beyond ``max_bytes`` is not read either."""
    return _within(spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("pathGlobFilter", glob)
                   .option("maxFilesPerTrigger", files_per_batch).load(folder), max_bytes)


def stream_table(spark: SparkSession, folder: str, schema, glob: str = "*.parquet",
                 files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob) \
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def lookup(table: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """Rows whose key is in ``ids``: a pushed-down filter for a list, a semi join for a table."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(key), key, "left_semi")
    return table.filter(F.col(key).isin(list(ids)))


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less event times as instants, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))

