"""Stored tables with their provenance: schema version, source fingerprint, resume by what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Modification times this close (ms) are the same.
MTIME_SLACK_MS = 1500


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (filename, size, mtime_ms, fingerprint) of the PDF files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return rows.withColumn("fingerprint", fingerprint(F.col("size"), F.col("mtime_ms")))


def fingerprint(size, mtime_ms):
    return F.concat(F.lit("size="), size, F.lit(";mtimeMs="), mtime_ms)


def write(df: DataFrame, path: str, source: str, version: int = SCHEMA_VERSION) -> None:
    """Writes a table, by filename, with its version and source; the committer makes it all or nothing."""
    stamped = df.withColumn("schema_version", F.lit(version)).withColumn("source_fingerprint", F.lit(source))
    stamped.write.mode("overwrite").partitionBy("filename").parquet(path)


def read(spark: SparkSession, path: str, source: str | None = None, version: int = SCHEMA_VERSION) -> DataFrame:
    """Rows written with this version and, if given, from this source; others are stale and left out."""
    df = spark.read.parquet(path).where(F.col("schema_version") == version)
    return (df if source is None else df.where(F.col("source_fingerprint") == source)).drop("schema_version", "source_fingerprint")


def same_source(a_size, a_mtime, b_size, b_mtime):
    return (a_size == b_size) & (F.abs(a_mtime - b_mtime) < MTIME_SLACK_MS)


def missing_pages(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The pages of wanted that done has not: where an interrupted build goes on."""
    return wanted.join(done.select("filename", "page").distinct(), ["filename", "page"], "left_anti")


def read_through(spark: SparkSession, path: str, build, source: str) -> DataFrame:
    """The stored table, built by build() first where there is none of this source."""
    try:
        found = read(spark, path, source)
        if not found.isEmpty():
            return found
    except Exception as e:  # noqa: BLE001  Spark's classic and Connect clients raise different classes
        if "PATH_NOT_FOUND" not in str(e):
            raise
    write(build(), path, source)
    return read(spark, path, source)
