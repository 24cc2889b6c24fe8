"""Pages as they arrive: ingest with a checkpoint, and what must be built anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "filename STRING, page INT, text STRING, arrived TIMESTAMP"


def arriving(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of page rows from Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each page once: what is there already is left out, a restart goes on from its checkpoint.

    Runs until the files that lie there are read.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(path).select("filename", "page")
        except Exception as e:  # noqa: BLE001  classic and Connect clients raise different classes
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        new = batch.dropDuplicates(["filename", "page"])
        if done is not None:
            new = new.join(done, ["filename", "page"], "left_anti")
        new.write.mode("append").partitionBy("filename").parquet(path)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(pages: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages and characters by file and time of arrival; state older than `late` is dropped."""
    at = F.window("arrived", window)
    return pages.withWatermark("arrived", late).groupBy(at, "filename").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))
