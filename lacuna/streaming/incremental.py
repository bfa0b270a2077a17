"""Incremental runs over growing folders, with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_folder(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """A stream of the files in a folder that match a pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what has arrived since the last run, in batches, and stops. A batch that failed is run again with the same
    number, so `each` should write by that number."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number, so a batch that is run again replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def counts_per_window(stream: DataFrame, at: str, by: str, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Events of each kind in each window; rows later than `late` are left out."""
    d = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return d.groupBy(F.window("_at", size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
