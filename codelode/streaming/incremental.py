"""Incremental refresh as a stream: listings of files arrive, the state of the index follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, mtime timestamp_ntz, length bigint, seen_at timestamp_ntz"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files in a folder, or of the one file of that path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    src = spark.readStream.schema(FILES)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return src.parquet(path)
    return src.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def changed_stream(spark: SparkSession, folder: str, delay: str = "30 days") -> DataFrame:
    """A stream of the first sighting of every (path, modification), late ones up to ``delay`` included."""
    seen = listing(spark, folder).withColumn("seen", F.col("seen_at").cast("timestamp")).withWatermark("seen", delay)
    return seen.dropDuplicatesWithinWatermark(["path", "mtime"]).select("path", "mtime", "length", "seen")


def counts_per_day(spark: SparkSession, folder: str, delay: str = "30 days") -> DataFrame:
    """A stream of sightings per day, final once the watermark has passed the day."""
    seen = listing(spark, folder).withColumn("seen", F.col("seen_at").cast("timestamp")).withWatermark("seen", delay)
    return seen.groupBy(F.window("seen", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def run_complete(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Writes an aggregated stream over all that is there to ``out``, the open windows included."""
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(stream: DataFrame, handle, checkpoint: str) -> None:
    """Feeds everything that is there to ``handle(batch, number)`` and ends; the next call goes on from there."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
