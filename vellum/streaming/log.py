"""The page log as a stream: the latest record of each page, and progress, kept up to date from appended files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log as lg


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    source = spark.readStream.format(fmt).schema(schema)
    return (source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source).load(path)


def latest(log: DataFrame) -> DataFrame:
    """As the batch view: its aggregate has one row of state a page."""
    return lg.latest(log)


def event_rate(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Lifecycle events a window and type, final once the watermark has passed."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_available(df: DataFrame, checkpoint: str, name: str, mode: str = "complete") -> DataFrame:
    """Processes what there is, then stops; the checkpoint makes the next call go on from there. The view is held by the driver, so it must be small; others go to files (upsert_to)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def upsert_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes each batch's changed pages to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
