"""Results that arrive while a run goes on: a stream of result files joined to what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.sources.wire import RESULT


def stream_results(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Result lines as they are written to a folder, with their time of arrival."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parsed = lines.select(F.current_timestamp().alias("arrived_at"), F.from_json("value", RESULT).alias("_r"))
    return parsed.select("arrived_at", "_r.*").where("custom_id IS NOT NULL")


def first_results(results: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first result of each request; the state of those older than the delay is dropped."""
    return results.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["custom_id"])


def usage_by_window(results: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Answers and tokens per window and model; late results within the delay still count."""
    usage = F.col("response.body.usage")
    windows = results.withWatermark("arrived_at", delay).groupBy(F.window("arrived_at", width), F.col("response.body.model").alias("model"))
    return windows.agg(F.count("*").alias("results"), F.sum(usage["prompt_tokens"]).alias("prompt_tokens"), F.sum(usage["completion_tokens"]).alias("completion_tokens"))


def resume(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Take what has arrived since the last call, append the first result of each request to ``out``, and return."""
    stream = first_results(stream_results(spark, folder))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
