"""Documents and events as they arrive, by the same operators as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import lines as L
from quireflow.sources import lift
from quireflow.sources.shared import shared_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own that driver and executors share; only a session within one process may leave it unnamed."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = lift.read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def run_to_end(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """What a stream has written once all that is there has gone through."""
    out, log = shared_folder(spark, "stream"), shared_folder(spark, "progress")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def line_types(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, line_type of the lines of arriving documents; each row stands for itself, so no state is kept."""
    return L.with_features(lift.document_lines(documents)).select("doc_id", "line_no", "line_type")


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events by window and type; a window closes once the watermark has passed it."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
