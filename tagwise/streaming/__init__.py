"""Extension: the batch transforms over streams of token batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import sources
from ..operators import extract


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (scan_id, image_index, text) from JSON token files."""
    tokens = spark.readStream.schema(sources.TOKENS_SCHEMA).json(path)
    return tokens.select("scan_id", "image_index", F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("text"))


def extract_stream(texts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Extracted fields of each micro-batch in a folder of its own, which a repeated batch writes anew, so that no row comes
    twice; restarts go on from the checkpoint."""

    def batch(df: DataFrame, number: int) -> None:
        extract.map_fields(df, ["scan_id", "image_index"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def violations_per_window(violations: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Violation counts per tumbling window and field, with a watermark."""
    return violations.withWatermark("created_at", late).groupBy(F.window("created_at", width), "field_name").count()
