"""An append-only chain as a stream: resumed, deduplicated and tallied (an extension of A27, C13, D13).

New files of a folder are read once each, as the checkpoint of the query records. Late and repeated
records are dropped within the watermark by key; the tally is a stateful count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "record_id long, chain string, idx int, claim_id string, verdict string, written_at timestamp"


def records(spark: SparkSession, folder: str, delay: str = "7 days") -> DataFrame:
    """Records of the JSON files of a folder as they come, each record_id once within ``delay``."""
    got = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 64).json(folder)
    return got.where("record_id is not null and written_at is not null").withWatermark("written_at", delay).dropDuplicatesWithinWatermark(["record_id"])


def tally(stream: DataFrame, window: str = "1 day") -> DataFrame:
    """Verdicts of each chain by window of event time."""
    return stream.groupBy(F.window("written_at", window).alias("w"), "chain", "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "chain", "verdict", "n")


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write all that has come to Parquet, and stop; run again, it goes on where it stopped."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
