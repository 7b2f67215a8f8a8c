"""The records of the project's own domain that hold text: passages, quotes and route paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.sources.tables import table


def passage_texts(spark: SparkSession, d: str) -> DataFrame:
    """``p:`` records: rec, ord, text."""
    return table(spark, d, "passages").select(F.concat(F.lit("p:"), "id").alias("rec"), F.col("passage_no").cast("long").alias("ord"), "text")


def quote_texts(spark: SparkSession, d: str) -> DataFrame:
    """``q:`` records, named by record_id and the position of the quote: rec, ord, text."""
    chains = table(spark, d, "chains").select("record_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("ord"), F.posexplode("detail.quotes").alias("pos", "text"))
    return chains.select(F.concat(F.lit("q:"), F.col("record_id").cast("string"), F.lit("#"), F.col("pos").cast("string")).alias("rec"), "ord", "text")


def route_texts(spark: SparkSession, d: str) -> DataFrame:
    """``r:`` records: rec, ord, text."""
    return table(spark, d, "routes_input").select(F.concat(F.lit("r:"), F.col("route_no").cast("string")).alias("rec"), F.col("route_no").cast("long").alias("ord"), F.col("paragraph").alias("text"))


def one_per_record(texts: DataFrame) -> DataFrame:
    """Repeated deliveries as one record: the text that came last holds; null texts and names go."""
    keyed = texts.where("rec is not null and text is not null")
    return keyed.groupBy("rec").agg(F.max_by("text", F.struct("ord", "text")).alias("text"))
