"""Streams over a landing folder: the row-local operators as they are, and exact duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import quality

SCHEMA = "pair_id bigint, article string, summary string, outlet string, published_at timestamp, ingested_at timestamp, _source_file string, _source_row bigint"


def read_landing(spark: SparkSession, pattern: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of pairs as they arrive."""
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def decided_stream(pairs: DataFrame, rules: quality.QualityRules = quality.QualityRules()) -> DataFrame:
    """Quality reasons of a stream; stateless."""
    return quality.quality_reasons(quality.with_keys(pairs), rules)


def unique_stream(decided: DataFrame, delay: str = "30 days") -> DataFrame:
    """Passing rows without later copies of a pair that arrive within the delay; state is bounded by it."""
    passing = decided.filter("reason is null").withWatermark("ingested_at", delay)
    return passing.dropDuplicatesWithinWatermark(["article_key", "summary_key"])


def reason_counts_stream(decided: DataFrame, window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """(window, reason, rows) by ingestion time; late rows count until the watermark has passed."""
    marked = decided.filter("reason is not null").withWatermark("ingested_at", delay)
    return marked.groupBy(F.window("ingested_at", window), "reason").agg(F.count("*").alias("rows"))
