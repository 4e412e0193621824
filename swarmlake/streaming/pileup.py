"""Pileup counts over reads that keep arriving: the batch aggregates as Structured Streaming.

Codon counts add up, so state is one row for each key that was seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.pileup import codon_counts


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Reads from Parquet files as they appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counting(reads: DataFrame, name: str, checkpoint: str, threshold: int = 30) -> StreamingQuery:
    """Keeps codon counts of all reads so far in the table ``name``; ends when all files that are there are read."""
    counts = codon_counts(reads, threshold=threshold)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
