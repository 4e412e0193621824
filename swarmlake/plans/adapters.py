"""Views that give the driver's tables the shapes the operators expect.

Each is a deterministic projection, so the same view in another SQL engine holds
the same rows (``ORACLE`` in ``oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of each of the four references.
POSITIONS = 544
CIGARS = ["32M", "10M2I20M", "12M3D20M", "4S28M", "16M5N16M", "20M12X", "8=24M"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned reads of 32 bases from ``lineitem``."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    hexes = F.md5(F.concat(F.lit("q"), key).cast("binary"))
    qual = F.transform(F.split(hexes, ""), lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1) * 2 + 10)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 64).otherwise(F.when(F.col("l_partkey") % 3 == 0, 256).otherwise(128))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("sample_id"),
        (F.col("l_suppkey") % 4).alias("ref_id"),
        (F.col("l_partkey") % 500 + 1).cast("int").alias("pos"),
        F.col("l_quantity").cast("int").alias("mapq"),
        (flag + F.when(F.col("l_linestatus") == "F", 16).otherwise(0)).alias("flag"),
        (F.round(F.col("l_tax") * 100).cast("int") == 8).alias("has_sa"),
        F.element_at(F.array(*[F.lit(c) for c in CIGARS]), (F.col("l_linenumber") % 7 + 1).cast("int")).alias("cigar"),
        F.translate(F.md5(key.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"),
        qual.alias("qual"),
    )


def reference(spark: SparkSession) -> DataFrame:
    """Bases of the four references, one row a position."""
    refs = spark.range(4).select(F.col("id").alias("ref_id"), F.explode(F.sequence(F.lit(1), F.lit(POSITIONS))).alias("position"))
    base = F.translate(F.substring(F.md5(F.concat_ws("-", F.lit("ref"), "ref_id", "position").cast("binary")), 1, 1), "0123456789abcdef", "ACGT" * 4)
    return refs.select("ref_id", "position", base.alias("base"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated stretches of a reference from ``part``."""
    start = (F.col("p_partkey") * 7 % 500 + 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_brand", "p_partkey").alias("feature"), start.alias("start"), (start + 3 * F.col("p_size") - 1).cast("int").alias("end"), F.col("p_partkey").alias("row_no")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series from ``events``: one for each user and event type, t in seconds."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = table(spark, sf_dir, "events").select("user_id", "event_type", seconds.alias("t"), F.col("value").alias("v"))
    return events.groupBy("user_id", "event_type", "t").agg(F.avg("v").alias("v"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of ``events`` in two dimensions: the value, and its distance from 50 over ten."""
    return series(spark, sf_dir).withColumn("v", F.array("v", F.abs(F.col("v") - 50) / 10))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of six categories, with their price as fitness."""
    name = F.split("p_name", " ")
    x = [F.col("p_brand"), F.col("p_type"), name[0], name[1], (F.col("p_size") % 10).cast("string"), F.floor(F.col("p_size") / 10).cast("string")]
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(f"x{i}") for i, c in enumerate(x)], F.col("p_retailprice").cast("double").alias("fitness"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a group and a fitness from ``embeddings``."""
    x = F.transform("embedding", lambda v: F.round(v.cast("double"), 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", x.alias("x"), F.round(F.element_at("embedding", 1).cast("double"), 4).alias("fitness"))
