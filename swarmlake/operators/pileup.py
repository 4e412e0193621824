"""Pileup: reads to counts of codons, nucleotides and coverage at reference positions.

All are additive counts by equality keys, so Spark's partial aggregation does
most of the work before the one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import ALIGNED, chunks, cigar_elements, read_filter
from ..plans.tables import materialized


def walk(reads: DataFrame) -> DataFrame:
    """One row for each CIGAR element of each read: op, len, read_pos, ref_pos."""
    return reads.withColumn("chunk", F.explode(chunks(cigar_elements(F.col("cigar")), F.col("pos")))).select("*", "chunk.*").drop("chunk")


def aligned_chunks(reads: DataFrame, **filters) -> DataFrame:
    return walk(reads.filter(read_filter(**filters))).filter(F.col("op").isin(*ALIGNED))


def _windows(reads: DataFrame, width: int, **filters) -> DataFrame:
    """Every run of ``width`` bases within an aligned element; runs never cross elements."""
    some = aligned_chunks(reads, **filters).filter(F.col("len") >= width)
    at = some.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("len") - width)))
    place = F.col("read_pos") + F.col("i")
    bases = at.withColumn("bases", F.col("seq").substr(place, F.lit(width))).filter(F.col("bases").rlike(f"^[ACGT]{{{width}}}$"))
    return bases.withColumn("position", F.col("ref_pos") + F.col("i")).withColumn("q", F.slice("qual", place, width))


def masked(q: Column, threshold: int) -> Column:
    return F.when(q >= threshold, q).otherwise(0)


def codon_counts(reads: DataFrame, threshold: int = 0, keys: tuple[str, ...] = ("ref_id",), **filters) -> DataFrame:
    """n reads by position, codon and its three qualities; those below ``threshold`` become 0, and all-0 rows go."""
    q = [masked(F.element_at("q", i), threshold) if threshold else F.element_at("q", i) for i in (1, 2, 3)]
    seen = _windows(reads, 3, **filters).select(*keys, "position", F.col("bases").alias("codon"), *[c.alias(f"q{i}") for i, c in enumerate(q, 1)])
    if threshold:
        seen = seen.filter("q1 + q2 + q3 > 0")
    return seen.groupBy(*keys, "position", "codon", "q1", "q2", "q3").agg(F.count("*").alias("n"))


def nucleotide_counts(reads: DataFrame, threshold: int = 0, keys: tuple[str, ...] = ("ref_id",), **filters) -> DataFrame:
    """n reads by position, base and quality of at least ``threshold``."""
    seen = _windows(reads, 1, **filters).select(*keys, "position", F.col("bases").alias("nuc"), F.element_at("q", 1).alias("q"))
    return seen.filter(F.col("q") >= threshold).groupBy(*keys, "position", "nuc", "q").agg(F.count("*").alias("n"))


def _wildcards(codon: Column, kept: list[Column]) -> Column:
    return F.concat(*[F.when(k, F.substring(codon, i, 1)).otherwise("?") for i, k in enumerate(kept, 1)])


def unambiguous(counts: DataFrame, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """Observations that agree, in their unmasked bases, with some complete codon at their position.

    A masked base is a wildcard: each complete codon offers its eight patterns, and
    an equality join replaces the comparison of all with all. The counts are written
    once, as both sides need them.
    """
    counts = materialized(counts)
    complete = counts.filter("q1 > 0 and q2 > 0 and q3 > 0").select(*keys, "position", "codon").distinct()
    patterns = [_wildcards(F.col("codon"), [F.lit(bool(m & b)) for b in (4, 2, 1)]) for m in range(1, 8)]
    offered = complete.select(*keys, "position", F.explode(F.array(*patterns)).alias("pattern")).distinct()
    asked = counts.withColumn("pattern", _wildcards(F.col("codon"), [F.col(f"q{i}") > 0 for i in (1, 2, 3)]))
    return asked.join(offered, [*keys, "position", "pattern"], "left_semi").drop("pattern")


def coverage(reads: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ("ref_id",), **filters) -> DataFrame:
    """Reads over each position of the reference: +1 where an aligned element starts, -1 behind it, summed up."""
    aligned = aligned_chunks(reads, **filters)
    events = aligned.select(*keys, F.explode(F.array(F.struct(F.col("ref_pos").alias("position"), F.lit(1).alias("d")), F.struct((F.col("ref_pos") + F.col("len")).alias("position"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*keys, "e.position").agg(F.sum("e.d").alias("d"))
    dense = reference.join(steps, [*keys, "position"], "left")
    running = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(*keys, "position", F.sum(F.coalesce("d", F.lit(0))).over(running).alias("coverage"))


def naive_frequencies(counts: DataFrame, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """Share of each codon among the complete observations of its position."""
    sums = counts.filter("q1 > 0 and q2 > 0 and q3 > 0").groupBy(*keys, "position", "codon").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "position"))
    return sums.select(*keys, "position", "codon", "n", (F.col("n") / total).alias("freq"))
