"""Features of a reference: positions, the most specific one, names of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import CODONS, translated

BIN = 64


def codon_starts(features: DataFrame) -> DataFrame:
    """First positions of each feature's codons, with their number, which goes on over the ranges of a feature."""
    at = features.filter("end >= start").withColumn("position", F.explode(F.expr("sequence(start, end, 3)")))
    before = F.col("codons_before") if "codons_before" in features.columns else F.lit(0)
    return at.select("feature", "position", ((F.col("position") - F.col("start")) / 3 + 1 + before).cast("int").alias("codon_no"))


def feature_at(positions: DataFrame, features: DataFrame) -> DataFrame:
    """The shortest feature over each position (ties: the first row), or an empty text.

    Features are spread over bins of ``BIN`` positions and met by bin, so the join is by
    equality.
    """
    spread = features.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))))
    asked = positions.select("position").distinct().withColumn("bin", F.floor(F.col("position") / BIN))
    over = asked.join(spread, "bin").filter("position between start and end")
    best = over.groupBy("position").agg(F.min_by(F.struct("feature", "start"), F.struct(F.col("end") - F.col("start"), F.col("row_no"))).alias("best"))
    found = positions.join(best, "position", "left")
    return found.select(*positions.columns, F.coalesce("best.feature", F.lit("")).alias("feature"), F.col("best.start").alias("feature_start"))


def variant_labels(variants: DataFrame, features: DataFrame, reference: DataFrame) -> DataFrame:
    """feature-refAAcodonNoAA of variants (ref_id, position, codon) that start a codon of their feature."""
    placed = feature_at(variants, features).filter((F.col("feature") != "") & ((F.col("position") - F.col("feature_start")) % 3 == 0))
    codons = reference_codons(reference)
    named = translated(translated(placed.join(codons, ["ref_id", "position"]), "codon"), "ref_codon", "ref_aa")
    number = ((F.col("position") - F.col("feature_start")) / 3 + 1).cast("int")
    return named.select("ref_id", "position", "codon", F.concat("feature", F.lit("-"), "ref_aa", number.cast("string"), "amino_acid").alias("label"))


def variant_grid(reference: DataFrame, features: DataFrame) -> DataFrame:
    """Labels of every codon at each position that starts a codon of its feature."""
    codons = F.explode(F.array(*[F.lit(c) for c in CODONS])).alias("codon")
    return variant_labels(reference.select("ref_id", "position", codons), features, reference)


def codon_number(position: Column, start: Column, end: Column) -> Column:
    """Number of the codon that starts at a position of a feature; any other position is an error."""
    sound = position.between(start, end) & ((position - start) % 3 == 0)
    wrong = F.concat(F.lit("no codon of the feature starts at "), position.cast("string"))
    return F.when(sound, ((position - start) / 3 + 1).cast("int")).otherwise(F.raise_error(wrong))


def reference_codons(reference: DataFrame) -> DataFrame:
    """Codon that starts at each position, from one row a base."""
    shifted = [reference.select("ref_id", (F.col("position") - k).alias("position"), F.col("base").alias(f"b{k}")) for k in (0, 1, 2)]
    out = shifted[0].join(shifted[1], ["ref_id", "position"]).join(shifted[2], ["ref_id", "position"])
    return out.select("ref_id", "position", F.concat("b0", "b1", "b2").alias("ref_codon"))
