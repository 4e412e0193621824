"""Swarms: long tables of codon frequencies by sample and position, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialized

SITE = ("ref_id", "position")


def select(swarm: DataFrame, *conditions: Column) -> DataFrame:
    """Cells that meet all conditions on annotations, which are columns."""
    for c in conditions:
        swarm = swarm.filter(c)
    return swarm


def concat(swarms: list[DataFrame]) -> DataFrame:
    """Swarms of different samples under each other; annotations that one lacks are null there."""
    out = swarms[0]
    for s in swarms[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def annotate(swarm: DataFrame, annotation: DataFrame, on: list[str]) -> DataFrame:
    """Adds the columns of an annotation that varies along ``on`` only."""
    return swarm.join(annotation, on, "left")


def consensus(swarm: DataFrame) -> DataFrame:
    """Most frequent codon of each sample and site; ties go to the first in order of text."""
    rank = F.struct("freq", *[-F.ascii(F.substring("codon", i, 1)) for i in (1, 2, 3)])
    return swarm.groupBy("sample_id", *SITE).agg(F.max_by("codon", rank).alias("consensus"), F.max("freq").alias("freq"))


def consensus_one_hot(swarm: DataFrame, least: float = 0.25) -> DataFrame:
    """1 for each codon that has its site's highest frequency, if that is ``least`` or more."""
    top = F.max("freq").over(Window.partitionBy("sample_id", *SITE))
    return swarm.withColumn("one_hot", F.when((F.col("freq") == top) & (top >= least), 1).otherwise(0))


def log_transformed(swarm: DataFrame, lod: DataFrame, floor: float = 1e-3) -> DataFrame:
    """log2 of frequency plus limit of detection, which is ``floor`` at least."""
    joined = swarm.join(lod, [*SITE, "codon"], "left")
    return joined.withColumn("value", F.log2(F.col("freq") + F.greatest(F.coalesce("lod", F.lit(floor)), F.lit(floor)))).drop("lod")


def _moments(values: DataFrame, n_samples: int, column: str) -> DataFrame:
    """Mean and standard deviation over all samples, where a missing cell is 0."""
    s = values.groupBy(*SITE, "codon").agg(F.sum(column).alias("s"), F.sum(F.col(column) * F.col(column)).alias("s2"))
    mean = F.col("s") / n_samples
    spread = F.sqrt(F.greatest((F.col("s2") - F.col("s") * mean) / (n_samples - 1), F.lit(0.0)))
    return s.select(*SITE, "codon", mean.alias("mean"), spread.alias("sd"))


def centred(values: DataFrame, n_samples: int, column: str = "freq") -> DataFrame:
    """Less the mean of its variable over samples."""
    values = materialized(values)  # once for the means and for what they are taken from
    moments = _moments(values, n_samples, column).drop("sd")
    return values.join(moments, [*SITE, "codon"]).withColumn("centred", F.col(column) - F.col("mean")).drop("mean")


def variable(values: DataFrame, n_samples: int, least: float = 0.01, column: str = "freq") -> DataFrame:
    """Variables whose standard deviation is ``least`` or more of the largest."""
    moments = _moments(values, n_samples, column)
    top = moments.agg(F.max("sd").alias("top"))  # one row
    return moments.crossJoin(F.broadcast(top)).filter(F.col("sd") >= least * F.col("top")).drop("top")


def covered_samples(coverage: DataFrame, least: float = 1000.0) -> DataFrame:
    """Samples by mean coverage of at least ``least``."""
    return coverage.groupBy("sample_id").agg(F.avg("coverage").alias("mean_coverage")).filter(F.col("mean_coverage") >= least)


def by_strand(counts: DataFrame, keys: tuple[str, ...]) -> list[DataFrame]:
    """Frequencies over both strands, the forward and the reverse one, from complete counts with a column ``reverse``: one pileup for all."""
    sums = [F.sum("n"), F.sum(F.when(~F.col("reverse"), F.col("n"))), F.sum(F.when(F.col("reverse"), F.col("n")))]
    names = ("both", "f", "r")
    counted = counts.filter("q1 > 0 and q2 > 0 and q3 > 0").groupBy(*keys, "position", "codon").agg(*[s.alias(n) for s, n in zip(sums, names)])
    site = Window.partitionBy(*keys, "position")
    shares = materialized(counted.select(*keys, "position", "codon", *[(F.col(n) / F.sum(n).over(site)).alias(n) for n in names]))
    return [shares.filter(F.col(n).isNotNull()).select(*keys, "position", "codon", F.col(n).alias("freq")) for n in names]


def detection_limit(both: DataFrame, forward: DataFrame, reverse: DataFrame, run: Column, threshold: float = 1.5, low: float = -6.0, high: float = 1.0, precision: float = 1e-3) -> DataFrame:
    """Smallest pseudo frequency at which the strands of each codon agree within ``threshold``.

    Samples of a run with the same consensus are compared together; the result is
    the maximum over consensus codons and runs. A missing cell is frequency 0.
    """
    calls = consensus(both).select("sample_id", *SITE, "consensus").withColumn("run", run)
    cells = [s.select("sample_id", *SITE, "codon", F.col("freq").alias(name)) for s, name in ((forward, "f"), (reverse, "r"))]
    seen = cells[0].join(cells[1], ["sample_id", *SITE, "codon"], "full").fillna(0.0, ["f", "r"])
    group = ["run", *SITE, "consensus"]
    size = calls.groupBy(*group).agg(F.count("*").alias("samples"))
    pairs = seen.join(calls, ["sample_id", *SITE]).groupBy(*group, "codon").agg(F.collect_list(F.struct("f", "r")).alias("pairs"))

    def agrees(alpha: Column) -> Column:
        square = lambda p: F.pow(F.log2(p["f"] + alpha) - F.log2(p["r"] + alpha), 2)
        total = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + square(p))
        return F.sqrt(total / F.col("samples")) <= F.log2(F.lit(threshold))

    halvings, width = 0, high - low
    while width > precision:
        halvings, width = halvings + 1, width / 2

    def halve(span: Column, _: Column) -> Column:
        mid = (span["lo"] + span["hi"]) / 2
        ok = agrees(F.pow(F.lit(10.0), mid))
        return F.struct(F.when(ok, span["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(span["hi"]).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda span: F.pow(F.lit(10.0), (span["lo"] + span["hi"]) / 2))
    alpha = F.when(agrees(F.lit(10.0**low)), F.lit(10.0**low)).otherwise(found)
    return pairs.join(size, group).select(*SITE, "codon", alpha.alias("alpha")).groupBy(*SITE, "codon").agg(F.max("alpha").alias("lod"))
