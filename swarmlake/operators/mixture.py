"""Which references a sample is a mixture of, from codon frequencies where they differ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def patterns(reference_codons: DataFrame) -> DataFrame:
    """Positions at which references differ: codon, its number there, and the class of positions with that grouping.

    The class names, for each reference in order, the first one that has its codon.
    """
    site = Window.partitionBy("position")
    first = F.min("ref_id").over(Window.partitionBy("position", "ref_codon"))
    named = reference_codons.withColumn("first", first).withColumn("refs", F.count("*").over(site))
    sites = named.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("ref_id", "first"))).alias("g"), F.collect_set(F.struct("first", F.col("ref_codon").alias("codon"))).alias("codons"))
    differ = sites.filter(F.size("codons") > 1).select("position", F.array_join(F.transform("g", lambda x: F.concat_ws(":", x["ref_id"], x["first"])), ",").alias("class"), F.explode("codons").alias("c"))
    return differ.select("position", "class", "c.first", "c.codon")


def trimmed_frequencies(swarm: DataFrame, differ: DataFrame) -> DataFrame:
    """By sample, class and codon group: mean frequency over positions inside all inter-quartile ranges, and their number."""
    sums = swarm.groupBy("sample_id", "position", "codon").agg(F.sum("freq").alias("freq"))
    seen = sums.join(differ, ["position", "codon"], "left_semi").select("sample_id", "position").distinct()
    dense = seen.join(differ, "position").join(sums, ["sample_id", "position", "codon"], "left").withColumn("f", F.coalesce("freq", F.lit(0.0)))
    total = F.sum("f").over(Window.partitionBy("sample_id", "position"))
    shares = dense.withColumn("f", F.col("f") / total)
    quartiles = shares.groupBy("sample_id", "class", "first").agg(F.percentile("f", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    inside = shares.join(quartiles, ["sample_id", "class", "first"]).withColumn("ok", F.col("f").between(F.col("q")[0], F.col("q")[1]))
    kept = inside.withColumn("all_ok", F.min("ok").over(Window.partitionBy("sample_id", "position"))).filter("all_ok")
    return kept.groupBy("sample_id", "class", "first").agg(F.avg("f").alias("f"), F.count("*").alias("n"))


def on_simplex(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares over non-negative weights that sum to one, by projected gradients."""
    x = np.full(a.shape[1], 1 / a.shape[1])
    step = 1 / max(np.linalg.eigvalsh(a.T @ a).max(), 1e-12)
    while True:  # every step lowers the squares, so steps vanish
        z = x - step * (a.T @ (a @ x - y))
        u = np.sort(z)[::-1]
        k = np.flatnonzero(u - (np.cumsum(u) - 1) / np.arange(1, len(u) + 1) > 0)[-1]
        new = np.maximum(z - (u[: k + 1].sum() - 1) / (k + 1), 0)
        if np.abs(new - x).max() < 1e-12:
            break
        x = new
    return x


def estimated(swarm: DataFrame, reference_codons: DataFrame) -> DataFrame:
    """sample_id, ref_id and proportion; a sample without reads of any differing codon gets no rows."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        refs = [tuple(map(int, x.split(":"))) for x in group["class"].iloc[0].split(",")]
        names = [r for r, _ in refs]
        rows = np.array([[f == dict(tuple(map(int, x.split(":"))) for x in c.split(","))[r] for r in names] for c, f in zip(group["class"], group["first"])], dtype=float)
        n = group["n"].to_numpy(dtype=float)[:, None]
        w = on_simplex(rows * n, group["f"].to_numpy() * n[:, 0])
        return pd.DataFrame({"sample_id": group["sample_id"].iloc[0], "ref_id": names, "proportion": w})

    return trimmed_frequencies(swarm, patterns(reference_codons)).groupBy("sample_id").applyInPandas(solve, "sample_id long, ref_id long, proportion double")


def pure(mix: DataFrame, least: float = 0.98) -> DataFrame:
    """Samples of one reference but for ``1 - least``."""
    best = mix.groupBy("sample_id").agg(F.max_by(F.struct("ref_id", "proportion"), "proportion").alias("b"))
    return best.select("sample_id", "b.ref_id", "b.proportion").filter(F.col("proportion") >= least)
