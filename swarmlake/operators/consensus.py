"""Consensus sequences from reads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import ALIGNED, read_filter
from ..functions.sequences import hamming, weighted_levenshtein
from .pileup import walk


def events(reads: DataFrame, **filters) -> DataFrame:
    """Counts by ref_id, position, kind and value.

    ``base``: bases seen; ``next``: aligned bases followed by one on the read and the
    reference; ``ins`` and ``del``: the inserted bases, and the deleted length, behind
    a position. Events before the first position are dropped.
    """
    chunks = walk(reads.filter(read_filter(**filters))).filter(F.col("op").isin(*ALIGNED, "I", "D"))
    offsets = F.when(F.col("op").isin(*ALIGNED), F.sequence(F.lit(0), F.col("len") - 1)).otherwise(F.array(F.lit(-1)))
    at = chunks.withColumn("i", F.explode(offsets))
    base = F.col("seq").substr(F.col("read_pos") + F.col("i"), F.lit(1))
    aligned = F.col("op").isin(*ALIGNED)
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    empty = F.lit("")
    seen = F.when(
        aligned,
        F.array_compact(F.array(F.when(base.isin("A", "C", "G", "T"), one("base", base)), F.when(F.col("i") < F.col("len") - 1, one("next", empty)))),
    ).when(F.col("op") == "I", F.array(one("ins", F.col("seq").substr(F.col("read_pos"), F.col("len"))))).otherwise(F.array(one("del", F.col("len").cast("string"))))
    rows = at.select("ref_id", (F.col("ref_pos") + F.col("i")).alias("position"), F.explode(seen).alias("e"))
    return rows.filter("position >= 1").groupBy("ref_id", "position", "e.kind", "e.value").agg(F.count("*").alias("n"))


def bases(counts: DataFrame, reference: DataFrame, min_support: int = 1) -> DataFrame:
    """The most frequent base of each position (ties: A before C before G before T), or the reference's."""
    best = counts.filter("kind = 'base'").groupBy("ref_id", "position").agg(F.max_by("value", F.struct("n", -F.ascii("value"))).alias("best"), F.max("n").alias("n"))
    called = F.when(F.col("n") >= min_support, F.col("best")).otherwise(F.col("base"))
    return reference.join(best, ["ref_id", "position"], "left").select("ref_id", "position", F.coalesce(called, "base").alias("base"))


def sequences(counts: DataFrame, reference: DataFrame, min_support: int = 1, indel_min_support: int | None = None) -> DataFrame:
    """Consensus with insertions and deletions: a scan over each reference, whose positions bound a group."""
    support = min_support if indel_min_support is None else indel_min_support
    best = lambda kind, rank: counts.filter(F.col("kind") == kind).groupBy("ref_id", "position").agg(F.max_by("value", rank).alias(kind), F.max("n").alias(f"n_{kind}"))
    follow = counts.filter("kind = 'next'").select("ref_id", "position", F.col("n").alias("n_next"))
    rows = bases(counts, reference, min_support)
    # ties: the first insertion in order of text, the shortest deletion
    for some in (best("ins", F.struct("n", -F.length("value"), F.hex(F.translate("value", "ACGTN", "tgcan")))), best("del", F.struct("n", -F.col("value").cast("int"))), follow):
        rows = rows.join(some, ["ref_id", "position"], "left")

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        out, skip = [], 0
        numbers = group[["n_ins", "n_del", "n_next"]].fillna(0).to_numpy()
        for base, ins, deleted, (n_ins, n_del, n_next) in zip(group["base"], group["ins"], group["del"], numbers):
            if skip:
                skip -= 1
                continue
            out.append(base)
            if max(n_ins, n_del) >= max(n_next + 1, support):
                if n_ins > n_del:
                    out.append(ins)
                else:
                    skip = int(deleted)
        return pd.DataFrame({"ref_id": [group["ref_id"].iloc[0]], "sequence": ["".join(out)]})

    return rows.groupBy("ref_id").applyInPandas(scan, "ref_id long, sequence string")


def closest_references(samples: DataFrame, references: DataFrame, gap: float = 10.0) -> DataFrame:
    """Each sample's assigned and closest reference, and whether the assigned one differs by insertions or deletions.

    Substitutions cost one, gaps ``gap``. ``references`` (ref_id, sequence) are few and go to all tasks; ties keep the
    assigned reference, then the smallest name.
    """
    known = references.select(F.col("ref_id").alias("near"), F.col("sequence").alias("near_sequence"))
    pairs = samples.join(F.broadcast(known)).withColumn("distance", weighted_levenshtein(F.col("sequence"), F.col("near_sequence"), gap, gap, 1.0))
    own = F.col("near") == F.col("ref_id")
    flat = hamming(F.col("sequence"), F.col("near_sequence"))
    best = pairs.groupBy("sample_id", "ref_id").agg(
        F.min_by("near", F.struct("distance", (~own).cast("int"), "near")).alias("closest"),
        F.min("distance").alias("distance"),
        F.max(F.when(own, F.coalesce(flat != F.col("distance"), F.lit(True)))).alias("has_indels"),
    )
    return best.select("sample_id", "ref_id", "closest", "distance", "has_indels", (F.col("closest") != F.col("ref_id")).alias("warning"))
