"""Column expressions on sequences: codons, translation, distances."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
# The standard genetic code, codons in the order AAA, AAC, AAG, AAT, ACA, ... TTT.
AMINO_ACIDS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
CODONS = ["".join(c) for c in product(BASES, repeat=3)]


def codon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(CODONS, AMINO_ACIDS)), "codon string, amino_acid string")


def sequence_codons(sequence: Column) -> Column:
    """Codons at every offset; none for fewer than three bases. Letters are split once, so long texts stay linear."""
    letters = F.split(sequence, "")
    join = lambda x, y: F.concat(x, y)
    triples = F.zip_with(F.zip_with(letters, F.slice(letters, F.lit(2), F.length(sequence)), join), F.slice(letters, F.lit(3), F.length(sequence)), join)
    return F.when(F.length(sequence) >= 3, F.slice(triples, F.lit(1), F.length(sequence) - 2)).otherwise(F.array().cast("array<string>"))


def translated(df: DataFrame, codon: str, name: str = "amino_acid") -> DataFrame:
    """Adds the amino acid of a codon column, ``?`` for what is no codon."""
    table = codon_table(df.sparkSession).withColumnsRenamed({"codon": "__codon", "amino_acid": name})  # 64 rows
    return df.join(F.broadcast(table), F.col(codon) == F.col("__codon"), "left").drop("__codon").withColumn(name, F.coalesce(name, F.lit("?")))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; null for unequal lengths."""
    split = lambda c: F.split(c, "")
    differ = F.aggregate(F.zip_with(split(a), split(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, 0).otherwise(differ))


def edit_cost(source: str, target: str, deletion: float, insertion: float, substitution: float) -> float:
    """Weighted edit distance by rows; the running minimum along a row replaces its inner loop."""
    n = len(target)
    steps = insertion * np.arange(n + 1, dtype=float)
    row = steps.copy()
    letters = np.array(list(target))
    for i, letter in enumerate(source, 1):
        diagonal = row[:-1] + substitution * (letters != letter)
        new = np.concatenate([[i * deletion], np.minimum(row[1:] + deletion, diagonal)])
        row = np.minimum.accumulate(new - steps) + steps
    return float(row[-1])


def weighted_levenshtein(a: Column, b: Column, deletion: float = 1.0, insertion: float = 1.0, substitution: float = 1.0) -> Column:
    """Edit distance with costs of its own; with unit costs the built-in ``levenshtein`` is the same."""

    @F.pandas_udf("double")
    def cost(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else edit_cost(s, t, deletion, insertion, substitution) for s, t in zip(x, y)], dtype=float)

    return cost(a, b)
