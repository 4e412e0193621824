"""Average linkage by joins: in each round all clusters that are each other's nearest merge at once.

Average distances never shrink when clusters merge, so such pairs would also merge one
by one, in the order of their distances. A round halves a good part of the clusters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialized


def _round(sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges of a round (a, b, size, dist; a is kept as the name), and the sums of distances after it."""
    d = F.col("total") / (F.col("na") * F.col("nb"))
    rank = F.struct(d.alias("d"), F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    near = sums.groupBy("a").agg(F.min(rank).alias("m"), F.min_by(F.col("na") + F.col("nb"), rank).alias("size"))
    # A pair that is nearest from both its sides is there twice.
    both = near.groupBy(F.col("m.low").alias("a"), F.col("m.high").alias("b")).agg(F.count("*").alias("sides"), F.first("m.d").alias("dist"), F.first("size").alias("size"))
    found = materialized(both.filter("sides = 2").select("a", "b", "size", "dist"))
    names = found.select(F.explode(F.array("a", "b")).alias("was"), F.col("a").alias("is"), "size")
    for side, n in (("a", "na"), ("b", "nb")):
        told = sums.join(names.withColumnRenamed("was", side), side, "left")
        sums = told.withColumn(n, F.coalesce("size", n)).withColumn(side, F.coalesce("is", side)).drop("is", "size")
    return found, materialized(sums.filter("a <> b").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("total").alias("total")))


def average_linkage(pairs: DataFrame) -> DataFrame:
    """step, a, b, size and dist of each merge, from distances (i, j, d) of all pairs in both directions.

    Points are numbered from 1 in the order of their names, the cluster of a step is
    numbered on from theirs; a is the lower number. Of equal distances the pair of the
    smallest names goes first. No pairs give no merges.
    """
    points = materialized(pairs.select(F.col("i").alias("name")).distinct().select("name", F.row_number().over(Window.orderBy("name")).alias("number")))
    left = points.select(F.col("name").alias("i"), F.col("number").alias("a"))
    right = points.select(F.col("name").alias("j"), F.col("number").alias("b"))
    one = F.lit(1).cast("long")
    sums = materialized(pairs.join(left, "i").join(right, "j").select("a", "b", one.alias("na"), one.alias("nb"), F.col("d").cast("double").alias("total")))
    rounds = []
    while not sums.isEmpty():
        found, sums = _round(sums)
        rounds.append(found.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return pairs.sparkSession.createDataFrame([], "step int, a int, b int, size int, dist double")
    n = points.count()
    steps = materialized(reduce(DataFrame.unionByName, rounds).withColumn("step", F.row_number().over(Window.orderBy("dist", "round", "a"))))
    before = F.lag("step").over(Window.partitionBy("a").orderBy("step"))
    last = steps.groupBy(F.col("a").alias("b")).agg(F.max("step").alias("last"))
    named = steps.withColumn("before", before).join(last, "b", "left")
    number = lambda step, own: F.coalesce(F.col(step) + n, F.col(own))
    a, b = number("before", "a"), number("last", "b")
    return named.select("step", F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"), F.col("size").cast("int").alias("size"), "dist")
