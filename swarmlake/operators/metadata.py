"""Sample metadata: filters, lookups, and the join with fitness tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(metadata: DataFrame, *filters: str | tuple | Column) -> DataFrame:
    """Rows that meet all filters: a column that must be there, (column, value, values or predicate), or a condition.

    A missing column or no row left gives an empty table without columns.
    """
    for f in filters:
        name = f if isinstance(f, str) else f[0] if isinstance(f, tuple) else None
        if name is not None and name not in metadata.columns:
            return metadata.select().limit(0)
        if isinstance(f, tuple):
            value = f[1]
            met = value(F.col(name)) if isinstance(value, Callable) else F.col(name).isin(list(value)) if isinstance(value, (list, set)) else F.col(name) == value
            metadata = metadata.filter(F.coalesce(met, F.lit(False)))
        elif name is None:
            metadata = metadata.filter(F.coalesce(f, F.lit(False)))
    return metadata


def matches_any(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(p)
    return out


def reference_by_pattern(samples: DataFrame, name: str, patterns: dict[str, str]) -> DataFrame:
    """Adds the reference whose pattern the name matches; none or several are an error."""
    met = F.filter(F.array(*[F.when(F.col(name).rlike(p), F.lit(r)) for p, r in patterns.items()]), lambda r: r.isNotNull())
    wrong = F.concat(F.lit("not one pattern for sample "), F.coalesce(F.col(name), F.lit("null")))
    return samples.withColumn("reference", F.when(F.size(met) == 1, F.element_at(met, 1)).otherwise(F.raise_error(wrong)))


def level_of(columns: list[str], levels: dict[tuple, str]) -> Column:
    """The level that a fixed table gives to the columns' values; null where it has none."""
    out = F.lit(None).cast("string")
    for values, level in levels.items():
        met = F.lit(True)
        for c, v in zip(columns, values, strict=True):
            met = met & (F.col(c) == F.lit(v))
        out = F.when(met, F.lit(level)).otherwise(out)
    return out


def in_order_of(ids: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """The first metadata row, by the order of its values, of each row of ``ids``, whose columns say the order; an id without one is an error."""
    rest = [c for c in metadata.columns if c not in ids.columns]
    first = metadata.groupBy(key).agg(F.min(F.struct(F.lit(True).alias("there"), *rest)).alias("first"))
    wrong = F.concat(F.lit("no metadata for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    found = ids.join(first, key, "left").withColumn("first", F.when(F.col("first").isNotNull(), F.col("first")).otherwise(F.raise_error(wrong)))
    return found.select(*ids.columns, *[F.col(f"first.{c}").alias(c) for c in rest])


def check_same_sites(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    """Raises unless both tables have the same sites."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    if not (a.join(b, on, "left_anti").isEmpty() and b.join(a, on, "left_anti").isEmpty()):
        raise ValueError(f"tables differ in {', '.join(on)}")


def lookup(left: DataFrame, right: DataFrame, on: list[str], order: str) -> DataFrame:
    """The first row of ``right`` for each key, by ``order``, or nulls."""
    rest = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*rest), order).alias("first"))
    return left.join(first, on, "left").select(*left.columns, *[F.col(f"first.{c}").alias(c) for c in rest if c != order])


def mean_of_known(*columns: str) -> Column:
    """Mean of the values that are there."""
    some = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.size(some))


def fitness_joined(metadata: DataFrame, fitness: DataFrame, sample: str, keys: list[str], row: str) -> DataFrame:
    """Fitness by sample; rows left over take, in order, the unused fitness rows of their equal keys.

    Matching is by equality on one key, so the n-th row of a key takes the n-th
    unused fitness row of that key.
    """
    exact = metadata.join(fitness.filter(F.col(sample).isNotNull()).groupBy(sample).agg(F.min_by(F.struct("fit_row", "fitness"), "fit_row").alias("m")), sample, "left")
    direct = exact.filter("m is not null").select(*metadata.columns, F.col("m.fitness").alias("fitness"))
    unused = fitness.join(exact.filter("m is not null").select(F.col("m.fit_row").alias("fit_row")), "fit_row", "left_anti")
    left = exact.filter("m is null").drop("m")
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    ranked = left.filter(complete).withColumn("rn", number(row))
    offered = unused.filter(complete).withColumn("rn", number("fit_row")).select(*keys, "rn", "fitness")
    inexact = ranked.join(offered, [*keys, "rn"], "left").select(*metadata.columns, "fitness")
    none = left.filter(~complete).withColumn("fitness", F.lit(None).cast("double"))
    return direct.unionByName(inexact).unionByName(none)


def regression(df: DataFrame, group: str, x: str, y: str, least: float = 1e-6) -> DataFrame:
    """Slope, intercept and the two ends of each group's regression line; flat where x hardly varies."""
    line = df.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("x1"), F.max(x).alias("x2"))
    flat = (F.col("x2") - F.col("x1")) <= least
    slope, intercept = F.when(flat, 0.0).otherwise(F.col("slope")), F.when(flat, 0.0).otherwise(F.col("intercept"))
    return line.select(group, slope.alias("slope"), intercept.alias("intercept"), "x1", "x2", (intercept + slope * F.col("x1")).alias("y1"), (intercept + slope * F.col("x2")).alias("y2"))
