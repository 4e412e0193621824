"""Time series in long form (ids, t, v): interpolation, means, medians, distance curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(series: DataFrame, ids: list[str]) -> DataFrame:
    """Each point with the next one of its series."""
    w = Window.partitionBy(*ids).orderBy("t")
    return series.select(*ids, "t", "v", F.lead("t").over(w).alias("t2"), F.lead("v").over(w).alias("v2"))


def interpolated(t: Column) -> Column:
    return F.when(t == F.col("t"), F.col("v")).otherwise(F.col("v") + (F.col("v2") - F.col("v")) * (t - F.col("t")) / (F.col("t2") - F.col("t")))


def _between(a: Column, b: Column, share: Column, wide: bool) -> Column:
    """``a + (b - a) share``, of numbers or of arrays."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * share) if wide else a + (b - a) * share


def _wide(series: DataFrame, column: str = "v") -> bool:
    return dict(series.dtypes)[column].startswith("array")


def last_before(marks: DataFrame, asked: DataFrame, ids: list[str], width: float | None = None) -> DataFrame:
    """``asked`` (ids, t, ..) with ``mark``: the row of ``marks`` (ids, t, ..) of the same ids with the largest t up to the asked one.

    Marks and questions pass together once, in order of time. With ``width`` a series is cut
    into stretches of so much time, so one of very many rows spreads over tasks: the last
    mark of each stretch is carried on to those after it. Null ids are ids like others.
    """
    own = [c for c in asked.columns if c not in ids]
    stretch = F.floor(F.col("t") / width) if width else F.lit(0).cast("long")
    mark = F.struct(*[c for c in marks.columns if c not in ids])
    m = marks.select(*ids, "t", mark.alias("mark"), F.lit(None).alias("ask"), F.lit(0).alias("asks"))
    q = asked.select(*ids, "t", F.lit(None).alias("mark"), F.struct(*own).alias("ask"), F.lit(1).alias("asks"))
    both = m.unionByName(q).withColumn("stretch", stretch)
    passed = Window.partitionBy(*ids, "stretch").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(*ids, "stretch", "ask", "asks", F.last("mark", ignorenulls=True).over(passed).alias("mark")).filter("asks = 1")
    if width:
        ends = both.groupBy(*ids, "stretch").agg(F.max_by("mark", F.when(F.col("asks") == 0, F.col("t"))).alias("end"))
        earlier = Window.partitionBy(*ids).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(c).alias(f"__{c}") for c in (*ids, "stretch")], F.last("end", ignorenulls=True).over(earlier).alias("carried"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*ids, "stretch")]
        found = found.join(carried, same).withColumn("mark", F.coalesce("mark", "carried"))
    return found.select(*ids, *[F.col("ask")[c].alias(c) for c in own], "mark")


def values_at(series: DataFrame, asked: DataFrame, ids: list[str], clamp: bool = False, width: float | None = None) -> DataFrame:
    """``asked`` (ids, t, ..) with ``value``: the series' linear interpolation at t, of numbers or arrays.

    Outside a series' times: with ``clamp`` its first or last value, else an error; the
    same for ids without a series, whose value is null with ``clamp``.
    """
    wide = _wide(series)
    found = last_before(segments(series, ids), asked, ids, width)
    firsts = series.groupBy(*[F.col(c).alias(f"__{c}") for c in ids]).agg(F.min_by("v", "t").alias("__first"))
    found = found.join(firsts, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ids], "left")
    m, t = F.col("mark"), F.col("t")
    inside = _between(m["v"], m["v2"], (t - m["t"]) / (m["t2"] - m["t"]), wide)
    outside = F.raise_error(F.concat(F.lit("no value at "), t.cast("string"))).cast(dict(series.dtypes)["v"])
    value = F.when(m.isNull(), F.col("__first") if clamp else outside).when(t == m["t"], m["v"]).when(m["t2"].isNull(), m["v"] if clamp else outside).otherwise(inside)
    return found.select(*asked.columns, value.alias("value"))


def at_steps(series: DataFrame, ids: list[str], step: float) -> DataFrame:
    """Values at all whole multiples of ``step`` within each series, by linear interpolation."""
    first, last = F.ceil(F.col("t") / step), F.ceil(F.coalesce("t2", F.col("t")) / step) - 1
    last = F.when(F.col("t2").isNull(), F.floor(F.col("t") / step)).otherwise(last)
    inside = segments(series, ids).withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return inside.select(*ids, (F.col("k") * step).alias("t"), interpolated(F.col("k") * step).alias("v"))


def means(series: DataFrame, ids: list[str]) -> DataFrame:
    """Mean over time of the linear interpolation; of a single point, its value."""
    s = segments(series, ids)
    span = F.coalesce(F.col("t2") - F.col("t"), F.lit(0.0))
    sums = s.groupBy(*ids).agg(F.sum(span * (F.col("v") + F.coalesce("v2", "v")) / 2).alias("area"), F.sum(span).alias("span"), F.avg("v").alias("flat"))
    return sums.select(*ids, F.when(F.col("span") > 0, F.col("area") / F.col("span")).otherwise(F.col("flat")).alias("mean"))


def median_filtered(series: DataFrame, ids: list[str], half: int = 2) -> DataFrame:
    """Median of 2 half + 1 values around each point; ends repeat."""
    w = Window.partitionBy(*ids).orderBy("t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [F.coalesce(F.lag("v", k).over(w), F.first("v").over(whole)) for k in range(1, half + 1)]
    after = [F.coalesce(F.lead("v", k).over(w), F.last("v").over(whole)) for k in range(1, half + 1)]
    return series.select(*ids, "t", F.element_at(F.sort_array(F.array("v", *before, *after)), half + 1).alias("v"))


def distance_curve(series: DataFrame, ids: list[str], kind: str, first: str, second: str) -> DataFrame:
    """Squared distance of two series of each id as quadratics: seg, t_start, t_end and c + b s + a s^2 from t_start.

    ``v`` is a number, or an array: then the quadratics are summed over its dimensions.
    Breakpoints of both are merged by one window over time, so no series meets all
    segments of the other.
    """
    if not _wide(series):
        series = series.withColumn("v", F.array("v"))
    w = Window.partitionBy(*ids).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for name in (first, second):
        mine = segments(series.filter(F.col(kind) == name), ids)
        parts.append(mine.select(*ids, "t", F.lit(name).alias("who"), F.struct("t", "v", "t2", "v2").alias("s")))
    both = parts[0].unionByName(parts[1])
    last = lambda name: F.last(F.when(F.col("who") == name, F.col("s")), ignorenulls=True).over(w)
    points = both.select(*ids, "t", last(first).alias("x"), last(second).alias("y"))
    points = points.groupBy(*ids, "t").agg(F.max_by("x", F.coalesce("x.t", F.lit(-1.0))).alias("x"), F.max_by("y", F.coalesce("y.t", F.lit(-1.0))).alias("y"))

    def value(s: str) -> Column:
        t, c = F.col("t"), F.col(s)
        return F.when(c["t"] == t, c["v"]).otherwise(F.zip_with(c["v"], c["v2"], lambda a, b: a + (b - a) * (t - c["t"]) / (c["t2"] - c["t"])))

    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    inside = points.filter("x is not null and y is not null").select(*ids, "t", less(value("x"), value("y")).alias("p")).filter("p is not null")
    n = Window.partitionBy(*ids).orderBy("t")
    seg = inside.select(*ids, (F.row_number().over(n) - 1).alias("seg"), F.col("t").alias("t_start"), F.lead("t").over(n).alias("t_end"), "p", F.lead("p").over(n).alias("p2"))
    seg = seg.filter("t_end is not null")
    q = F.transform(less(F.col("p2"), F.col("p")), lambda d: d / (F.col("t_end") - F.col("t_start")))
    return seg.withColumn("q", q).select(*ids, "seg", "t_start", "t_end", dot(F.col("p"), F.col("p")).alias("c"), (2 * dot(F.col("p"), F.col("q"))).alias("b"), dot(F.col("q"), F.col("q")).alias("a"))


def curve_values(curve: DataFrame, asked: DataFrame, ids: list[str], width: float | None = None) -> DataFrame:
    """``asked`` (ids, t, ..) with ``distance``: the curve at t; null outside it."""
    marks = curve.select(*ids, F.col("t_start").alias("t"), "t_end", "c", "b", "a")
    m = F.col("mark")
    s = F.col("t") - m["t"]
    square = m["c"] + s * (m["b"] + s * m["a"])
    distance = F.when(F.col("t") <= m["t_end"], F.sqrt(F.greatest(square, F.lit(0.0))))
    return last_before(marks, asked, ids, width).select(*asked.columns, distance.alias("distance"))


def curve_equals(curve: DataFrame, ids: list[str], y: float) -> DataFrame:
    """Times at which the distance is ``y``: roots in (0, length] of each segment, and the curve's very start."""
    c = F.col("c") - y * y
    flat = F.abs("a") < 1e-16
    disc = F.col("b") * F.col("b") - 4 * F.col("a") * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    linear = F.when(F.col("b") != 0, F.array(-c / F.col("b"))).otherwise(F.array().cast("array<double>"))
    two = F.when(disc < 0, F.array().cast("array<double>")).when(disc == 0, F.array(-F.col("b") / (2 * F.col("a")))).otherwise(F.array((-F.col("b") - root) / (2 * F.col("a")), (-F.col("b") + root) / (2 * F.col("a"))))
    roots = F.filter(F.when(flat, linear).otherwise(two), lambda s: (s > 0) & (s <= F.col("t_end") - F.col("t_start")))
    starts = F.when((F.col("seg") == 0) & (c == 0), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    return curve.withColumn("s", F.explode(F.concat(starts, roots))).select(*ids, "seg", (F.col("t_start") + F.col("s")).alias("t"))


def bifurcations(curve: DataFrame, ids: list[str], y: float) -> DataFrame:
    """First time at which the distance reaches ``y``: the start if it does there, null if never."""
    first = curve.groupBy(*ids).agg(F.min_by(F.struct("t_start", "c"), "seg").alias("first"))
    roots = curve_equals(curve, ids, y).groupBy(*ids).agg(F.min("t").alias("t"))
    start = F.when(F.sqrt("first.c") >= y, F.col("first.t_start"))
    return first.join(roots, ids, "left").select(*ids, F.coalesce(start, "t").alias("t"))


def curve_means(curve: DataFrame, ids: list[str]) -> DataFrame:
    """Mean distance over time: the integral of the root of each quadratic in closed form."""
    a, b, c, n = F.col("a"), F.col("b"), F.col("c"), F.col("t_end") - F.col("t_start")
    beta = F.greatest(4 * a * c - b * b, F.lit(0.0))
    beta = F.when(beta <= 1e-9 * (F.abs(4 * a * c) + b * b), 0.0).otherwise(beta)  # rounding of a perfect square

    def primitive(s: Column) -> Column:
        value = F.sqrt(F.greatest(c + s * (b + s * a), F.lit(0.0)))
        log = F.when(beta > 0, beta / (8 * F.pow(a, 1.5)) * F.log(2 * F.sqrt(a) * value + 2 * a * s + b)).otherwise(0.0)
        return (2 * a * s + b) / (4 * a) * value + log

    flat = F.when(F.abs(b) < 1e-16, F.sqrt(c) * n).otherwise((F.pow(F.greatest(c + b * n, F.lit(0.0)), 1.5) - F.pow(c, 1.5)) / (1.5 * b))
    area = F.when(a < 1e-16, flat).otherwise(primitive(n) - primitive(F.lit(0.0)))
    return curve.groupBy(*ids).agg((F.sum(area) / F.sum(n)).alias("mean"))
